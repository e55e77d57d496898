"""Aggregates against a plain walk of small random trees."""

import random

import pytest

from ledgerline.operators import aggregates

MODULE, IMPORT = "module string", "module string, dep string, nth int"


def reaches(imports, module, target):
    seen, stack = {module}, [module]
    while stack:
        for dep in imports.get(stack.pop(), []):
            if dep == target:
                return True
            if dep not in seen:
                seen.add(dep)
                stack.append(dep)
    return False


def plain(modules, imports, base, skip):
    """{aggregate: lines}, and the set of notes, folder by folder from the deepest."""
    inside = [m for m in modules if m.startswith(base + ".")]
    every = {m.rsplit(".", n)[0] for m in inside for n in range(1, m.count(".") + 1)}
    every = {f for f in every if f == base or f.startswith(base + ".")}
    free = lambda f: not set(f.split(".")[base.count(".") + 1 :]) & set(skip)
    waiting, out, notes = {}, {}, set()
    for f in sorted(filter(free, every), key=lambda x: (-x.count("."), x)):
        head = f + ".All"
        own = [m for m in inside if m.rsplit(".", 1)[0] == f and m != head and not (m in every and not free(m))]
        held = [m for m in own if reaches(imports, m, head)]
        for m in held:
            up = f.rsplit(".", 1)[0] + ".All"
            notes.add((head, "unplaceable", m) if f == base else (up, "promoted", m))
            if f != base:
                waiting.setdefault(up, []).append(m)
        foreign = [d for d in imports.get(head, []) if head in modules and not (d + ".").startswith(base.split(".")[0] + ".")]
        notes |= {(head, "dangling", d) for d in foreign if d not in modules}
        leaves = set(own) - set(held) | set(waiting.get(head, [])) | {d for d in foreign if d in modules}
        children = sorted(c for c in every if free(c) and c != base and c.rsplit(".", 1)[0] == f)
        lines = [c + ".All" for c in children] + sorted(leaves, key=lambda m: (m.rsplit(".", 1)[-1], m))
        if lines:
            out[head] = lines
    return out, notes


def run(spark, modules, imports, base="Lib", skip=(), **kw):
    rows = [(m, d, i) for m, deps in imports.items() for i, d in enumerate(deps)]
    made = aggregates.check(spark.createDataFrame([(m,) for m in modules], MODULE), spark.createDataFrame(rows, IMPORT), base, skip=skip, **kw)
    lines = {}
    for r in sorted(made.lines.collect(), key=lambda r: r.place):
        lines.setdefault(r.aggregate, []).append(r.module)
    return lines, {tuple(r) for r in made.notes.collect()}, {r.aggregate: r for r in made.status.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_trees(spark, seed):
    r = random.Random(seed)
    folders = ["Lib", "Lib.A", "Lib.A.X", "Lib.B", "Lib.B.Tmp", "Lib.B.Tmp.Y", "Lib.C.Z"]
    modules = {f"{r.choice(folders)}.m{i}" for i in range(25)} | {"Lib.B.Tmp", "Other.u", "Other.v", "Lib"}
    modules |= {f + ".All" for f in folders if r.random() < 0.7}
    names = sorted(modules)
    imports = {m: sorted(set(r.sample(names, r.randint(0, 2))) - {m}) for m in names if not m.endswith(".All")}
    imports |= {m: r.sample(names + ["Gone.w", "Libother.q"], 4) for m in names if m.endswith(".All")}
    imports = {m: [d for d in deps if d != m] for m, deps in imports.items()}
    want, notes = plain(modules, imports, "Lib", ["Tmp"])
    lines, got, status = run(spark, modules, imports, skip=["Tmp"])
    assert lines == want and got == notes
    for head, expected in want.items():
        state = "missing" if head not in modules else "current" if imports.get(head, []) == expected else "stale"
        assert (status[head].state, status[head].lines) == (state, len(expected))
    assert set(status) == set(want)


def test_a_module_over_its_own_aggregate_goes_up(spark):
    modules = {"Lib.Sub.Leaf", "Lib.Wide", "Lib.Sub.Consumer", "Lib.Sub.All"}
    imports = {"Lib.Wide": ["Lib.Sub.All"], "Lib.Sub.Consumer": ["Lib.Wide"], "Lib.Sub.All": ["Lib.Sub.Leaf"]}
    lines, notes, status = run(spark, modules, imports)
    assert lines == {"Lib.Sub.All": ["Lib.Sub.Leaf"], "Lib.All": ["Lib.Sub.All", "Lib.Sub.Consumer", "Lib.Wide"]}
    assert notes == {("Lib.All", "promoted", "Lib.Sub.Consumer")}
    assert {k: v.state for k, v in status.items()} == {"Lib.Sub.All": "current", "Lib.All": "missing"}
    naive = run(spark, modules, imports, respect_cycles=False)
    assert naive[0]["Lib.Sub.All"] == ["Lib.Sub.Consumer", "Lib.Sub.Leaf"] and not naive[1]


def test_options_order_and_no_place(spark):
    modules = {"Lib.All", "Lib.b", "Lib.a", "Lib.Ring", "Kept.a", "Core"}
    imports = {"Lib.Ring": ["Lib.All"], "Lib.All": ["Lib.a", "Kept.a", "Lib.b", "Gone"]}
    lines, notes, status = run(spark, modules, imports, root_import="Core")
    assert lines["Lib.All"] == ["Core", "Kept.a", "Lib.a", "Lib.b"]
    assert notes == {("Lib.All", "unplaceable", "Lib.Ring"), ("Lib.All", "dangling", "Gone")}
    assert tuple(status["Lib.All"]) == ("Lib.All", "stale", 4, 1, 1)
    assert run(spark, modules, imports, reexports=False)[0]["Lib.All"] == ["Lib.a", "Lib.b"]


def test_an_aggregate_imported_before_it_exists(spark):
    lines, notes, _ = run(spark, {"Lib.A.x", "Lib.A.y"}, {"Lib.A.x": ["Lib.A.All"]})
    assert lines == {"Lib.A.All": ["Lib.A.y"], "Lib.All": ["Lib.A.All", "Lib.A.x"]} and notes == {("Lib.All", "promoted", "Lib.A.x")}


def test_empty_and_null(spark):
    assert run(spark, set(), {}) == ({}, set(), {})
    lines, notes, status = run(spark, [None, "Lib.a", "Lib.a"], {"Lib.a": [None, "Lib.a"]})
    assert lines == {"Lib.All": ["Lib.a"]} and not notes and status["Lib.All"].state == "missing"


def test_aggregates_that_reach_one_another_are_walked_once(spark, monkeypatch):
    """Modules of a type's folders all reach all of its aggregates; a module is met once for each aggregate that it enters, not for all."""
    homes = [f"Lib.T.F{i}" for i in range(6)]
    imports = {h + ".All": [f"{h}.m{k}" for k in range(8)] + [homes[(i + 1) % 6] + ".All"] for i, h in enumerate(homes)}
    imports |= {f"{h}.m{k}": [h + ".All"] for h in homes for k in range(8)}
    walked = []
    walk = aggregates.graph.walk
    monkeypatch.setattr(aggregates.graph, "walk", lambda *a, **kw: walked.append(walk(*a, **kw)) or walked[-1])
    modules = [f"{h}.m{k}" for h in homes for k in range(8)]
    lines, notes, _ = run(spark, modules, imports)
    assert (lines, notes) == plain(modules, imports, "Lib", ())
    assert sum(w.count() for w in walked) == 48 + 6 + 36
