"""Consumption of claims, contracted chains and fronts against plain searches on small random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import consumption, fronts, graph, headlines, roadmap

CLAIM = "census string, id string, family string, title string, nth long, declarations array<string>, canonical array<string>, supporting array<string>"


def dag(r, n=30, extra=40):
    edges = {(i, r.randint(i + 1, n - 1)) for i in range(n - 1)} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(extra)}
    return {(f"lib{a % 3}.n{a:02}", f"lib{b % 3}.n{b:02}") for a, b in edges}


def first_path(adj, source, good, itself):
    before, queue = {source: None}, deque([source])
    while queue:
        node = queue.popleft()
        if (itself or node != source) and good(node):
            path = []
            while node is not None:
                path.append(node)
                node = before[node]
            return path[::-1]
        for nxt in sorted(adj.get(node, ())):
            if nxt not in before:
                before[nxt] = node
                queue.append(nxt)
    return None


def plain(edges, library, internal, claims, target, marks, terminal):
    """{claim id: (class, representative, witness, {mark: declaration}, downstream)} and the set of edges."""
    up = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    inside, queue, hop = {target}, deque([target]), {target: None}
    while queue:
        node = queue.popleft()
        for dep in sorted(up.get(node, ())):
            if dep not in hop:
                hop[dep] = node
                queue.append(dep)
    inside = set(hop)
    adj = {}
    for a, b in edges:
        if a in inside and b in inside:
            adj.setdefault(a, set()).add(b)

    def to_target(node):
        out = [node]
        while hop[out[-1]] is not None:
            out.append(hop[out[-1]])
        return out

    short = {}
    for name in library:
        short.setdefault(name.split(".")[-1], []).append(name)

    def known(names):
        out = []
        for x in names:
            hit = x if x in library else (short.get(x.split(".")[-1], [])[0] if len(short.get(x.split(".")[-1], [])) == 1 else None)
            if hit and hit not in out:
                out.append(hit)
        return out

    registered = {}
    for c in claims:
        if c[2] in terminal:
            for name in known(c[5]):
                registered.setdefault(name, []).append(c)

    def downstream(node, claim):
        path = first_path(adj, node, lambda x: any(o is not claim for o in registered.get(x, ())), True)
        return (path, min((o[1], o[3], o) for o in registered[path[-1]] if o is not claim)[2]) if path else (None, None)

    rows, drawn = {}, {}
    nid = lambda c: f"claim:{c[2]}:{c[1]}"
    for c in claims:
        declared, canonical, supporting = known(c[5]), known(c[6]), known(c[7])
        groups = [[x for x in canonical if x in inside], [x for x in supporting if x in inside]]
        groups.append([x for x in declared if x in inside and x not in groups[0] + groups[1]])
        at = next((i for i, g in enumerate(groups) if g), None)
        place = lambda x: declared.index(x) if x in declared else 999
        rep = min(groups[at], key=lambda x: (len(to_target(x)), place(x), x)) if at is not None else next(iter(canonical or supporting or declared), None)
        hits, current = {}, rep if at is not None else None
        chain = []
        for m in marks:
            path = first_path(adj, current, lambda x: library[x] == m.library and not internal[x], True) if current else None
            hits[m.id] = path[-1] if path else None
            if path:
                chain.append((m.id, path))
                current = path[-1]
        down = downstream(rep, c)[1] if at is not None else None
        rows[c[1]] = ([*consumption.CLASSES, "none"][3 if at is None else at], rep, to_target(rep) if rep in inside else None, hits, nid(down) if down else None)
        if at is None:
            continue

        def add(source, to, role, path):
            if source != to and path:
                drawn.setdefault((source, to, role), (nid(c), tuple(path)))  # noqa: B023

        if c[2] in terminal:
            add(nid(c), target, "claim-to-target", to_target(rep))
            continue
        node, name = nid(c), rep
        for mark, path in chain:
            if path[-1] != name:
                add(node, path[-1], f"landmark:{mark}", path)
                node = name = path[-1]
        path, other = downstream(name, c)
        if path:
            add(node, nid(other), "downstream-headline", path)
        else:
            add(node, target, "to-target", to_target(name))
    return rows, {(*k, *v) for k, v in drawn.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_consumption_against_plain_searches(spark, seed):
    r = random.Random(seed)
    edges = dag(r)
    names = sorted({x for e in edges for x in e} | {"lib9.alone"})
    library = {x: x.split(".")[0] for x in names}
    internal = {x: r.random() < 0.3 for x in names}
    target = names[max(range(len(names) - 1), key=lambda i: int(names[i][-2:]) if names[i] != "lib9.alone" else -1)]
    some = lambda k: r.sample([*names, "gone.x", f"other.{names[3].split('.')[1]}"], k)
    claims = []
    for i in range(14):
        canonical, supporting = some(r.choice([0, 0, 1, 2])), some(r.choice([0, 1, 2]))
        claims.append(("c", f"id{i:02}", "end" if i % 4 == 0 else f"fam{i % 3}", f"t{i}", i, [*canonical, *supporting, *some(r.choice([0, 1]))], canonical, supporting))
    marks = [consumption.Landmark("one", "lib1"), consumption.Landmark("two", "lib2")]
    found = consumption.analyse(
        spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(x, library[x], internal[x]) for x in names], "name string, library string, internal boolean"), spark.createDataFrame(claims, CLAIM), target, marks, ["end"]
    )
    rows, drawn = plain(edges, library, internal, claims, target, marks, {"end"})
    hits = {}
    for x in found.landmarks.collect():
        hits.setdefault(x.id, {})[x.landmark] = x.declaration
    down = {x.id: x.downstream for x in found.downstream.collect()}
    assert {x.id: (x["class"], x.representative, x.witness, hits[x.id], down.get(x.id)) for x in found.claims.collect()} == rows
    assert {(x.source, x.target, x.role, x.origin, tuple(x.witness)) for x in found.edges.collect()} == drawn
    stages = {x.id: x.stage for x in found.nodes(spark.createDataFrame([(x, library[x]) for x in names], "name string, library string"), target, marks).collect()}
    assert stages[target] == 4 and all(stages[f"claim:end:{c[1]}"] == 3 for c in claims if c[2] == "end")


def test_consumption_cases(spark):
    """Ambiguous names are warnings; no claim, and claims outside the closure, give empty tables; terminal families follow the target's library."""
    decls = spark.createDataFrame([("a.x", "l", False), ("b.x", "l", False), ("t.end", "m", False)], "name string, library string, internal boolean")
    edges = spark.createDataFrame([("a.x", "t.end")], "src string, dst string")
    claims = [("c", "1", "f", "T", 1, ["q.x"], [], []), ("c", "2", "g", "U", 2, ["t.end"], [], []), ("c", "3", "g", "V", 3, ["t.end"], [], [])]
    found = consumption.analyse(edges, decls, spark.createDataFrame(claims, CLAIM), "t.end")
    assert [(x.id, x.raw, x.hits) for x in found.warnings.collect()] == [("1", "q.x", 2)]
    assert {x.id: (x.terminal, x["class"]) for x in found.claims.collect()} == {"1": (False, "none"), "2": (True, "registered-support"), "3": (True, "registered-support")}
    assert {x.id: x.downstream for x in found.downstream.collect()} == {"2": "claim:g:3", "3": "claim:g:2"}
    assert {(x.source, x.target, x.role, tuple(x.witness), x.collapsed) for x in found.edges.collect()} == {(f"claim:g:{i}", "t.end", "claim-to-target", ("t.end",), 0) for i in (2, 3)}
    empty = consumption.analyse(edges, decls, spark.createDataFrame([], CLAIM), "t.end")
    assert empty.claims.collect() == empty.edges.collect() == empty.landmarks.collect() == []
    with pytest.raises(ValueError):
        consumption.analyse(edges, decls, spark.createDataFrame(claims, CLAIM), "t.end", [], ["no such family"])
    with pytest.raises(ValueError):
        consumption.analyse(edges, decls, spark.createDataFrame(claims, CLAIM), "t.end", [consumption.Landmark("a", "l"), consumption.Landmark("a", "m")])


@pytest.mark.parametrize("seed", [3, 4])
def test_collapse(spark, seed):
    """Long chains, rings of private nodes, chains that come back to their source."""
    r = random.Random(seed)
    edges, n = set(), 0
    ends = [f"k{i}" for i in range(6)]
    for _ in range(14):
        a, b, size = r.choice(ends), r.choice(ends), r.choice([0, 1, 2, 9, 40])
        path = [a, *(f"p{n + i}" for i in range(size)), b]
        n += size
        edges |= set(zip(path, path[1:]))
    ring = [f"r{i}" for i in range(5)]
    edges |= set(zip(ring, ring[1:] + ring[:1]))
    table = spark.createDataFrame(sorted(edges), "src string, dst string")
    decls = spark.createDataFrame([(x, "l") for x in {x for e in edges for x in e}], "name string, library string")
    kept = headlines.structural_keep(table, decls, spark.createDataFrame([(e,) for e in ends], "node string"))
    keep, out = {x.node for x in kept.collect()}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    want = set()
    for a in keep:
        for b in out.get(a, ()):
            path = [a, b]
            while path[-1] not in keep:
                path.append(out[path[-1]][0])
            if path[-1] != a:
                want.add((a, path[-1], tuple(path), len(path) - 2))
    assert {(x.src, x.dst, tuple(x.witness), x.collapsed) for x in headlines.collapse(table, kept).collect()} == want
    assert headlines.collapse(table.where(F.lit(False)), kept).collect() == []


def test_fronts(spark):
    """All four verdicts; a cut search is unknown, one that came to its end independent."""
    deps = [("p.a", "p.b"), ("p.c", "q.core"), ("p.d", "q.core"), ("p.e", "s.field"), ("p.f", "s.field"), ("p.g", "h.1"), ("h.1", "h.2"), ("h.2", "h.3"), ("h.3", "h.4"), ("p.h", "p.i"), ("p.h", "lost.x")]
    names = sorted({x for e in deps for x in e if x != "lost.x"} | {"s", "z.b"})
    kind = lambda x: "structure" if x == "s" else "theorem"
    decls = spark.createDataFrame([(x, kind(x), x == "p.i") for x in names], "name string, kind string, internal boolean")
    claims = [("p.a", "p.b"), ("p.c", "p.d"), ("p.e", "p.f"), ("p.g", "p.e"), ("p.a", "nobody.zzz"), ("other.g", "q.core"), ("p.a", "x.b"), ("p.a", "p.a"), (None, "p.a"), ("p.h", "p.i"), ("p.a", "p.b")]
    got = {(x.name, x.front): (x.state, x.via, x.depth) for x in fronts.verdicts(spark.createDataFrame(claims, "name string, front string"), spark.createDataFrame(deps, "src string, dst string"), decls).collect()}
    assert got == {
        ("p.a", "p.b"): ("delegates", None, 1),
        ("p.c", "p.d"): ("shared-core", "q.core", 1),
        ("p.e", "p.f"): ("independent", None, None),  # what they share is a field of a structure
        ("p.g", "p.e"): ("unknown", None, None),  # the search below p.g was cut
        ("p.a", "nobody.zzz"): ("unknown", None, None),
        ("other.g", "q.core"): ("unknown", None, None),
        ("p.a", "x.b"): ("unknown", None, None),  # two names end in b
        ("p.a", "p.a"): ("shared-core", "p.a", 0),
        (None, "p.a"): ("unknown", None, None),
        ("p.h", "p.i"): ("delegates", None, 1),
    }


def test_field_is_the_distance_to_the_nearest(spark):
    edges = dag(random.Random(9), 20, 20)
    wanted = {"lib0.n09", "lib1.n13"}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    table = spark.createDataFrame(sorted(edges), "src string, dst string")
    ways = consumption.field(table, spark.createDataFrame([(w,) for w in wanted], "node string"))
    got = {x.node: x.distance for x in ways.collect() if x.distance is not None}
    names = {x for e in edges for x in e}
    want = {x: first_path(adj, x, wanted.__contains__, True) for x in names}
    assert got == {x: len(p) - 1 for x, p in want.items() if p}
    starts = spark.createDataFrame([(x,) for x in sorted(names)], "node string")
    assert {x.node: x.path for x in consumption.follow(starts, ways, F.lit(True)).collect()} == {x: p for x, p in want.items() if p}
    strict = {x: first_path(adj, x, wanted.__contains__, False) for x in names}
    assert {x.node: x.path for x in consumption.follow(starts, ways, F.lit(False)).collect()} == {x: p for x, p in strict.items() if p}
    assert graph.closure(table, spark.createDataFrame([], "node string")).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_nearest_against_plain(spark, seed):
    """With rings: a wanted seed doesn't count for itself, whichever way leads back."""
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(25)]
    edges = {(a, b) for a, b in (r.sample(names, 2) for _ in range(30))} | {("r1", "r2"), ("r2", "r1"), ("r2", "n03")}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    wanted = {*r.sample(names, 4), "r1"}
    want = {}
    for s in {*names, "r1", "r2"}:
        level, seen = {s}, {s}
        for n in range(1, 30):
            level = {y for x in level for y in adj.get(x, ())} - seen
            seen |= level
            if level & wanted:
                want[s] = (min(level & wanted), n)
                break
    seeds, goals = (spark.createDataFrame([(x,) for x in sorted(xs)], "node string") for xs in ({*names, "r1", "r2"}, wanted))
    got = {x.seed: (x.node, x.distance) for x in graph.nearest(spark.createDataFrame(sorted(edges), "src string, dst string"), seeds, goals).collect()}
    assert got == want


def test_roadmap(spark):
    """Exact before short names, libraries, preferred places before shallow ones, repeats, and what is nowhere."""
    suggested = spark.createDataFrame([("t", "A.x", 1), ("t", "A.x", 5), ("t", "B.y", 2), ("u", "C.z", 1), ("u", "D.gone", 2), ("u", "E.out", 3), ("u", None, 4)], "topic string, name string, nth long")
    decls = spark.createDataFrame(
        [("A.x", "Lib/a.lean", "Lib.a"), ("Q.x", "Lib/q.lean", "Lib.q"), ("P.y", "Lib/Deep/er/p.lean", "Lib.Deep.er.p"), ("R.y", "Lib/r.lean", "Lib.r"), ("S.y", "Lib/b.lean", None), ("Q.z", "Libx/z.lean", "Libx.z"), ("E.out", "Other/e.lean", "Other.e"), ("F.out", "Lib/f.lean", "Lib.f"), (None, "Lib/n.lean", "n"), ("G.y", None, "g")],
        "name string, path string, module string",
    )
    found = roadmap.delivery(suggested, decls, ("Lib/",), ("Lib.Deep",))
    assert {(x.topic, x.name): (x.nth, x.path, x.candidates) for x in found.collect()} == {
        ("t", "A.x"): (1, "Lib/a.lean", []),
        ("t", "B.y"): (2, "Lib/Deep/er/p.lean", ["Lib/Deep/er/p.lean", "Lib/b.lean", "Lib/r.lean"]),
        ("u", "C.z"): (1, None, []),
        ("u", "D.gone"): (2, None, []),
        ("u", "E.out"): (3, None, []),
    }
    assert sorted(tuple(x) for x in roadmap.topics(found).collect()) == [("t", 2, 2, 1), ("u", 3, 0, 0)]
    assert {x.path for x in roadmap.delivery(suggested, decls).where("name = 'C.z'").collect()} == {"Libx/z.lean"}
    assert roadmap.delivery(suggested.where(F.lit(False)), decls).collect() == []


def test_searches_see_only_what_lies_ahead(spark):
    """Edges behind or beside the starts are left out; rings end."""
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "a"), ("b", "t"), ("x", "t"), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("b",)], "node string")
    found = sorted((r.src, r.dst) for r in graph.ahead_of(e, start).collect())
    assert found == [("a", "b"), ("b", "c"), ("b", "t"), ("c", "a")]
    assert graph.ahead_of(e, start.where("false")).collect() == []


def test_leaves(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("q", "b"), ("r", "s"), ("s", "r"), ("z", "y")], "src string, dst string")
    wanted = spark.createDataFrame([("c",), ("s",), ("alone",), ("c",)], "node string")
    assert sorted(r.node for r in graph.leaves(e, wanted).collect()) == ["a", "alone", "q"]
