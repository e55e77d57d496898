"""The commands on a small project read from files."""

import json

import pytest

from ledgerline import api
from ledgerline.operators import names, sources


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    rows = [
        {"name": "Wood.leaf", "module": "Lib.Oak", "kind": "theorem", "library": "Lib", "isProp": True, "sorried": True, "axioms": ["choice"], "deps": ["twig", "Wood.root", "Far.off"], "typeDeps": ["twig"]},
        {"name": "Wood.twig", "module": "Lib.Oak", "kind": "def", "library": "Lib", "deps": ["Wood.root", "Wood.twig"]},
        {"name": "Wood.root", "module": "Lib.exp.Elm", "kind": "def", "library": "Lib", "deps": ["Wood.soil"]},
        {"name": "Wood.soil", "module": "Lib.exp.Elm", "kind": "def", "library": "Base", "deps": []},
    ]
    (root / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    src = root / "src" / "Lib"
    (src / "build").mkdir(parents=True)
    (src / "Oak.lean").write_text("import Lib.Elm\nnamespace Wood\ntheorem leaf : True := by sorry\ndef twig := 1 -- root\n<<<<<<< ours\n=======\nend Wood\n")
    (src / "Elm.lean").write_text("namespace Wood\n/-- r -/\ndef root := 2\nend Wood\n")
    (src / "build" / "No.lean").write_text("def no := 1")
    (root / "c.json").write_text(json.dumps({"verification_definitions": {"absent": "", "proved_in_build": ""}, "items": [{"id": "a", "verification": "absent", "lean_declarations": ["Wood.leaf", "Wood.gone"], "planned_declarations": ["Wood.root"]}, {"id": "b", "verification": "absent", "lean_declarations": ["Wood.root"], "semantic_review": {"supporting_declarations": ["Wood.root"]}}]}))
    (root / "e.json").write_text(json.dumps({"items": [{"id": "c", "lean_declarations": ["Wood.root"]}]}))
    return api.Project.load(spark, decls=str(root / "d.jsonl"), files=str(root / "src"), censuses=str(root / "*.json"))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_declaration_commands(project):
    p = project
    assert rows(api.stubs(p), "name") == [("Wood.leaf",)] and rows(api.query(p, axiom="cho"), "name") == [("Wood.leaf",)]
    assert rows(api.rdeps(p, "root"), "name") == [("Wood.leaf",), ("Wood.twig",)] and rows(api.query(p, is_prop=False), "name") == []
    assert rows(api.stats(p), "prefix", "defs", "theorems", "stubs", "prop_stubs") == [("Lib.Oak", 1, 1, 1, 1), ("Lib.exp", 2, 0, 0, 0)]
    assert rows(api.deps(p, "leaf"), "name", "distance") == [("Wood.twig", 1), ("Wood.root", 1), ("Wood.soil", 2)]
    assert rows(api.deps(p, "leaf", library="Lib.e", depth=1), "name") == [("Wood.root",)]
    assert rows(api.axioms(p, "leaf"), "axiom") == [("choice",)] and rows(api.axioms(p, "twig"), "axiom") == [(None,)]
    assert rows(api.libs(p), "library", "declarations") == [("Base", 1), ("Lib", 3)]
    assert sorted(rows(api.promotions(p, ["exp"]), "node", "role", "consumers")) == [("Wood.root", "boundary", 2), ("Wood.soil", "support", 0)]
    assert sorted(rows(api.promotion_counts(p, ["exp"]), "kind", "role", "n")) == [("def", "boundary", 1), ("def", "support", 1)]
    assert rows(api.symbol(p, "root", "Wood.x"), "name") == [("Wood.root",)]


def test_graph_commands(project):
    p = project
    index = api.graph_index(p)
    # a self loop is no edge; a name of the consumer's namespace resolves; nothing is bound by its last component
    assert rows(index["edges"], "src", "dst") == [("Wood.root", "Wood.leaf"), ("Wood.root", "Wood.twig"), ("Wood.soil", "Wood.root"), ("Wood.twig", "Wood.leaf")]
    assert rows(index["unresolved_prefixes"], "prefix", "n") == [("Far", 1)] and rows(index["components"], "node") == []
    cut = api.graph_slice(p, ["leaf"], reduce=True)
    assert rows(cut["reduced"], "src", "dst") == [("Wood.root", "Wood.twig"), ("Wood.soil", "Wood.root"), ("Wood.twig", "Wood.leaf")]
    with pytest.raises(names.UnresolvedError):
        api.graph_slice(p, ["bark"])
    claims = p.spark.createDataFrame([("l", "Wood.leaf"), ("t", "Wood.twig")], "id string, declaration string")
    got = api.graph_headlines(p, claims)
    assert sorted(rows(got["nodes"], "node", "coverage", "depth")) == [("Wood.leaf", 1, 3), ("Wood.root", 2, 1), ("Wood.soil", 2, 0), ("Wood.twig", 2, 2)]
    assert rows(got["pairs"], "node", "da", "db") == [("Wood.root", 1, 1)] and rows(got["leaves"], "node") == [("Wood.soil",)]
    labels = p.spark.createDataFrame([("Lib", "T1"), ("Lib.exp", "T2")], "module string, theory_id string")
    seen = api.explorer(p, labels)
    assert sorted(rows(seen["nodes"], "name", "in_degree", "out_degree", "theory_id")) == [("Wood.leaf", 2, 0, "T1"), ("Wood.root", 1, 2, "T2"), ("Wood.soil", 0, 1, "T2"), ("Wood.twig", 1, 1, "T1")]
    assert rows(seen["boundary"], "name", "consumers") == [("Far.off", 1)]
    view = api.presentation(p, ["leaf", "soil", "bark"])
    assert rows(view["edges"], "src", "dst", "distance") == [("Wood.soil", "Wood.leaf", 2)] and rows(view["missing"], "query") == [("bark",)]
    with pytest.raises(names.UnresolvedError):
        api.presentation(p, ["bark"], strict=True)
    base = api.proof(p, "Wood.leaf")
    assert sorted(rows(base["libraries"], "library", "count")) == [("Base", 1), ("Lib", 2)] and sorted(rows(base["direct"], "dependency", "role")) == [("Far.off", "proof"), ("Wood.root", "proof"), ("twig", "type")]


def test_source_commands(project):
    p = project
    assert sorted(rows(p.scanned, "path", "module")) == [("Lib/Elm.lean", "Lib.Elm"), ("Lib/Oak.lean", "Lib.Oak")]
    assert rows(api.source_scan(p), "declarations", "modules", "own_admission") == [(3, 2, 1)]
    assert rows(api.source_admissions(p), "module", "own") == [("Lib.Elm", False), ("Lib.Oak", True)]
    assert rows(api.source_docstrings(p), "name") == [("Wood.leaf",), ("Wood.twig",)] and rows(api.source_snapshot(p), "name") == [("Wood.leaf",), ("Wood.root",), ("Wood.twig",)]
    old = p.spark.createDataFrame([("Old.twig", "M"), ("Wood.root", "M")], "name string, module string")
    drift = api.source_drift(p, old)
    assert rows(drift["changes"], "name", "change") == [("Old.twig", "removed"), ("Wood.leaf", "added"), ("Wood.root", "moved"), ("Wood.twig", "added")] and rows(drift["rename_hints"], "was", "now") == [("Old.twig", "Wood.twig")]
    assert rows(api.source_conflicts(p), "path", "line_no") == [("Lib/Oak.lean", 5), ("Lib/Oak.lean", 6)]
    assert rows(api.source_declaration(p, "root"), "path", "line") == [("Lib/Elm.lean", 3)]
    assert rows(api.source_dead(p), "name") == [("Wood.root",), ("Wood.twig",)]  # in a comment isn't used
    assert rows(api.source_symbol_census(p, "root"), "path", "raw", "code") == [("Lib/Elm.lean", 1, 1), ("Lib/Oak.lean", 1, 0)]
    assert rows(api.source_import_closure(p, ["Lib.Oak", "Lib.Elm"])["overlap"], "a", "b", "common") == [("Lib.Elm", "Lib.Oak", 1)]
    assert rows(api.source_module_coverage(p, ("Lib",), ["Lib.Elm"], []), "module", "status") == [("Lib.Elm", "covered"), ("Lib.Oak", "uncovered")]
    assert [r.kinds for r in api.source_profile(p).collect()] == [{"def": 1, "theorem": 1}, {"def": 1}]
    assert rows(api.ratchet_check(p, [("r", "root", "matches", 1)]), "found", "status") == [(1, "at")]
    assert rows(api.imports_check(p, {"oak": ["Lib.Oak"], "elm": ["Lib.Elm"]}, [{"id": "r", "source_groups": ["oak"], "deny_groups": ["elm"]}]), "module", "imported") == [("Lib.Oak", "Lib.Elm")]
    assert rows(api.namespace_check(p, [{"id": "n", "modules": ["Lib"], "deny": ["Wood"]}]), "module") == [("Lib.Elm",), ("Lib.Oak",)]


def test_namespaces_count_whether_or_not_anything_is_declared_in_them(spark):
    text = "/- namespace No -/\nnamespace A.B\nsection S\nnamespace C\nend C\nend S\nend A.B\nnamespace A.B\nend\nsection\nnamespace Z -- named\ndef x := 1\n"
    files = spark.createDataFrame([("p", "M", text), ("q", "N", None)], "path string, module string, text string")
    assert rows(sources.scan_files(files).orderBy("path"), "namespaces") == [(["A.B", "A.B.C", "Z"],), ([],)]


def test_ledger_commands(project):
    p = project
    assert rows(api.validate(p, "census"), "location", "code") == [("a", "verification-citations"), ("b", "verification-citations")]
    assert rows(api.xref(p), "declaration", "documents") == [("Wood.root", 2)] and rows(api.xref_of(p, "Wood.root"), "document", "row") == [("c.json", "b"), ("e.json", "c")]
    assert rows(api.search(p, "wood.G"), "declaration") == [("Wood.gone",)] and rows(api.context(p, "Wood.root"), "row", "role") == [("b", "supporting"), ("c", "listed")]
    assert sorted(rows(api.census_static(p), "code", "name")) == [("declaration-missing", "Wood.gone"), ("planned-now-exists", "Wood.root")]
    probe = p.spark.createDataFrame([("Wood.leaf", True), ("Wood.gone", False), ("Wood.root", True)], "declaration string, resolved boolean")
    assert sorted(rows(api.census_probe(p, probe), "row", "verification"), key=str) == [("a", "absent"), ("b", "proved_in_build"), ("c", None)]
    assert rows(api.workspace_status(p), "kind", "documents", "rows", "findings") == [("census", 2, 3, 2)]
    assert json.loads(api.show(p, "census", "c").first().row)["id"] == "c" and rows(api.xref_stats(p), "names", "occurrences", "documents") == [(3, 4, 2)]
    body = api.add(api.patch('{"items":[{"id":"a","x":1}]}', "a", [("y.z", "[1]")], ("x",)), {"id": "b"})
    assert json.loads(body) == {"items": [{"id": "a", "y": {"z": [1]}}, {"id": "b"}]}


def test_build_report(spark):
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(["A.lean:3:1: error: bad", "A.lean:3:1: error: bad", "A.lean:30:1: warning: odd", "[1/2] x"])], "run string, n long, line string")
    got = api.build_report(lines)
    assert rows(got["diagnostics"], "message", "repeats") == [("bad", 2), ("odd", 1)] and len(rows(got["clusters"], "cluster")) == 2 and rows(got["progress"], "done", "total") == [(1, 2)]
