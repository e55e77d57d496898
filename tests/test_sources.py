"""Source scanning, ledger documents and policies on small texts; the semantic traps one by one."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import documents, names, policies, sources

OAK = """import Lib.Elm
public import Lib.Fir -- note
-- import Lib.No
/- import Lib.Not /- nested -/ -/
/-- says what -/
@[simp]
theorem Oak.leaf (x : Nat := 3) : "a := /- b" = x := by
  sorryful
namespace Wood
section
private lemma Wood.grain : True := trivial
def bark₁ : Nat := 2
end
theorem _root_.top : (∀ x, x = x) := by
  simp
instance : Inhabited Oak := ⟨⟩
end Wood
def after : Nat := top
"""
ELM = """/-- held -/
set_option x true
theorem grain : True := by admit
def idle : Nat := 1
"""


def files(spark, *pairs):
    return sources.scan_files(spark.createDataFrame([(f"{m.replace('.', '/')}.lean", m, t) for m, t in pairs], "path string, module string, text string"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scan(spark):
    got = files(spark, ("Lib.Oak", OAK), ("Lib.Elm", ELM), ("Lib.Nil", None))
    assert rows(got, "module", "imports", "admitted") == [("Lib.Elm", [], True), ("Lib.Nil", [], False), ("Lib.Oak", ["Lib.Elm", "Lib.Fir"], False)]
    d = sources.declarations(got).where("module = 'Lib.Oak'")
    assert rows(d, "line", "name", "kind", "private", "documented", "anonymous") == sorted([
        (6, "Oak.leaf", "theorem", False, True, False), (11, "Wood.grain", "lemma", True, False, False), (12, "Wood.bark₁", "def", False, False, False),
        (14, "top", "theorem", False, False, False), (16, sources.ANONYMOUS, "instance", False, False, True), (18, "after", "def", False, False, False)], key=str)
    assert all(len(sources.without_comments(t)[0]) == len(t) for t in (OAK, ELM, "", "/- open", 'a "\\" -- b'))
    assert rows(sources.undocumented_public(sources.declarations(got), ("Lib.Elm",)), "name") == [("idle",)]


def test_body_cut_is_outside_brackets_and_strings():
    text = 'theorem t (x : Nat := 3) {y := 2} : ":=" = s := body'
    assert text[sources.body_cut(text) :] == ":= body" and sources.body_cut("theorem t : a") == len("theorem t : a")


def test_admission_words_stand_alone(spark):
    got = files(spark, ("A", "def x := sorry'"), ("B", "def x := my.sorry"), ("C", "-- sorry\ndef x := 1"), ("D", "def x := (sorry)"))
    assert rows(got.where("admitted"), "module") == [("D",)]


def test_end_on_one_line_and_section_on_the_next(spark):
    got = sources.declarations(files(spark, ("A", "namespace N\nnamespace M\nend\nsection\ndef x := 1\nend\nend Other\ndef y := 2\nend N\ndef z := 3")))
    assert rows(got, "name") == [("N.x",), ("N.y",), ("z",)]


def test_audits(spark):
    got = files(spark, ("Lib.Oak", OAK), ("Lib.Elm", ELM), ("Lib.Fir", "import Lib.Oak\nprivate theorem idle : True := trivial\ndef after : Nat := idle"))
    d = sources.declarations(got)
    assert rows(sources.admission_report(got), "module", "own", "sources") == [("Lib.Elm", True, ["Lib.Elm"]), ("Lib.Fir", False, ["Lib.Elm"]), ("Lib.Oak", False, ["Lib.Elm"])]
    # private rows are listed, but don't make a name a duplicate
    assert rows(sources.duplicate_public_names(d), "name", "public_modules", "rows") == [("after", 2, 2)]
    assert rows(sources.private_shadows(d, sources.module_imports(got)), "module", "name", "providers") == [("Lib.Fir", "idle", ["Lib.Elm"]), ("Lib.Oak", "grain", ["Lib.Elm"])]
    summary = sources.audit_summary(got).first()
    assert (summary.modules, summary.declarations, summary.own_admission, summary.in_admission_closure, summary.duplicate_public_names) == (3, 10, 1, 3, 1)
    asked = spark.createDataFrame([("after",), ("leaf",), ("none",)], "query string")
    assert rows(sources.resolve(d, asked), "query", "name", "exact") == [("after", "after", True), ("after", "after", True), ("leaf", "Oak.leaf", False)]


def test_candidates(spark):
    long = "(x y z : Nat) (h : x + y = z) (k : y + z = x) : x + y + z = z + z"
    one = files(spark, ("A", f"theorem a1 {long} := by\n  simp\n  ring\n  omega\n  done"), ("B", f"theorem  b1 {long.replace(' : x', '  :  x')} := by\n  simp\n  ring\n  omega\n  done\nopen Foo\nstray"))
    assert rows(sources.duplicate_statements(sources.blocks(one)), "declarations", "paths") == [(2, 2)]
    alias = files(spark, ("A", f"theorem a1 {long} := by simp"), ("B", f"theorem b1 {long} := a1 x y z h k"))
    assert rows(sources.duplicate_statements(sources.blocks(alias)), "digest") == []
    assert len(rows(sources.duplicate_statements(sources.blocks(alias), forwarders=True), "digest")) == 1
    assert rows(sources.largest(sources.blocks(one), 1), "name", "body_lines") == [("a1", 5)]
    # a subscript isn't an ASCII token character: uses of x₁ count for x
    dead = files(spark, ("A", "def x : Nat := 1\ndef y : Nat := x₁\ndef y₂ : Nat := 0\nstructure tmpBox where"))
    assert rows(sources.dead_definitions(dead), "name", "count", "definitions") == [("tmpBox", 1, 1), ("y₂", 0, 1)]
    assert rows(sources.provisional_names(sources.blocks(dead)), "name", "match") == [("tmpBox", "tmp")]
    old, new = (spark.createDataFrame([(n,) for n in ns], "name string") for ns in (["A.x", "A.y"], ["B.x", "A.y", "B.z"]))
    assert rows(sources.rename_hints(old, new), "was", "now") == [("A.x", "B.x")]


def test_three_resolvers(spark):
    decls = spark.createDataFrame([("P.x", 0), ("Q.x", 1), ("x", 2), ("Q.only", 3)], "name string, pos int")
    assert dict(rows(sources.by_name(decls), "key", "name")) == {"x": "x", "only": "Q.only", "P.x": "P.x", "Q.x": "Q.x", "Q.only": "Q.only"}
    two = decls.where("name <> 'x'")
    assert dict(rows(sources.by_name(two), "key", "name"))["x"] == "P.x"  # first in the order of the index
    asked = spark.createDataFrame([("x",), ("only",), ("gone",)], "query string")
    assert rows(names.resolve_cited(asked, two), "query", "resolved", "candidates") == [("gone", None, 0), ("only", "Q.only", 1), ("x", None, 2)]
    assert names.resolve_one(decls, "x") == "x" and names.resolve_one(two, "only") == "Q.only"
    for bad in ("gone", "x"):
        with pytest.raises(names.UnresolvedError):
            names.resolve_one(two, bad)


def test_merging(spark):
    made = lambda *rs: spark.createDataFrame(rs, "name string, module string, kind string, is_prop boolean, deps array<string>")
    good = made(("a", "M.long.way", "def", None, ["x", "y"]), ("a", "Z.near", "def", True, ["y", "x", "x"]))
    merged = names.merge_declarations(good, ("is_prop",), ("kind",), ("deps",)).first()
    assert (merged["module"], merged["copies"], merged["is_prop"], merged["kind"], merged["deps"]) == ("Z.near", 2, True, "def", ["x", "y"])
    for row in (("a", "M", "theorem", None, ["x", "y"]), ("a", "M", "def", None, ["x"])):
        with pytest.raises(names.ConflictError):
            names.merge_declarations(good.unionByName(made(row)), ("is_prop",), ("kind",), ("deps",))
    eqs = spark.createDataFrame([("f", "L1", "M1"), ("f.eq_2", "L2", "M2"), ("f._eq_1", "L2", "M2"), ("f.eq_def", "L1", "M3"), ("g.eq_1", "L2", "M2"), ("f.seq_1", "L2", "M2")], "name string, library string, module string")
    moved = {r["name"]: r["module"] for r in names.reattribute_equations(eqs).collect()}
    assert moved == {"f": "M1", "f.eq_2": "M1", "f._eq_1": "M1", "f.eq_def": "M3", "g.eq_1": "M2", "f.seq_1": "M2"}


def docs(spark, *bodies):
    return spark.createDataFrame([(f"d{i}", json.dumps(b)) for i, b in enumerate(bodies)], "document string, body string")


def test_census_rules(spark):
    body = {
        "status_definitions": {"open": "", "compiled_ok": ""}, "gaps": {"g": "", "h": ""}, "blockers": {}, "semantic_alignment_definitions": {"same": ""},
        "items": [
            {"id": "a", "status": "open", "lean_declarations": ["x"], "gap_refs": ["g"]}, {"id": "a", "status": "shut", "importance": "vast"}, 7,
            {"id": " ", "status": "compiled_ok", "verification": "absent", "lean_declarations": ["x"], "title": " "}, {"id": "b", "status": "open", "verification": "proved_in_build", "lean_declarations": "x", "blocked_by": ["z"]},
            {"id": "c", "status": "open", "semantic_alignment": "x", "planned_declarations": [1]}, {"id": "d", "status": "open", "semantic_alignment": {"classification": "odd", "detail": " "}},
        ],
    }
    got = rows(documents.validate_census(docs(spark, body, {"items": []}, {"items": [], "draft": True}, {"items": 3})), "document", "level", "code", "location")
    assert got == sorted([
        ("d0", "error", "duplicate-id", "items[1]"), ("d0", "error", "status", "a"), ("d0", "error", "importance", "a"), ("d0", "error", "row-type", "items[2]"), ("d0", "error", "id", "items[3]"), ("d0", "error", "title", "#3"),
        ("d0", "error", "verification-citations", "#3"), ("d0", "error", "compiled-absent", "#3"), ("d0", "error", "lean-declarations", "b"), ("d0", "error", "verification-citations", "b"), ("d0", "error", "blocker-ref", "b"),
        ("d0", "error", "semantic-alignment", "c"), ("d0", "error", "planned-declarations", "c"), ("d0", "error", "semantic-classification", "d"), ("d0", "error", "semantic-detail", "d"), ("d0", "warning", "orphan-gap", "h"),
        ("d1", "error", "items", ""), ("d2", "warning", "items", ""), ("d3", "error", "items", "")], key=str)


def test_coverage_rules(spark):
    results = docs(spark, {"result_count": 3, "results": [{"id": "r1", "source_atom_ids": ["a1", "a9"], "status": "done"}, {"id": "r1", "source_atom_ids": ["a1", "a1"], "status": " "}]})
    atoms = docs(spark, {"atoms": [{"id": "a1", "order": 2, "formalization_result_ids": ["r1"]}, {"id": "a2", "order": 1}, {"id": "a3", "order": 2, "interpretation_support": {"result_ids": ["r7"]}}, {"order": 0}]})
    link = spark.createDataFrame([("d0", "d0")], "document string, atoms string")
    assert rows(documents.validate_coverage(results, atoms, link), "level", "code", "location") == sorted([
        ("error", "result-count", ""), ("error", "duplicate-result-id", "results[1]"), ("error", "source-atom-ids", "r1"), ("error", "result-disposition", "r1"), ("error", "result-atom-missing", "r1"),
        ("warning", "atom-order-list", "a2"), ("error", "duplicate-atom-order", "a3"), ("error", "atom-id", "atoms[3]"), ("error", "atom-order", "atoms[3]"), ("error", "atom-result-missing", "a3")], key=str)


def test_review_rules(spark):
    body = {"relation_definitions": {"same": ""}, "rows": [{"id": "a", "title": "", "clauses": [{"source_clause": "s", "lean_clause": "l", "relation": "same"}, 5, {"source_clause": " ", "lean_clause": "l", "relation": "odd"}]}, {"id": "a", "clauses": 3}, "x", {"title": "t"}]}
    got = rows(documents.validate_review(docs(spark, body)), "code", "location")
    # the clause after one that is no object keeps its own place
    assert got == sorted([("title", "a"), ("clause-type", "a.clauses[1]"), ("clause-source_clause", "a.clauses[2]"), ("relation", "a.clauses[2]"), ("duplicate-id", "a"), ("clauses", "a"), ("row-type", "rows[2]"), ("id", "rows[3]")], key=str)
    review = docs(spark, {"rows": [{"id": "a", "lean_declarations": ["x", "y"]}, {"id": "b", "source_locator": {"file": "f"}}, {"id": "z"}]})
    census = docs(spark, {"items": [{"id": "a", "lean_declarations": ["y"]}, {"id": "b"}, {"id": "q"}]})
    link = spark.createDataFrame([("d0", "d0")], "document string, census string")
    assert rows(documents.against_companion(review, census, link), "code", "location") == [("companion-declarations", "a"), ("companion-locator", "b"), ("companion-row", "z"), ("companion-unreviewed", "q")]


def test_companion_rules(spark):
    """What the review row doesn't speak of isn't compared; lists count in order; a census that can't be read is one finding."""
    review = docs(spark, {"rows": [{"id": "a"}, {"id": "b", "lean_declarations": ["x", "y"]}, {"id": "c", "lean_declarations": ["x", "y"], "source_locator": None}]}, {"rows": [{"id": "a"}]}, {"rows": []}, {"rows": [{"id": "k"}]})
    census = docs(spark, {"items": [{"id": "a", "source_locator": {"file": "f"}, "lean_declarations": ["x"]}, {"id": "b", "lean_declarations": ["y", "x"]}, {"id": "c", "lean_declarations": ["x", "y"]}]}, {"items": 5})
    census = census.unionByName(spark.createDataFrame([("bad", "{")], "document string, body string"))
    link = spark.createDataFrame([("d0", "d0"), ("d1", "d1"), ("d2", "bad"), ("d3", "nowhere")], "document string, census string")
    got = rows(documents.against_companion(review, census, link), "document", "code", "location")
    assert got == [("d0", "companion-declarations", "b"), ("d1", "companion-items", ""), ("d2", "companion-unreadable", ""), ("d3", "companion-missing", "")]


def test_cited_names(spark):
    cited = spark.createDataFrame([("r", "A.x"), ("r", "B.x"), ("r", "gone")], "row string, name string")
    decls = spark.createDataFrame([("A.x", "x"), ("A.early", "early")], "name string, short_name string")
    planned = spark.createDataFrame([("r", "A.early"), ("r", "A.later")], "row string, name string")
    assert rows(documents.cited_findings(cited, decls, planned), "code", "name") == [("declaration-missing", "gone"), ("declaration-not-exact", "B.x"), ("planned-now-exists", "A.early")]


def test_edits_of_one_document():
    doc = {"draft": True, "items": [{"id": "a", "tags": ["p"], "deep": None}]}
    documents.patch_item(doc, "a", [("deep.list[2].word", 5), ("tags.0", "q"), ("status", documents.parse_scalar("TRUE"))], ("id",))
    assert doc["items"][0] == {"tags": ["q"], "deep": {"list": [None, None, {"word": 5}]}, "status": True}
    documents.append_item(doc, {"id": "b"})
    assert doc["draft"] is False and documents.dotted_get(doc, "items[1].id") == "b"
    for bad in (lambda: documents.append_item(doc, {"id": "b"}), lambda: documents.dotted_get(doc, "items.9"), lambda: documents.dotted_set(doc, "items.word", 1), lambda: documents.patch_item(doc, "zz", [])):
        with pytest.raises(documents.PathError):
            bad()
    assert [documents.parse_scalar(t) for t in ("12", "null", '["a"]', "[a", '"s"')] == ["12", None, ["a"], "[a", "s"]


def test_import_policy(spark):
    imports = spark.createDataFrame([("App.a", "Core.x"), ("App.a", "Ext.y"), ("App.b", "Mid.m"), ("Mid.m", "Mid.n"), ("Mid.n", "Bad.z"), ("App.off", "Bad.z"), ("App.c", "Ext.y"), ("Ext.y", "Bad.z")], "module string, dep string")
    modules = spark.createDataFrame([(m,) for m in ("App.a", "App.b", "App.c", "App.off", "Core.x", "Mid.m", "Mid.n", "Bad.z")], "module string")
    groups = {"app": ["App"], "core": ["Core.*"], "bad": ["B?d.*"]}
    rules = [{"id": "allow", "source_groups": ["app"], "allow_groups": ["core"], "exceptions": ["App.off"]}, {"id": "deep", "source_groups": ["app"], "deny_groups": ["bad"], "transitive": True}]
    got = rows(policies.import_violations(imports, modules, groups, rules), "rule", "module", "imported", "path")
    # a dependency in no group breaks an allow rule; a module outside the index isn't gone through
    assert got == sorted([("allow", "App.a", "Ext.y", ["App.a", "Ext.y"]), ("allow", "App.b", "Mid.m", ["App.b", "Mid.m"]), ("allow", "App.c", "Ext.y", ["App.c", "Ext.y"]), ("deep", "App.b", "Bad.z", ["App.b", "Mid.m", "Mid.n", "Bad.z"]), ("deep", "App.off", "Bad.z", ["App.off", "Bad.z"])], key=str)


def test_import_policy_reads_edges_once_for_all_rules(spark):
    imports = spark.createDataFrame([("A.x", "B.y"), ("A.x", "A.x"), ("A.z", "C.y"), ("Q.x", "B.y"), ("A.z", "A.x"), (None, "B.y"), ("A.x", None)], "module string, dep string")
    modules = spark.createDataFrame([("A.x",), ("A.z",), ("B.y",)], "module string")
    groups = {"a": ["A"], "b": ["B"], "every": ["*"]}
    rules = [{"id": f"r{i}", "source_groups": ["a", "none"], "deny_groups": ["b", "a"]} for i in range(3)]
    found = policies.import_violations(imports, modules, groups, rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert rows(found, "rule", "module", "imported") == sorted((f"r{i}", m, d) for i in range(3) for m, d in (("A.x", "B.y"), ("A.x", "A.x"), ("A.z", "A.x")))
    # a search doesn't come back to where it began
    deep = policies.import_violations(imports, modules, groups, [{"id": "d", "source_groups": ["a"], "deny_groups": ["b"], "transitive": True}, {"id": "own", "source_groups": ["a"], "deny_groups": ["a"], "transitive": True}])
    assert rows(deep, "rule", "module", "path") == [("d", "A.x", ["A.x", "B.y"]), ("d", "A.z", ["A.z", "A.x", "B.y"]), ("own", "A.z", ["A.z", "A.x"])]


def test_other_policies(spark):
    opened = spark.createDataFrame([("L.a", "N"), ("L.a", "X.y"), ("L.b", "N.m"), ("M.a", "X")], "module string, namespace string")
    found = policies.namespace_violations(opened, [{"id": "n", "modules": ["L"], "deny": ["X"], "allow": ["N"]}, {"id": "o", "modules": ["L.b"], "allow": ["Q"]}])
    assert rows(found, "rule", "module", "namespace", "why") == [("n", "L.a", "X.y", "denied"), ("o", "L.b", "N.m", "not-allowed")]
    got = files(spark, ("A", "axiom bad : True\ndef ok := 1 -- native\ndef x := native 3"), ("B", "def y := sorry"))
    report = policies.grounding(got, sources.declarations(got), ["A.lean", "C.lean"], {"A.lean": ["N.ok", "gone"], "D.lean": ["q"]}, ["*.lean"], {"admissions": True, "axioms": True, "patterns": ["native"]})
    assert rows(report, "code", "location") == [("grounding-admission", "B.lean"), ("grounding-axiom", "A.lean:1"), ("grounding-declaration", "A.lean"), ("grounding-declaration-file", "D.lean"), ("grounding-file", "C.lean"), ("grounding-pattern", "A.lean:3")]
    records = spark.createDataFrame([(0, "A", "new"), (1, "A", "old"), (2, "Z", "new")], "pos int, module string, status string")
    assert rows(policies.staging(records, got, ["new"]), "code", "location") == [("staging-duplicate", "A"), ("staging-missing", "Z")][:1] + [("staging-module", "Z"), ("staging-status", "A")]


def test_foundations(spark):
    nodes = spark.createDataFrame([("a", "A.lean", "ok"), ("b", "A.lean", "N.ok"), ("c", "A.lean", "gone"), ("d", "Z.lean", "x"), ("a", "A.lean", "ok"), ("free", "A.lean", "ok")], "node string, file string, declaration string")
    deps = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("c", "none")], "node string, dep string")
    # all that a cycle leads to is left over, and reported as one group
    assert rows(policies.leftover(nodes, deps), "node") == [("a",), ("b",), ("c",), ("d",)]
    camps = spark.createDataFrame([(0, "k", "a"), (1, "k", "q")], "pos int, campaign string, node string")
    got = files(spark, ("A", "def ok := 1"))
    report = policies.foundations(nodes, deps, camps, got, sources.declarations(got))
    assert rows(report, "code", "location") == [("foundation-campaign-node", "k"), ("foundation-cycle", "a, b, c, d"), ("foundation-declaration", "A.lean"), ("foundation-duplicate-campaign", "k"), ("foundation-duplicate-id", "a"), ("foundation-file", "Z.lean"), ("foundation-missing-dependency", "none")]


def test_scan_grows_with_the_file():
    """Eight times the declarations take eight times as long, not 64 times."""
    def seconds(n: int) -> float:
        text = "".join(f"/-- a -/\n@[simp]\ntheorem t{i} : x = {i} := by simp\n@[simp] def d{i} := {i}\n" for i in range(n))
        start = time.process_time()
        found = sources.scan(text)[3]
        spent = time.process_time() - start
        assert [(x["line"], x["documented"]) for x in found] == [y for i in range(n) for y in ((4 * i + 2, True), (4 * i + 4, False))]
        return spent

    seconds(500)
    assert seconds(16000) < 24 * max(seconds(2000), seconds(2000))


def test_documentation_over_lines_between():
    text = "/-- a -/\n@[simp] def a := 1\n@[simp] def b := 2\nvariable x\n\ndef c := 3\ndef d := 4\n x /-- e -/\ndef e := 5\n/-- f -/\nopen F\nlocal def f := 6\n-- more\ndef g := 7\n"
    assert [(x["name"], x["line"], x["documented"]) for x in sources.scan(text)[3]] == [("a", 2, True), ("b", 3, True), ("c", 6, True), ("d", 7, False), ("e", 9, False), ("f", 12, True), ("g", 14, True)]


def test_census_summary_reads_documents_once(spark):
    from ledgerline.plans import declared

    bodies = [(1, '{"items":[{"id":"a","status":"open","lean_declarations":["x","y","x"]},{"id":"b","status":"open","verification":"absent","lean_declarations":["x"]},{"status":3,"lean_declarations":"x"}]}'), (2, '{"items":[]}'), (3, "no json"), (4, '{"items":[{"semantic_alignment":{"classification":"near"}}]}')]
    found = documents.census_summary(spark.createDataFrame(bodies, "document long, body string"))
    want = [(1, "items", "", 3), (1, "reused", "x", 3), (1, "status", "3", 1), (1, "status", "open", 2), (1, "unique_lean_declarations", "", 2), (1, "verification", "absent", 1), (4, "items", "", 1), (4, "semantic_alignment", "near", 1)]
    assert sorted(map(tuple, found.select("document", "field", "value", "n").collect())) == want
    # One read and one shuffle of the orders, whose width is the input's; a width left to Spark was that of their compressed bytes, so that one task took them all.
    plan = declared.census_summaries(spark, "/root/testdata/sf0.01")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation ") == 1
    dealt = [line for line in plan.executedPlan().toString().split("\n") if "Exchange" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
