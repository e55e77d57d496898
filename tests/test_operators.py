"""Small fixtures with hand-made expectations for the general operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators import graph, headlines, ledgers, logs, modules, names, statements, textaudit
from ledgerline.sources import loaders
from ledgerline.streaming import extensions


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "node string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_shortcut_reduction(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("A", "D"))
    assert rows(graph.transitive_reduction(e), "src", "dst") == [("A", "B"), ("B", "C"), ("C", "D")]


def test_cycle_reduction(spark):
    e = edges(spark, ("A", "B"), ("B", "A"), ("A", "C"), ("B", "C"), ("C", "D"), ("A", "D"))
    assert rows(graph.components(e), "node", "component") == [("A", "A"), ("B", "A")]
    assert rows(graph.transitive_reduction(e), "src", "dst") == [("A", "B"), ("A", "C"), ("B", "A"), ("C", "D")]
    assert rows(graph.layers(graph.condense(e, graph.components(e))), "node", "depth") == [("A", 0), ("C", 1), ("D", 2)]


def test_closure_and_witness(spark):
    e = edges(spark, ("soil", "root"), ("root", "stem"), ("stem", "leaf"), ("leaf", "bud"), ("bud", "fruit"), ("root", "vine"), ("vine", "leaf"))
    assert rows(graph.closure(e, nodes(spark, "leaf")), "node", "distance") == [("leaf", 0), ("root", 2), ("soil", 3), ("stem", 1), ("vine", 1)]
    path = {r.node: r.path for r in graph.witness_paths(e, nodes(spark, "root")).collect()}
    assert path["bud"] == ["root", "stem", "leaf", "bud"]
    got = rows(graph.projected_reduction(e, nodes(spark, "root", "bud", "fruit")), "src", "dst", "distance")
    assert got == [("bud", "fruit", 1), ("root", "bud", 3)]


def test_headlines(spark):
    e = edges(spark, ("shared", "a3"), ("a3", "a2"), ("a2", "A"), ("shared", "b2"), ("b2", "b1"), ("b1", "B"), ("p1", "p2"), ("p2", "C"), ("x", "y"))
    claims = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, declaration string")
    walked = headlines.dependency_walk(e, claims)
    covered = headlines.coverage(walked)
    assert {r.node for r in covered.where("shared").collect()} == {"shared"} and "x" not in {r.node for r in covered.collect()}
    assert rows(headlines.headline_stats(walked, covered), "claim", "nearest_shared") == [("a", 3), ("b", 3), ("c", None)]
    assert rows(headlines.headline_pairs(walked), "a", "b", "node", "da", "db") == [("a", "b", "shared", 3, 3)]
    assert rows(headlines.shared_frontier(e, covered), "node") == [("shared",)]


def test_pairs_take_the_least_greater_distance(spark):
    # one: distances 1 and 4 (sum 5); two: 3 and 3 (sum 6). The lesser maximum wins; a claim's own node is no common one.
    e = edges(spark, ("one", "X"), ("one", "y1"), ("y1", "y2"), ("y2", "y3"), ("y3", "Y"), ("two", "p1"), ("p1", "p2"), ("p2", "X"), ("two", "q1"), ("q1", "q2"), ("q2", "Y"), ("X", "Z"))
    walked = headlines.dependency_walk(e, spark.createDataFrame([("x", "X"), ("y", "Y"), ("z", "Z")], "id string, declaration string"))
    got = {(r.a, r.b): (r.node, r.da, r.db) for r in headlines.headline_pairs(walked).collect()}
    assert got[("x", "y")] == ("two", 3, 3) and got[("x", "z")] == ("one", 1, 2)


def test_cluster_figures_read_edges_once(spark):
    e = edges(spark, ("a1", "a2"), ("a1", "b1"), ("a2", "b1"), ("b1", "a2"), ("b1", "none"), ("gone", "a1"))
    decls = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C"), ("d1", None)], "name string, library string")
    found = headlines.cluster_stats(e, decls, "library")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    assert rows(found.na.fill("-"), "cluster", "nodes", "internal", "incoming", "outgoing") == [("-", 1, 0, 0, 0), ("A", 2, 1, 1, 2), ("B", 1, 0, 2, 1), ("C", 1, 0, 0, 0)]


def test_edges_by_consumer_are_the_edges(spark):
    from ledgerline.sources.projection import EDGES, consumed, frame

    folder = "/root/testdata/sf0.001"
    by, plain = consumed(spark, folder), frame(spark, folder, EDGES)
    assert by.count() == plain.count() and by.exceptAll(plain).isEmpty() and plain.exceptAll(by).isEmpty()


def test_what_a_walk_knows_is_broadcast_only_up_to_a_bound(spark, monkeypatch):
    e, plans = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(6)], ("n6", "n2")), []
    kept = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, tag))
    want = [(f"n{i}", i - 1) for i in range(1, 7)]
    assert rows(graph.walk(e, nodes(spark, "n1")), "node", "distance") == want and any("BroadcastHashJoin" in p and "LeftAnti" in p for p in plans)
    monkeypatch.setattr(graph, "SENT", 2)
    plans.clear()
    assert rows(graph.walk(e, nodes(spark, "n1")), "node", "distance") == want
    anti = [line for p in plans for line in p.split("\n") if "LeftAnti" in line]
    assert ["SortMergeJoin" in line for line in anti] == [False, False, True, True, True, True]


def test_promotion(spark):
    e = edges(spark, ("gate", "Out.a"), ("gate", "In.b"), ("beam", "gate"), ("sand", "gate"))
    got = headlines.promotion(e, nodes(spark, "gate", "beam", "idle"))
    assert rows(got, "node", "role", "consumers") == [("beam", "support", 0), ("gate", "boundary", 2)]
    assert rows(headlines.promotion(e, nodes(spark, "gate", "beam"), ("Ou",)), "node", "consumers") == [("beam", 0), ("gate", 1)]
    assert rows(headlines.promotion(e, nodes(spark, "gate", "beam"), ("Else",)), "node") == []


def test_resolution(spark):
    decls = spark.createDataFrame([("Top.Mid.low",), ("Top.Mid.use.low",), ("Top.here",), ("Top.Mid.use",)], "name string")
    refs = spark.createDataFrame([("Top.Mid.use", "low"), ("Top.Mid.use", "Far.here"), ("Top.Mid.use", "here"), ("Else.x", "here"), ("here", "low")], "consumer string, reference string")
    got = {(r.consumer, r.reference): r.resolved for r in names.resolve(refs, decls).collect()}
    # the consumer's own name is no namespace of its
    assert got == {("Top.Mid.use", "low"): "Top.Mid.low", ("Top.Mid.use", "Far.here"): None, ("Top.Mid.use", "here"): "Top.here", ("Else.x", "here"): None, ("here", "low"): None}


def test_statement_closure(spark):
    d = lambda n, k, t=(), b=(), **x: {"name": n, "kind": k, "type_deps": list(t), "body_deps": list(b), "boundary": False, "missing": False, "flags": [], "type": n, "type_expr_hash": "h" + n, **x}
    recs = [d("seed", "theorem", ["IsGood", "Dense"], ["proof_only"]), d("IsGood", "def", ["GoodData"], ["instLE", "helper"]), d("GoodData", "inductive", ["mk"]), d("mk", "ctor", ["GoodData"]), d("Dense", "def", ["deep"], boundary=True), d("instLE", "def", flags=["instance"]), d("helper", "theorem", ["deep"]), d("proof_only", "def")]
    schema = "name string, kind string, type_deps array<string>, body_deps array<string>, boundary boolean, missing boolean, flags array<string>, type string, type_expr_hash string"
    df = spark.createDataFrame(recs, schema)
    got = dict(rows(statements.closure_summary(df, "seed"), "name", "part"))
    assert got == {"IsGood": "unfolded", "Dense": "boundary", "GoodData": "unfolded", "mk": "plumbing", "instLE": "plumbing", "helper": "leaf"}
    pins = spark.createDataFrame([("seed", "hseed", "0"), ("IsGood", "old", "0"), ("lost", "h", "0")], "declaration string, type_expr_hash string, type_text_sha256 string")
    claimed = spark.createDataFrame([("seed",), ("mk",)], "declaration string")
    assert dict(rows(statements.pin_states(pins, df, claimed), "declaration", "status")) == {"seed": "text-drift", "IsGood": "statement-drift", "lost": "declaration-gone", "mk": "unpinned"}


def test_comments(spark):
    source = "a /- x /- y -/ z\n-/ b -- c /- d\ne"
    got = textaudit.strip_nested(spark.createDataFrame([("p", source)], "path string, text string")).first().text
    assert len(got) == len(source) and got.split() == ["a", "b", "e"] and got.count("\n") == 2


def test_text_functions(spark):
    one = spark.createDataFrame([("Dk — “x”~y--z ‘q’", "import A B\npublic import C.D\n  import all E\nimportant", "dir/sub/f.lean")], "a string, b string, c string")
    r = one.select(tx.folded(F.col("a")).alias("a"), tx.imports(F.col("b")).alias("b"), F.transform(tx.suffixes(F.col("c")), lambda x: x["suffix"]).alias("c"), tx.excerpt(F.col("b"), F.lit("C.D"), 3).alias("e")).first()
    assert r.a == "dk - \"x\" y-z ‘q'" and r.b == ["A", "B", "C.D", "E"] and r.c == ["f.lean", "sub/f.lean", "dir/sub/f.lean"] and r.e == "…rt C.D\n  …"
    import re

    assert re.match(tx.glob_pattern("a.*[0-9]?"), "a.b.c1x") and not re.match(tx.glob_pattern("a.b"), "axb")


def test_logs(spark):
    lines = ["error: Lib/Oak.lean:12:4: no such leaf", "said more", "Elm.lean:5:6: warning: dry", "[40/41] x", "[9/8]"]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    assert rows(logs.parse_headers(df), "severity", "file", "line_no") == [("error", "Lib/Oak.lean", 12), ("warning", "Elm.lean", 5)]
    assert [(r.done, r.total) for r in logs.progress(df).orderBy("n").collect()] == [(40, 41), (None, None)]
    pos = spark.createDataFrame([("f", 1), ("f", 3), ("f", 20), ("g", 5)], "file string, at long")
    assert rows(logs.gap_clusters(pos, "file", "at", 5), "file", "n", "first", "last") == [("f", 1, 20, 20), ("f", 2, 1, 3), ("g", 1, 5, 5)]


def test_whole_logs(spark):
    said = ["hello", "\x1b[31merror: Oak.lean:1:2: first\r", "", "  detail", "", "info: plain news", "more", "✔ [3/9] Built Oak", "after", "error: build failed", "Some required targets logged failures:", "- Oak", " - Elm", "- x"]
    said += ["tail", "- not listed", "Elm.lean:7:8: warning: second", "body"]
    found, role = logs.parse_output(spark.createDataFrame([("r", i, x) for i, x in enumerate(said)], "run string, n long, line string"))
    assert rows(found, "ordinal", "n", "severity", "file", "line_no", "col", "message", "body") == [
        (1, 1, "error", "Oak.lean", 1, 2, "first", ["  detail"]), (2, 5, "info", None, None, None, "plain news", ["more"]), (3, 16, "warning", "Elm.lean", 7, 8, "second", ["body"])]
    got = [r.role for r in role.orderBy("n").collect()]
    assert got == ["other", "header", "body", "body", "body", "header", "body", "synthetic", "other"] + ["synthetic"] * 5 + ["other", "other", "header", "body"]
    twice = found.unionByName(found.withColumn("run", F.lit("s")))
    assert rows(logs.deduplicate_diagnostics(twice), "message", "repeats", "runs")[0] == ("first", 2, ["r", "s"])


def test_ledgers(spark):
    state = spark.createDataFrame([("all", "x"), ("some", None), ("none", "x"), ("off", "not_applicable"), ("bare", "x")], "row string, verification string")
    refs = spark.createDataFrame([("all", "up"), ("some", "up"), ("some", "down"), ("none", "down"), ("off", "up"), ("bare", "unasked")], "row string, declaration string")
    probe = spark.createDataFrame([("up", True), ("down", False)], "declaration string, resolved boolean")
    assert dict(rows(ledgers.apply_probe(state, refs, probe), "row", "verification")) == {"all": "proved_in_build", "some": "partially_in_build", "none": "absent", "off": "not_applicable", "bare": "x"}
    assert dict(rows(ledgers.apply_probe(state, refs, probe, ("partially_in_build",)), "row", "verification")) == {"all": "partially_in_build", "some": "partially_in_build", "none": "x", "off": "not_applicable", "bare": "x"}
    imports = spark.createDataFrame([("M2", "M1"), ("M3", "M2")], "module string, dep string")
    seeds = spark.createDataFrame([(1, "M2"), (2, "M3")], "rung int, node string")
    assert dict(rows(modules.rungs(imports, seeds), "node", "rung")) == {"M1": 1, "M2": 1, "M3": 2}


def test_loaders(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"name":"A.b","module":"M","kind":"theorem","isProp":null,"deps":["x"]}\n\n{"name":"A.c","module":"M","kind":"def","isProp":true}\n')
    got = {r.name: (r.is_prop, r.deps, r.internal) for r in loaders.declarations(spark, str(tmp_path / "d.jsonl")).collect()}
    assert got == {"A.b": (None, ["x"], False), "A.c": (True, [], False)}
    (tmp_path / "graph_theory-census.json").write_text(json.dumps({"items": [{"id": "H", "importance": "headline", "lean_declarations": ["p"]}, {"id": "M", "importance": "major"}]}))
    claims = loaders.census_claims(spark, str(tmp_path / "graph_theory-census.json"), ["headline"]).collect()
    assert [(c.id, c.family, c.has_explicit) for c in claims] == [("H", "Graph Theory", False)]
    (tmp_path / "log").write_bytes(b"\x1eabc\x1f2024-05-01T10:00:00+02:00\x1fAnn\x1fa@x\x1fsubject\x1fbody\nCo-authored-by: Bo <b@x>\x1f\n3\t1\tf.lean\n-\t-\tp.png\n")
    c = loaders.history(spark, str(tmp_path / "log"))
    r = c.first()
    assert (r.commit, r.additions, r.deletions, r.binary_files, r.files) == ("abc", 3, 1, 1, ["f.lean", "p.png"]) and str(r.ts) == "2024-05-01 08:00:00"
    assert rows(loaders.coauthors(c), "name", "email") == [("Bo", "b@x")]
    (tmp_path / "j.jsonl").write_text('{"at":"2024-01-02","document":"a"}\nnot json\n{"at":"2024-01-03","document":"b"}\n')
    assert [r.document for r in loaders.journal(spark, str(tmp_path / "j.jsonl"), 1).collect()] == ["b"]


@pytest.mark.parametrize("what", ["sessions"])
def test_streams(spark, what):
    folder = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    out = extensions.drain(extensions.session_clusters(extensions.journal(spark, folder, schema, "events.parquet")), "clusters")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{folder}/events.parquet").count()


def test_excerpts_of_every_length(spark):
    said = "It was the Best of times,  it was\nthe worst of times, and then some more words came."
    texts = {"a": said, "b": "the worst", "c": "times", "d": "", "e": "unrelated text of a good many words that holds no such thing"}
    flat = {p: " ".join(t.split()) for p, t in texts.items()}
    given = flat["a"].split()
    quotes = [" ".join(given[i : i + n]) for n in range(1, 9) for i in range(len(given) - n + 1)]
    quotes += ["est of times, it w", "as the B", "imes, i", "mes", "no such words", "of a good many words that holds no such thin"]
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, text string")
    got = {(r.quote_id, r.path) for r in textaudit.excerpts(asked, files).collect()}
    assert got == {(i, p) for i, q in enumerate(quotes) for p, t in flat.items() if q in t}
    odd = files.unionByName(spark.createDataFrame([("n", None), (None, said), ("again", said)], "path string, text string"))
    more = asked.unionByName(spark.createDataFrame([(99, None), (None, "times"), (98, "")], "quote_id long, text string"))
    whole = {(r.quote_id, r.path) for r in textaudit.excerpts(more, odd, whole=True).collect()}
    flat["again"] = flat["a"]
    assert whole == {(i, p) for i, q in [*enumerate(quotes), (98, "")] for p, t in flat.items() if f" {q} " in f" {t} "}


def test_reduction_of_random_graphs(spark):
    r = random.Random(11)
    edges = {tuple(sorted(r.sample(range(14), 2))) for _ in range(40)}
    after = {a: {b for x, b in edges if x == a} for a in range(14)}

    def below(a, seen):
        for b in after[a] - seen:
            seen.add(b)
            below(b, seen)
        return seen

    want = {(a, b) for a, b in edges if not any(b in below(x, set()) for x in after[a] - {b})}
    got = graph.dag_reduction(spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in edges], "src string, dst string")).collect()
    assert {(int(x.src), int(x.dst)) for x in got} == want and len(want) < len(edges)
