"""Further queries of the catalogue: text functions, metrics, joins, capped searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators import graph, headlines, statements
from ledgerline.plans.catalogue import FILES, IMPORTS, NEW, OLD, decls, edges, files, long, parts, query
from ledgerline.sources.projection import DECLS, EDGES, frame
from ledgerline.sources.tables import table
from ledgerline.streaming import extensions


@query(
    r"""SELECT doc_id, sha256(lower(trim(regexp_replace(replace(translate(text, '–—' || chr(160) || '~“”’', '--  ""'''), '--', '-'), '\s+', ' ', 'g')))) AS folded_sha256 FROM documents"""
)
def prose_folded(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(tx.folded(F.col("text")), 256).alias("folded_sha256"))


@query(f"SELECT name, kind = 'part' AND (module = 'part.Brand#1' OR regexp_matches(module, '^part\\.Brand#.3$')) AS hit FROM ({DECLS}) WHERE kind = 'part'")
def glob_classify(s, d):
    m = F.col("module")
    return decls(s, d).where("kind = 'part'").select("name", (tx.matches(m, "part.Brand#1") | tx.matches(m, "part.Brand#?3")).alias("hit"))


@query(f"WITH p AS (SELECT string_split(path, '/') AS x FROM {FILES}) SELECT n AS depth, array_to_string(x[len(x) - n + 1:], '/') AS suffix, count(*) AS candidates FROM p, (VALUES (1), (2), (3)) AS t(n) GROUP BY 1, 2 HAVING count(*) > 1")
def import_suffix_index(s, d):
    rows = files(s, d).select(F.explode(tx.suffixes(F.col("path"))).alias("x")).select("x.depth", "x.suffix")
    return rows.groupBy("depth", "suffix").agg(F.count(F.lit(1)).alias("candidates")).where("candidates > 1")


@query(
    f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_size % 3 AS kind FROM part), deps AS (
  SELECT k AS a, CAST(floor(k / 2) AS BIGINT) AS b, 'type' AS role FROM t WHERE k > 1
  UNION SELECT k, CAST(floor(k / 4) AS BIGINT), 'body' FROM t WHERE k > 3 AND kind <> 0 AND CAST(floor(k / 4) AS BIGINT) <> CAST(floor(k / 2) AS BIGINT)),
open(a) AS (SELECT CAST(1999 % (SELECT count(*) FROM part) AS BIGINT) UNION SELECT d.b FROM open o JOIN deps d ON d.a = o.a JOIN t ON t.k = d.b WHERE t.kind <> 0)
SELECT CAST(a AS STRING) AS src, CAST(b AS STRING) AS dst, role FROM deps WHERE a IN (SELECT a FROM open)"""
)
def statement_closure(s, d):
    """Statements laid over parts: the tree parent is in the type, the grandparent in the body; every third is a theorem and isn't unfolded."""
    p = table(s, d, "part")
    k = F.col("p_partkey")
    up = lambda n: F.floor(k / n).cast("long").cast("string")
    none = F.array().cast("array<string>")
    recs = p.select(k.cast("string").alias("name"), F.when(F.col("p_size") % 3 == 0, "theorem").otherwise("def").alias("kind"), F.when(k > 1, F.array(up(2))).otherwise(none).alias("type_deps"), F.when(k > 3, F.array(up(4))).otherwise(none).alias("body_deps"), F.lit(False).alias("boundary"), F.lit(False).alias("missing"))
    return statements.closure_edges(recs, str(1999 % p.count()))


@query(
    f"""WITH RECURSIVE imports AS ({IMPORTS}), reach(source, node) AS (SELECT 'part.' || CAST(p_partkey AS STRING), 'part.' || CAST(p_partkey AS STRING) FROM part WHERE p_size = 5
UNION SELECT r.source, i.module FROM reach r JOIN imports i ON i.dep = r.node) SELECT node AS module, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM reach GROUP BY node"""
)
def admission_closure(s, d):
    admitted = table(s, d, "part").where("p_size = 5").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))
    walked = graph.walk(frame(s, d, IMPORTS).select(F.col("dep").alias("src"), F.col("module").alias("dst")), admitted)
    return walked.groupBy(F.col("node").alias("module")).agg(F.concat_ws(",", F.array_sort(F.collect_set("seed"))).alias("sources"))


@query(
    f"""WITH RECURSIVE imports AS ({IMPORTS}), w(seed, node, n) AS (SELECT 'part.' || CAST(p_partkey AS STRING), 'part.' || CAST(p_partkey AS STRING), 0 FROM part WHERE p_size = 7 UNION SELECT w.seed, i.dep, w.n + 1 FROM w JOIN imports i ON i.module = w.node WHERE w.n < 4),
c AS (SELECT seed, node, min(n) AS n FROM w GROUP BY seed, node), m AS (SELECT l.seed AS a, r.seed AS b, l.node, l.n + r.n AS total, l.n AS n FROM c l JOIN c r ON l.node = r.node AND l.seed < r.seed)
SELECT a, b, arg_min(node, lpad(CAST(total AS STRING), 3, '0') || lpad(CAST(n AS STRING), 3, '0') || node) AS core FROM m GROUP BY a, b"""
)
def fronts_shared_core(s, d):
    """Nearest common node of two modules within four steps, the least (total, own distance, name)."""
    i = frame(s, d, IMPORTS).select(F.col("module").alias("src"), F.col("dep").alias("dst"))
    c = graph.walk(i, parts(s, d), depth=4)
    l, r = c.alias("l"), c.alias("r")
    met = l.join(r, (F.col("l.node") == F.col("r.node")) & (F.col("l.seed") < F.col("r.seed")))
    best = F.min(F.struct((F.col("l.distance") + F.col("r.distance")).alias("total"), F.col("l.distance").alias("n"), F.col("l.node").alias("core")))
    return met.groupBy(F.col("l.seed").alias("a"), F.col("r.seed").alias("b")).agg(best.alias("m")).select("a", "b", "m.core")


@query(f"SELECT o.name AS removed, n.name AS added FROM ({OLD}) o JOIN ({NEW}) n ON o.module = n.module AND right(o.name, 2) = right(n.name, 2) WHERE o.name NOT IN (SELECT name FROM ({NEW})) AND n.name NOT IN (SELECT name FROM ({OLD}))")
def rename_hints(s, d):
    old, new = frame(s, d, OLD), frame(s, d, NEW)
    gone, came = old.join(new.select("name"), "name", "left_anti"), new.join(old.select("name"), "name", "left_anti")
    tail = F.right("name", F.lit(2))
    return gone.select("module", tail.alias("tail"), F.col("name").alias("removed")).join(came.select("module", tail.alias("tail"), F.col("name").alias("added")), ["module", "tail"]).select("removed", "added")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN l.quality = 1 AND l.toxic = 1 THEN 'contradiction' ELSE 'reviewed' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def review_status(s, d):
    both = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("seen").isNull(), "unreviewed").when((F.col("quality") == 1) & (F.col("toxic") == 1), "contradiction").otherwise("reviewed").alias("status"))


@query(
    """SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100 // count(*) AS BIGINT) AS scaffold_percent, quantile_cont(l_quantity, 0.5) AS median_cost, max(l_quantity) AS max_cost FROM lineitem GROUP BY l_orderkey"""
)
def proof_metrics(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey")
    return rows.agg(F.floor(F.count_if(F.col("l_returnflag") == "R") * 100 / F.count(F.lit(1))).cast("long").alias("scaffold_percent"), F.percentile("l_quantity", 0.5).alias("median_cost"), F.max("l_quantity").alias("max_cost"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS passage FROM documents WHERE len(string_split(text, chr(10))) >= 3")
def line_slices(s, d):
    lines = F.split("text", "\n", -1)
    return table(s, d, "documents").where(F.size(lines) >= 3).select("doc_id", F.array_join(F.slice(lines, 2, 2), "\n").alias("passage"))


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS opened FROM conversations"""
)
def marker_spans(s, d):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("opened"))


@query("SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY turn, role, text)) AS tree_hash FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def source_tree_hash(s, d):
    c = table(s, d, "conversations").where("text is not null").select("conv_id", F.struct("turn", "role", "text").alias("k"))
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("k")).alias("k"))
    return listed.select("conv_id", F.sha2(F.array_join(F.transform("k", lambda x: F.sha2(x["text"], 256)), "\n"), 256).alias("tree_hash"))


@query("SELECT doc_id, CAST(strpos(text, 'tion') AS BIGINT) AS found FROM documents WHERE strpos(text, 'tion') > 0 AND NOT regexp_matches(text, '[0-9]')")
def token_locations(s, d):
    at = F.instr("text", "tion")
    return table(s, d, "documents").where((at > 0) & ~F.col("text").rlike("[0-9]")).select("doc_id", at.cast("long").alias("found"))


@query(f"WITH e AS ({EDGES}) SELECT k.name, (SELECT count(*) FROM e WHERE dst = k.name) AS in_degree, (SELECT count(*) FROM e WHERE src = k.name) AS out_degree FROM ({DECLS}) k WHERE k.kind IN ('nation', 'supplier')")
def degrees(s, d):
    e = edges(s, d)
    ends = e.select(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return decls(s, d).where("kind in ('nation', 'supplier')").select("name").join(counted, "name", "left").na.fill(0)


@query("SELECT user_id % 10 AS bucket, event_type, count(*) AS n, grouping_id(user_id % 10, event_type) AS level FROM events GROUP BY ROLLUP (user_id % 10, event_type)")
def stats_rollup(s, d):
    e = table(s, d, "events").withColumn("bucket", F.col("user_id") % 10)
    return long(e.rollup("bucket", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")), "level")


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages")
def page_imports(s, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(s, d, "pages").select("page_id", F.explode(found).alias("target"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def journal_fields(s, d):
    k = F.get_json_object("props", "$.k").cast("long") % 5
    return table(s, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH d AS ({DECLS}) SELECT module AS cluster, count(*) AS nodes FROM d GROUP BY module")
def cluster_stats_module(s, d):
    return headlines.cluster_stats(edges(s, d), decls(s, d), "module").select("cluster", "nodes")


@query("SELECT document, count(*) AS notes FROM (SELECT source AS document, unnest(regexp_extract_all(text, '(?i)(todo|license|copyright|draft)')) AS m FROM documents) GROUP BY document")
def provenance_markers(s, d):
    hits = F.regexp_count("text", F.lit("(?i)(todo|license|copyright|draft)"))
    return table(s, d, "documents").groupBy(F.col("source").alias("document")).agg(F.sum(hits).cast("long").alias("notes")).where("notes > 0")


@query(
    """WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS cluster FROM e)
SELECT min(ts) AS start, user_id, count(*) AS n FROM c GROUP BY user_id, cluster"""
)
def stream_session_clusters(s, d):
    """Streaming form of gap clusters."""
    stream = extensions.journal(s, d, table(s, d, "events").schema, "events.parquet")
    return extensions.drain(extensions.session_clusters(stream), "session_clusters").withColumn("start", F.col("start").cast("timestamp_ntz"))

