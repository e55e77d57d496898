"""The registered queries over the driver tables, and their DuckDB oracles.

A query is a function (spark, sf_dir) -> DataFrame built from the operators; its oracle is
plain SQL over the same tables through the same projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.operators import graph, headlines, ledgers, logs, modules, names, textaudit
from ledgerline.sources.projection import CLAIMS, CYCLIC, DECLS, EDGES, PART_EDGES, consumed, frame
from ledgerline.sources.tables import table
from ledgerline.streaming import extensions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def decls(s, d):
    return frame(s, d, DECLS)


def edges(s, d):
    return frame(s, d, EDGES)


def part_edges(s, d):
    return frame(s, d, PART_EDGES)


def claims(s, d):
    return frame(s, d, CLAIMS)


def targets(s, d):
    return claims(s, d).select(F.col("declaration").alias("node"))


def parts(s, d):
    return table(s, d, "part").where("p_size = 7").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))


def every_part(s, d):
    return table(s, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))


def files(s, d):
    return table(s, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text", "doc_id", "source", "lang")


FILES = "(SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) AS path, text, doc_id, source, lang FROM documents)"
UP = f"""WITH RECURSIVE edges AS ({EDGES}), claims AS ({CLAIMS}), walked(claim, node, distance) AS (
  SELECT id, declaration, 0 FROM claims UNION SELECT w.claim, e.src, w.distance + 1 FROM walked w JOIN edges e ON e.dst = w.node WHERE w.distance < 8
), cover AS (SELECT claim, node, min(distance) AS distance FROM walked GROUP BY claim, node),
covered AS (SELECT node, count(*) AS coverage FROM cover GROUP BY node)"""
#: The orders' ancestors reach the whole part tree, deeper than the cap above; parts are followed by halves, so distances come from BFS levels.
PART_UP = f"""WITH RECURSIVE edges AS ({PART_EDGES}), walked(node, distance) AS (
  SELECT 'part.' || CAST(p_partkey AS STRING), 0 FROM part WHERE p_size = 7
  UNION SELECT e.src, w.distance + 1 FROM walked w JOIN edges e ON e.dst = w.node
)"""
UP = UP.replace("WHERE w.distance < 8", "WHERE w.distance < 40")


# -- declarations ---------------------------------------------------------------------------------


@query(f"SELECT name, module, library FROM ({DECLS}) WHERE kind = 'customer' AND (module = 'customer.BUILDING' OR module LIKE 'customer.BUILDING.%')")
def decl_filter(s, d):
    return names.filter_decls(decls(s, d), kind="customer", module="customer.BUILDING").select("name", "module", "library")


@query(f"SELECT dst AS name FROM ({EDGES}) WHERE src = 'part.7' AND starts_with(dst, 'orders.')")
def decl_uses(s, d):
    return edges(s, d).where((F.col("src") == "part.7") & F.col("dst").startswith("orders.")).select(F.col("dst").alias("name"))


@query(f"SELECT module AS prefix, count(*) AS total, CAST(sum(CASE WHEN kind = 'part' THEN 1 ELSE 0 END) AS BIGINT) AS parts FROM ({DECLS}) GROUP BY module")
def stats_prefix(s, d):
    return decls(s, d).groupBy(names.module_prefix(F.col("module"), 2).alias("prefix")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "part").alias("parts"))


@query(f"SELECT src AS dependency FROM ({EDGES}) WHERE dst = 'orders.7'")
def deps_direct(s, d):
    return edges(s, d).where("dst = 'orders.7'").select(F.col("src").alias("dependency"))


@query(f"SELECT dst AS consumer, count(*) OVER () AS consumers FROM ({EDGES}) WHERE src = 'supplier.3'")
def rdeps(s, d):
    found = edges(s, d).where("src = 'supplier.3'").select(F.col("dst").alias("consumer"))
    return found.withColumn("consumers", F.lit(found.count()).cast("long"))


@query(EDGES)
def graph_edges(s, d):
    return edges(s, d)


@query(f"SELECT split_part(e.src, '.', 1) AS prefix, count(*) AS unresolved FROM ({EDGES}) e WHERE NOT EXISTS (SELECT 1 FROM ({DECLS}) k WHERE k.name = e.src AND k.kind <> 'supplier') GROUP BY 1")
def unresolved_prefix_counts(s, d):
    known = decls(s, d).where("kind <> 'supplier'").select(F.col("name").alias("src"))
    return ledgers.missing(edges(s, d), known, "src").groupBy(F.substring_index("src", ".", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("unresolved"))


@query(
    f"""WITH refs AS (SELECT 'part.' || CAST(p_partkey AS STRING) AS consumer, CAST(p_partkey + 1 AS STRING) AS reference FROM part UNION SELECT 'part.' || CAST(p_partkey AS STRING), 'region.1' FROM part)
SELECT consumer, reference, CASE WHEN EXISTS (SELECT 1 FROM ({DECLS}) k WHERE k.name = reference) THEN reference
  WHEN EXISTS (SELECT 1 FROM ({DECLS}) k WHERE k.name = 'part.' || reference) THEN 'part.' || reference END AS resolved FROM refs"""
)
def name_resolution(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("consumer"), (F.col("p_partkey") + 1).cast("string").alias("reference"))
    return names.resolve(p.unionByName(p.withColumn("reference", F.lit("region.1"))), decls(s, d))


@query(
    """WITH twice AS (SELECT 'o.' || CAST(o_orderkey % 500 AS STRING) AS name, 'm.' || o_orderpriority AS module FROM orders UNION ALL SELECT 'o.' || CAST(o_orderkey % 500 AS STRING), 'm.x.' || o_orderstatus FROM orders)
SELECT name, arg_min(module, CAST(len(module) - len(replace(module, '.', '')) AS STRING) || lpad(CAST(len(module) AS STRING), 4, '0') || module) AS module, count(*) AS copies FROM twice GROUP BY name"""
)
def merge_declarations(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("o."), (F.col("o_orderkey") % 500).cast("string")).alias("name"), "o_orderpriority", "o_orderstatus")
    both = o.select("name", F.concat(F.lit("m."), "o_orderpriority").alias("module")).unionByName(o.select("name", F.concat(F.lit("m.x."), "o_orderstatus").alias("module")))
    return names.merge_declarations(both)


# -- graph ----------------------------------------------------------------------------------------


@query(f"{UP} SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM cover GROUP BY node")
def closure_targets(s, d):
    return long(graph.closure(edges(s, d), targets(s, d)), "distance")


@query(f"{UP} SELECT e.src, e.dst FROM edges e WHERE e.dst IN (SELECT node FROM covered)")
def closure_edges(s, d):
    e = edges(s, d)
    return graph.induced(e, graph.closure(e, targets(s, d)))


@query(f"SELECT DISTINCT src AS node FROM ({EDGES}) WHERE dst IN (SELECT declaration FROM ({CLAIMS})) UNION SELECT declaration FROM ({CLAIMS})")
def closure_depth1(s, d):
    return graph.closure(edges(s, d), targets(s, d), depth=1).select("node")


@query(f"{PART_UP} SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM walked GROUP BY node")
def distance_to_targets(s, d):
    return long(graph.closure(part_edges(s, d), parts(s, d)), "distance")


@query(
    f"""WITH RECURSIVE edges AS ({PART_EDGES}), walked(node, path, n) AS (
  SELECT 'part.1', ['part.1'], 0 UNION ALL SELECT e.dst, list_append(w.path, e.dst), w.n + 1 FROM walked w JOIN edges e ON e.src = w.node
), best AS (SELECT node, min(n) AS n FROM walked GROUP BY node)
SELECT w.node, array_to_string(min(w.path), '>') AS path FROM walked w JOIN best b ON w.node = b.node AND w.n = b.n GROUP BY w.node"""
)
def shortest_witness(s, d):
    one = s.range(1).select(F.lit("part.1").alias("node"))
    return graph.witness_paths(part_edges(s, d), one).select("node", F.array_join("path", ">").alias("path"))


@query(
    f"""WITH RECURSIVE edges AS ({PART_EDGES}), walked(seed, node, n) AS (
  SELECT 'part.' || CAST(p_partkey AS STRING), 'part.' || CAST(p_partkey AS STRING), 0 FROM part
  UNION SELECT w.seed, e.dst, w.n + 1 FROM walked w JOIN edges e ON e.src = w.node
), hit AS (SELECT seed, n, node FROM walked WHERE n > 0 AND node IN (SELECT 'part.' || CAST(p_partkey AS STRING) FROM part WHERE p_brand = 'Brand#13'))
SELECT seed, arg_min(node, lpad(CAST(n AS STRING), 4, '0') || node) AS node, CAST(min(n) AS BIGINT) AS distance FROM hit GROUP BY seed"""
)
def nearest_predicate(s, d):
    wanted = table(s, d, "part").where("p_brand = 'Brand#13'").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))
    return long(graph.nearest(part_edges(s, d), every_part(s, d), wanted), "distance")


@query(
    f"""WITH RECURSIVE edges AS ({CYCLIC}), reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b),
mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
SELECT a AS node, min(b) AS component FROM mutual GROUP BY a HAVING count(*) > 1"""
)
def scc_members(s, d):
    return graph.components(frame(s, d, CYCLIC))


@query(
    f"""WITH RECURSIVE edges AS ({PART_EDGES}), walked(node, depth) AS (
  SELECT DISTINCT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, w.depth + 1 FROM walked w JOIN edges e ON e.src = w.node)
SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM walked GROUP BY node"""
)
def topo_depth(s, d):
    return long(graph.layers(part_edges(s, d)), "depth")


REACH = f"""WITH RECURSIVE edges AS ({PART_EDGES}), reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b)"""


@query(f"{REACH} SELECT src, dst FROM edges x WHERE NOT EXISTS (SELECT 1 FROM edges y JOIN reach r ON r.a = y.dst WHERE y.src = x.src AND r.b = x.dst)")
def transitive_reduction(s, d):
    return graph.transitive_reduction(part_edges(s, d))


@query(
    f"""{REACH}, keep AS (SELECT 'part.' || CAST(p_partkey AS STRING) AS node FROM part WHERE p_brand < 'Brand#2'),
among AS (SELECT a, b FROM reach WHERE a IN (SELECT node FROM keep) AND b IN (SELECT node FROM keep) AND a <> b)
SELECT a AS src, b AS dst FROM among x WHERE NOT EXISTS (SELECT 1 FROM among y JOIN among z ON y.b = z.a WHERE y.a = x.a AND z.b = x.b)"""
)
def projected_reduction(s, d):
    keep = table(s, d, "part").where("p_brand < 'Brand#2'").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))
    return graph.projected_reduction(part_edges(s, d), keep).select("src", "dst")


# -- headlines ------------------------------------------------------------------------------------


@query(f"{UP} SELECT node, coverage, coverage >= 2 AS shared FROM covered")
def headline_coverage(s, d):
    return headlines.coverage(headlines.dependency_walk(edges(s, d), claims(s, d)))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The dependency union of the claims: coverage of each node, whether it is shared, whether it lies on the shared frontier."""
    e = edges(s, d)
    covered = headlines.coverage(headlines.dependency_walk(e, claims(s, d)))
    front = headlines.shared_frontier(e, covered).select("node", F.lit(True).alias("frontier"))
    return covered.join(front, "node", "left").select("node", "coverage", "shared", F.coalesce("frontier", F.lit(False)).alias("frontier")).orderBy("node")


@query(f"{UP} SELECT DISTINCT e.src AS node, a.coverage FROM edges e JOIN covered a ON e.src = a.node JOIN covered b ON e.dst = b.node WHERE a.coverage >= 2 AND b.coverage < a.coverage")
def shared_frontier(s, d):
    e = edges(s, d)
    return headlines.shared_frontier(e, headlines.coverage(headlines.dependency_walk(e, claims(s, d))))


@query(
    f"""{UP} SELECT c.claim, count(*) FILTER (c.distance > 0) AS dependencies, count(*) FILTER (c.distance > 0 AND v.coverage < 2) AS exclusive,
count(*) FILTER (c.distance > 0 AND v.coverage >= 2) AS shared, CAST(min(c.distance) FILTER (c.distance > 0 AND v.coverage >= 2) AS BIGINT) AS nearest_shared
FROM cover c JOIN covered v ON c.node = v.node GROUP BY c.claim"""
)
def headline_stats(s, d):
    walked = headlines.dependency_walk(edges(s, d), claims(s, d))
    return long(headlines.headline_stats(walked, headlines.coverage(walked)), "nearest_shared")


@query(
    f"""{UP}, met AS (SELECT l.claim AS a, r.claim AS b, l.node, l.distance AS da, r.distance AS db FROM cover l JOIN cover r ON l.node = r.node AND l.claim < r.claim
  JOIN claims x ON x.id = l.claim JOIN claims y ON y.id = r.claim WHERE l.node <> x.declaration AND l.node <> y.declaration),
best AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY greatest(da, db), da + db, node) AS nth, count(*) OVER (PARTITION BY a, b) AS common FROM met)
SELECT a, b, node, CAST(da AS BIGINT) AS da, CAST(db AS BIGINT) AS db, common FROM best WHERE nth = 1"""
)
def headline_pairs(s, d):
    return long(headlines.headline_pairs(headlines.dependency_walk(edges(s, d), claims(s, d))), "da", "db")


@query(f"{UP} SELECT node FROM cover GROUP BY node HAVING node NOT IN (SELECT dst FROM edges)")
def leaf_realizations(s, d):
    return graph.leaves(edges(s, d), targets(s, d))


@query(f"{UP} SELECT c.claim, k.library, count(*) AS nodes FROM cover c JOIN ({DECLS}) k ON k.name = c.node GROUP BY c.claim, k.library")
def closure_library_counts(s, d):
    return headlines.library_counts(headlines.dependency_walk(edges(s, d), claims(s, d)), decls(s, d))


@query(
    f"""WITH edges AS ({EDGES}), d AS ({DECLS}), ends AS (
  SELECT e.src AS node, 0 AS i, 1 AS o, CASE WHEN a.library <> b.library THEN 1 ELSE 0 END AS x FROM edges e JOIN d a ON a.name = e.src JOIN d b ON b.name = e.dst
  UNION ALL SELECT e.dst, 1, 0, CASE WHEN a.library <> b.library THEN 1 ELSE 0 END FROM edges e JOIN d a ON a.name = e.src JOIN d b ON b.name = e.dst)
SELECT node FROM ends GROUP BY node HAVING sum(i) <> 1 OR sum(o) <> 1 OR max(x) = 1"""
)
def structural_keep(s, d):
    return headlines.structural_keep(edges(s, d), decls(s, d), targets(s, d))


@query(
    f"""WITH e AS ({EDGES}), p AS (SELECT a.library AS sc, b.library AS dc, count(*) AS n FROM e JOIN ({DECLS}) a ON a.name = e.src JOIN ({DECLS}) b ON b.name = e.dst GROUP BY 1, 2)
SELECT k.library AS cluster, count(*) AS nodes, CAST(coalesce((SELECT sum(n) FROM p WHERE sc = k.library AND dc = k.library), 0) AS BIGINT) AS internal,
CAST(coalesce((SELECT sum(n) FROM p WHERE dc = k.library AND sc <> k.library), 0) AS BIGINT) AS incoming, CAST(coalesce((SELECT sum(n) FROM p WHERE sc = k.library AND dc <> k.library), 0) AS BIGINT) AS outgoing
FROM ({DECLS}) k GROUP BY k.library"""
)
def cluster_stats_library(s, d):
    return headlines.cluster_stats(consumed(s, d), decls(s, d), "library")


@query(
    f"""SELECT src AS node, count(DISTINCT dst) AS consumers FROM ({EDGES}) WHERE starts_with(src, 'supplier.') AND NOT starts_with(dst, 'supplier.') GROUP BY src"""
)
def boundary_consumers(s, d):
    tagged = decls(s, d).where("kind = 'supplier'").select(F.col("name").alias("node"))
    return headlines.promotion(edges(s, d), tagged).where("role = 'boundary'").select("node", "consumers")


PROMOTION = f"""WITH RECURSIVE edges AS ({EDGES}), tagged AS (SELECT name AS node FROM ({DECLS}) WHERE kind = 'nation' OR kind = 'region' OR module = 'customer.BUILDING'),
boundary AS (SELECT src AS node, count(DISTINCT dst) AS consumers FROM edges WHERE src IN (SELECT node FROM tagged) AND dst NOT IN (SELECT node FROM tagged) GROUP BY src),
below(node) AS (SELECT node FROM boundary UNION SELECT e.src FROM below b JOIN edges e ON e.dst = b.node WHERE e.src IN (SELECT node FROM tagged))"""


def _promotion(s, d):
    tagged = decls(s, d).where("kind in ('nation', 'region') or module = 'customer.BUILDING'").select(F.col("name").alias("node"))
    return headlines.promotion(edges(s, d), tagged)


@query(f"{PROMOTION} SELECT node, consumers FROM boundary")
def promotion_boundary(s, d):
    return _promotion(s, d).where("role = 'boundary'").select("node", "consumers")


@query(f"{PROMOTION} SELECT node FROM below WHERE node NOT IN (SELECT node FROM boundary)")
def promotion_support(s, d):
    return _promotion(s, d).where("role = 'support'").select("node")


@query(f"SELECT name, CASE WHEN kind = 'part' THEN 'catalogue' WHEN kind IN ('region', 'nation') THEN 'geography' ELSE 'other' END AS foundation FROM ({DECLS})")
def foundation_labels(s, d):
    n = F.col("name")
    geography = names.under(n, "region") | names.under(n, "nation")
    return decls(s, d).select("name", F.when(names.under(n, "part"), "catalogue").when(geography, "geography").otherwise("other").alias("foundation"))


# -- ledgers --------------------------------------------------------------------------------------

OLD = "SELECT 'c.' || CAST(c_custkey AS STRING) AS name, c_mktsegment AS module FROM customer WHERE c_custkey % 5 <> 0"
NEW = "SELECT 'c.' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 11 = 0 THEN 'moved' ELSE c_mktsegment END AS module FROM customer WHERE c_custkey % 7 <> 0"


@query(
    f"""SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'moved' END AS change
FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.module <> n.module"""
)
def drift_added_removed_moved(s, d):
    return ledgers.drift(frame(s, d, OLD), frame(s, d, NEW))


@query(
    """WITH f AS (SELECT CAST(doc_id AS STRING) AS key FROM labels WHERE toxic = 1), a AS (SELECT CAST(doc_id AS STRING) AS key FROM labels WHERE quality = 0)
SELECT coalesce(f.key, a.key) AS key, CASE WHEN a.key IS NULL THEN 'new' WHEN f.key IS NULL THEN 'stale' ELSE 'accepted' END AS status FROM f FULL JOIN a ON f.key = a.key"""
)
def baseline_partition(s, d):
    labels = table(s, d, "labels").withColumn("key", F.col("doc_id").cast("string"))
    return ledgers.baseline(labels.where("toxic = 1").select("key"), labels.where("quality = 0").select("key"))


TEXT_SQL = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\n+|\n+$', '', 'g')"


@query(
    f"""SELECT CAST(doc_id AS STRING) AS key, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 3 = 0 THEN 'drifted' ELSE 'ok' END AS status FROM documents"""
)
def pin_status(s, d):
    docs = table(s, d, "documents")
    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), "doc_id", "text")
    accepted = F.sha2(ledgers.normalised(F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" edited"))).otherwise(F.concat(F.col("text"), F.lit("  \n")))), 256)
    return ledgers.pin_status(keyed.select("key", accepted.alias("sha256")), keyed.where("doc_id % 11 <> 0").select("key", "text"))


@query(
    """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority"""
)
def ledger_summary_grouping_sets(s, d):
    return ledgers.summary(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def integrity_missing(s, d):
    known = table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return ledgers.missing(table(s, d, "lineitem"), known, "l_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(s, d):
    return ledgers.missing(table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT CAST(l_partkey AS STRING) AS declaration, count(DISTINCT l_orderkey) AS documents, count(*) AS occurrences FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 30")
def cross_document_reuse(s, d):
    cited = table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("declaration"), F.col("l_orderkey").alias("document"))
    return ledgers.reuse(cited, 30)


@query("SELECT p_name AS name, p_partkey FROM part WHERE contains(lower(p_name), '1') ORDER BY NOT starts_with(lower(p_name), '1'), length(p_name), p_name, p_partkey LIMIT 50")
def xref_search(s, d):
    found = table(s, d, "part").where(F.lower("p_name").contains("1"))
    return found.orderBy(~F.lower("p_name").startswith("1"), F.length("p_name"), "p_name", "p_partkey").limit(50).select(F.col("p_name").alias("name"), "p_partkey")


@query(
    """SELECT o.o_orderkey AS "row", CASE WHEN o.o_orderstatus = 'P' THEN 'not_applicable' WHEN count(p_size) = 0 THEN 'planned' WHEN count(*) FILTER (p_size > 25) = count(p_size) THEN 'proved_in_build'
  WHEN count(*) FILTER (p_size > 25) > 0 THEN 'partially_in_build' ELSE 'absent' END AS verification
FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size < 45 GROUP BY o.o_orderkey, o.o_orderstatus"""
)
def apply_probe(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderstatus") == "P", "not_applicable").otherwise("planned").alias("verification"))
    refs = table(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("declaration"))
    return ledgers.apply_probe(rows, refs, table(s, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("declaration"), (F.col("p_size") > 25).alias("resolved")))


@query(
    """SELECT 'error' AS level, 'balance' AS code, c_name AS message, 'customer/' || CAST(c_custkey AS STRING) AS location FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'warning', 'segment', c_mktsegment, 'customer/' || CAST(c_custkey AS STRING) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"""
)
def census_findings(s, d):
    at = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"))
    return ledgers.findings(
        table(s, d, "customer"),
        [("error", "balance", F.col("c_acctbal") < 0, F.col("c_name"), at), ("warning", "segment", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment"), at)],
    )


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k > 1")
def duplicate_clauses(s, d):
    c = table(s, d, "conversations").withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), "role"))
    return ledgers.duplicates(c, "key", "turn").select("conv_id", "turn")


# -- text -----------------------------------------------------------------------------------------

SQUEEZED = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"


@query(f"SELECT count(DISTINCT path) AS members, min(path) AS first_path FROM {FILES} WHERE length({SQUEEZED}) >= 20 GROUP BY {SQUEEZED} HAVING count(DISTINCT path) > 1")
def duplicate_groups(s, d):
    return textaudit.duplicate_groups(files(s, d)).select("members", "first_path")


@query(
    """WITH named AS (SELECT regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM documents), d AS (SELECT name, count(*) AS definitions FROM named WHERE name <> '' GROUP BY name),
t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents), u AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT d.name, d.definitions, coalesce(u.n, 0) AS uses FROM d LEFT JOIN u ON u.token = d.name WHERE coalesce(u.n, 0) <= d.definitions"""
)
def dead_tokens(s, d):
    named = files(s, d).select(F.regexp_extract("text", r"^([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name")).where("name <> ''")
    return textaudit.dead_names(files(s, d), named)


@query("SELECT DISTINCT p_brand AS candidate FROM part WHERE regexp_matches(lower(p_brand), '(old|legacy|#[0-9]*1)')")
def name_candidates(s, d):
    return table(s, d, "part").where(F.lower("p_brand").rlike("(old|legacy|#[0-9]*1)")).select(F.col("p_brand").alias("candidate")).distinct()


@query(
    """WITH r AS (SELECT 'urls' AS "rule", CAST(sum(len(regexp_extract_all(text, 'https?://'))) AS BIGINT) AS found, CAST(5 AS BIGINT) AS maximum FROM documents
UNION ALL SELECT 'licensed', count(*) FILTER (regexp_matches(text, '(?i)licen[sc]e')), CAST(100000 AS BIGINT) FROM documents)
SELECT "rule", found, maximum, CASE WHEN found > maximum THEN 'above' WHEN found < maximum THEN 'below' ELSE 'at' END AS status FROM r"""
)
def ratchet_counts(s, d):
    return textaudit.ratchet(files(s, d), [("urls", "https?://", "matches", 5), ("licensed", "(?i)licen[sc]e", "files", 100_000)])


@query(
    """WITH c AS (SELECT CAST(page_id AS STRING) AS path, len(regexp_extract_all(html, '[A-Za-z]+th')) AS raw, len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '[A-Za-z]+th')) AS code FROM pages)
SELECT path, CAST(raw AS BIGINT) AS raw, CAST(code AS BIGINT) AS code FROM c WHERE raw > 0 OR code > 0"""
)
def symbol_census(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return textaudit.symbol_census(pages, "[A-Za-z]+th", "(?s)<!--.*?-->")


@query(
    f"""SELECT path, CAST(len(l) AS BIGINT) AS lines, length(text) AS chars, CAST(list_max(list_transform(l, lambda x: length(x))) AS BIGINT) AS longest_line, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS blank_lines
FROM (SELECT path, text, string_split(text, chr(10)) AS l FROM {FILES})"""
)
def file_profiles(s, d):
    return textaudit.profiles(files(s, d))


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '^(<<<<<<<|=======|>>>>>>>)|[Cc]opyright')"""
)
def conflict_lines(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return textaudit.marked_lines(docs, "^(<<<<<<<|=======|>>>>>>>)|[Cc]opyright").select(F.col("path").alias("doc_id"), "line_no")


@query(
    r"""WITH q AS (SELECT item_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS quote FROM benchmark), f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS body FROM documents)
SELECT q.item_id, f.doc_id FROM q JOIN f ON contains(' ' || body || ' ', ' ' || quote || ' ')"""
)
def excerpt_found(s, d):
    quotes = table(s, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    held = table(s, d, "documents").select(F.col("doc_id").alias("path"), "text")
    found = textaudit.excerpts(quotes, held, whole=True)  # whole words only, as the oracle has it
    return found.select(F.col("quote_id").alias("item_id"), F.col("path").alias("doc_id"))


@query()
def code_without_comments(s, d):
    """Nested comment stripping is not a regular language: rows only; its unit test holds the vectors."""
    pages = table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return textaudit.strip_nested(pages, "<!--", "-->", "//").select("path", F.length("text").alias("chars"))


# -- logs and modules -----------------------------------------------------------------------------


@query("SELECT event_type, user_id, min(event_id) AS first, count(*) AS repeats FROM events GROUP BY event_type, user_id")
def diagnostic_dedup(s, d):
    return logs.deduplicate(table(s, d, "events"), ["event_type", "user_id"], "event_id")


@query(
    """WITH e AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS pos FROM events), g AS (SELECT user_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM e),
c AS (SELECT user_id, pos, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
SELECT user_id, cluster, count(*) AS n, min(pos) AS first, max(pos) AS last FROM c GROUP BY user_id, cluster"""
)
def diagnostic_clusters(s, d):
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return long(logs.gap_clusters(e, "user_id", "at", 3_600_000_000), "cluster")


@query(
    """WITH lines AS (SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN event_type || '.lean:' || CAST(user_id AS STRING) || ':2: error: bad term' WHEN event_id % 3 = 1 THEN 'warning: ' || event_type || ':' || CAST(user_id AS STRING) || ':7: unused' ELSE 'note' END AS line FROM events)
SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN event_id % 3 = 0 THEN event_type || '.lean' ELSE event_type END AS file, CAST(user_id AS BIGINT) AS line_no FROM events WHERE event_id % 3 <> 2"""
)
def diagnostic_headers(s, d):
    e = table(s, d, "events")
    user = F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(".lean:"), user, F.lit(":2: error: bad term"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("warning: "), F.col("event_type"), F.lit(":"), user, F.lit(":7: unused"))).otherwise("note")
    return long(logs.parse_headers(e.select(F.col("event_id").alias("n"), line.alias("line"))).select("n", "severity", "file", "line_no"), "line_no")


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS authors, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def history_summary(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("authors"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def top_touched(s, d):
    return logs.top(table(s, d, "lineitem"), "l_partkey", 20)


IMPORTS = "SELECT dst AS module, src AS dep FROM (" + PART_EDGES + ")"


@query(
    f"""WITH RECURSIVE imports AS ({IMPORTS}), walked(seed, node) AS (SELECT 'part.' || CAST(p_partkey AS STRING), 'part.' || CAST(p_partkey AS STRING) FROM part WHERE p_size = 7 UNION SELECT w.seed, i.dep FROM walked w JOIN imports i ON i.module = w.node)
SELECT l.seed AS a, r.seed AS b, count(*) AS common FROM walked l JOIN walked r ON l.node = r.node AND l.seed < r.seed GROUP BY 1, 2"""
)
def import_closure_overlap(s, d):
    return modules.closure_overlap(materialise(modules.import_closure(frame(s, d, IMPORTS), parts(s, d)), "imports"))


@query(f"SELECT 'no-leaf-from-order' AS \"rule\", dst AS module, src AS dep FROM ({EDGES}) WHERE starts_with(dst, 'orders.') AND starts_with(src, 'supplier.') UNION SELECT 'no-seven', dst, src FROM ({EDGES}) WHERE starts_with(dst, 'orders.') AND src = 'part.7'")
def policy_violations_direct(s, d):
    rules = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("from_prefix"), F.lit(b).alias("deny_prefix")) for r, a, b in (("no-leaf-from-order", "orders", "supplier"), ("no-seven", "orders", "part.7"))])))
    return modules.policy_violations(edges(s, d).select(F.col("dst").alias("module"), F.col("src").alias("dep")), rules)


@query(
    f"""WITH RECURSIVE imports AS ({IMPORTS}), walked(seed, node, n) AS (SELECT 'part.' || CAST(p_partkey AS STRING), 'part.' || CAST(p_partkey AS STRING), 0 FROM part UNION SELECT w.seed, i.dep, w.n + 1 FROM walked w JOIN imports i ON i.module = w.node)
SELECT seed AS module, arg_min(node, lpad(CAST(n AS STRING), 4, '0') || node) AS forbidden, CAST(min(n) AS BIGINT) AS distance FROM walked WHERE n > 0 AND node IN (SELECT 'part.' || CAST(p_partkey AS STRING) FROM part WHERE p_brand = 'Brand#13') GROUP BY seed"""
)
def policy_violations_transitive(s, d):
    i = frame(s, d, IMPORTS).select(F.col("module").alias("src"), F.col("dep").alias("dst"))
    wanted = table(s, d, "part").where("p_brand = 'Brand#13'").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))
    return long(graph.nearest(i, every_part(s, d), wanted), "distance").select(F.col("seed").alias("module"), F.col("node").alias("forbidden"), "distance")


@query(
    f"""WITH RECURSIVE imports AS ({IMPORTS}), covered(node) AS (SELECT 'part.' || CAST(p_partkey AS STRING) FROM part WHERE p_size = 7 UNION SELECT i.dep FROM covered w JOIN imports i ON i.module = w.node),
excluded AS (SELECT 'part.' || CAST(p_partkey AS STRING) AS node FROM part WHERE p_size = 5), inherited(node) AS (SELECT node FROM excluded UNION SELECT i.module FROM inherited w JOIN imports i ON i.dep = w.node)
SELECT 'part.' || CAST(p_partkey AS STRING) AS module, CASE WHEN 'part.' || CAST(p_partkey AS STRING) IN (SELECT node FROM covered) THEN 'covered' WHEN p_size = 5 THEN 'excluded' WHEN 'part.' || CAST(p_partkey AS STRING) IN (SELECT node FROM inherited) THEN 'inherited' ELSE 'uncovered' END AS status FROM part"""
)
def module_coverage_partition(s, d):
    i = frame(s, d, IMPORTS)
    name = F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("module")
    scope, excluded = table(s, d, "part").select(name), table(s, d, "part").where("p_size = 5").select(name)
    covered = modules.import_closure(i, parts(s, d)).select(F.col("node").alias("module"))
    return modules.coverage_partition(scope, covered, excluded, i)


@query(
    f"""WITH RECURSIVE imports AS ({IMPORTS}), walked(rung, node) AS (SELECT p_size % 4, 'part.' || CAST(p_partkey AS STRING) FROM part UNION SELECT w.rung, i.dep FROM walked w JOIN imports i ON i.module = w.node)
SELECT node, min(rung) AS rung FROM walked GROUP BY node"""
)
def rung_closure(s, d):
    seeds = table(s, d, "part").select((F.col("p_size") % 4).alias("rung"), F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("node"))
    return modules.rungs(frame(s, d, IMPORTS), seeds)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_journal_counts(s, d):
    schema = table(s, d, "events").schema
    stream = extensions.journal(s, d, schema, "events.parquet")
    return extensions.drain(extensions.windowed_counts(stream), "journal_counts").withColumn("start", F.col("start").cast("timestamp_ntz"))



def load() -> None:
    """Adds the queries of the other modules of this package."""
    from ledgerline.plans import declared, more, references, routes, sources, upkeep  # noqa: F401


load()
