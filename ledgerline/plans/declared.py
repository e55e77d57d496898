"""Registered queries over source texts, ledger documents and policies, laid over the driver tables.

Source files are written out from ``part`` (a file per brand), ledger documents from
``orders`` (a census per customer). The oracles know the tables only: they say what scanning
or validating the texts has to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.session import shuffle_width
from ledgerline.operators import documents, graph, logs, names, policies, sources
from ledgerline.plans.catalogue import decls, edges, long, query
from ledgerline.sources.projection import CYCLIC, DECLS, EDGES, consumed, frame
from ledgerline.sources.tables import table

#: What a part declares: theorems for even sizes (documented where the size divides by 4), private definitions for odd ones.
DECLARED = """SELECT p_brand, 'Lib.' || replace(p_brand, '#', '') AS module, p_partkey, p_size,
  'p_' || CAST(p_partkey AS STRING) || CASE WHEN p_size = 11 THEN '_old' ELSE '' END AS short,
  CASE WHEN p_size % 2 = 0 THEN 'theorem' ELSE 'def' END AS kind, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END AS lines FROM part"""
PLACED = f"""SELECT *, 'Shelf.' || short AS name, 2 + CAST(sum(lines) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line FROM ({DECLARED})"""


def scanned(s, d):
    own = F.concat(
        F.when(F.col("p_size") % 4 == 0, "/-- of a size -/\n").otherwise(""),
        F.when(F.col("kind") == "theorem", F.concat(F.lit("theorem "), "short", F.lit(" {a : Nat} (h : a = \"theorem no : := 3\") : size = "), F.col("p_size").cast("string"), F.when(F.col("p_size") == 50, " := by sorry\n").otherwise(" := by simp\n")))
        .otherwise(F.concat(F.lit("private def "), "short", F.lit(" : Nat := "), F.when(F.col("p_size") == 49, "sorry").otherwise(F.concat(F.lit("p_"), (F.col("p_partkey") - 1).cast("string"))), F.lit(" -- def not_this : Nat := 1\n"))),
    )
    # A brand's file is one task's: a width of its own, as the parts are few bytes and their texts are many.
    told = frame(s, d, DECLARED)
    body = told.repartition(max(shuffle_width(told), 4 * s.sparkContext.defaultParallelism), "p_brand", "module").groupBy("p_brand", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", own.alias("text")))), lambda x: x["text"]), "").alias("body"))
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    text = F.concat(F.lit("import Lib.Brand"), (number - 1).cast("string"), F.lit("\nnamespace Shelf\n"), "body", F.lit("end Shelf\n/- theorem none : True -/\n"))
    return sources.scan_files(body.select(F.concat("module", F.lit(".lean")).alias("path"), "module", text.alias("text")))


@query(f"SELECT name, kind, module, line, kind = 'def' AS private, p_size % 4 = 0 AS documented FROM ({PLACED})")
def source_declarations(s, d):
    return sources.declarations(scanned(s, d)).select("name", "kind", "module", "line", "private", "documented")


@query("SELECT DISTINCT 'Lib.' || replace(p_brand, '#', '') AS module, 'Lib.Brand' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) - 1 AS STRING) AS dep FROM part")
def source_imports(s, d):
    return sources.module_imports(scanned(s, d))


IMPORTING = f"""WITH RECURSIVE m AS (SELECT DISTINCT module, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS no FROM ({DECLARED})),
own AS (SELECT DISTINCT module FROM ({DECLARED}) WHERE p_size IN (49, 50)),
closed(module, source) AS (SELECT module, module FROM own UNION SELECT m.module, c.source FROM closed c JOIN m s ON s.module = c.module JOIN m ON m.no = s.no + 1)"""


@query(f"{IMPORTING} SELECT m.module, m.module IN (SELECT module FROM own) AS own, (SELECT count(*) FROM closed c WHERE c.module = m.module) AS sources FROM m")
def source_admissions(s, d):
    return long(sources.admission_report(scanned(s, d)).select("module", "own", F.size("sources").alias("sources")), "sources")


@query(f"SELECT module, name, line FROM ({PLACED}) WHERE kind = 'theorem' AND p_size % 4 <> 0")
def source_undocumented(s, d):
    return sources.undocumented_public(sources.declarations(scanned(s, d)), ("Lib",)).select("module", "name", "line")


@query(f"SELECT count(*) AS declarations, count(DISTINCT module) AS paths FROM ({DECLARED}) WHERE kind = 'theorem' GROUP BY p_size HAVING count(DISTINCT module) > 1")
def source_duplicates(s, d):
    return sources.duplicate_statements(sources.blocks(scanned(s, d)), minimum=20).select("declarations", "paths")


@query(f"SELECT x.module || '.lean' AS path, x.name, x.line FROM ({PLACED}) x WHERE x.kind = 'def' AND (x.p_size = 11 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = x.p_partkey + 1 AND q.p_size % 2 = 1 AND q.p_size <> 49))")
def source_dead(s, d):
    return sources.dead_definitions(scanned(s, d)).select("path", "name", "line")


@query(f"SELECT module || '.lean' AS path, name, line, '_old' AS \"match\" FROM ({PLACED}) WHERE p_size = 11")
def source_names(s, d):
    return sources.provisional_names(sources.blocks(scanned(s, d)))


@query(f"SELECT module || '.lean' AS path, name, line, kind FROM ({PLACED}) WHERE p_size = 49")
def source_escapes(s, d):
    return sources.definitional_escapes(sources.blocks(scanned(s, d)))


@query(
    f"""{IMPORTING} SELECT (SELECT count(*) FROM part) AS declarations, (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS public_declarations, (SELECT count(*) FROM part WHERE p_size % 2 = 0 AND p_size % 4 <> 0) AS undocumented_public,
(SELECT count(*) FROM m) AS modules, (SELECT count(*) FROM own) AS own_admission, 0 AS duplicate_public_names, (SELECT count(DISTINCT module) FROM closed) AS in_admission_closure"""
)
def source_summary(s, d):
    return sources.audit_summary(scanned(s, d))


# -- ledgers --------------------------------------------------------------------------------------

CENSUS = """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'R' || CAST(o_orderkey % 5 AS STRING) END AS id,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'compiled' ELSE 'parked' END AS status,
  CASE WHEN o_totalprice < 100000 THEN 'absent' WHEN o_totalprice < 300000 THEN 'proved_in_build' ELSE 'planned' END AS verification,
  CAST(o_orderkey % 3 AS INT) AS cites, 'G' || CAST(o_orderkey % 4 AS STRING) AS gap FROM orders"""


def censuses(s, d):
    # Dealt by document at a width of its own: an order is some bytes in its file, and many more as a row and its text.
    orders = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    rows = s.sql(CENSUS.replace("FROM orders", "FROM {orders}"), orders=orders.repartition(shuffle_width(orders, 1 << 20), "o_custkey"))
    item = F.struct("pos", F.struct("id", "status", "verification", F.when(F.col("cites") > 0, F.transform(F.sequence(F.lit(1), F.col("cites")), lambda i: F.concat(F.lit("D."), (F.col("o_orderkey") % 9 + i).cast("string")))).otherwise(F.array().cast("array<string>")).alias("lean_declarations"), F.array("gap").alias("gap_refs")).alias("row"))
    items = F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]))
    known = '"status_definitions":{"open":"","compiled":""},"verification_definitions":{"absent":"","proved_in_build":"","planned":""},"gaps":{"G0":"","G1":"","G2":"","G9":""}'
    return rows.groupBy(F.col("o_custkey").alias("document")).agg(F.concat(F.lit("{" + known + ',"items":'), items, F.lit("}")).alias("body"))


@query(
    f"""WITH r AS (SELECT *, 'items[' || CAST(pos AS STRING) || ']' AS spot, CASE WHEN id <> '' THEN id ELSE '#' || CAST(pos AS STRING) END AS loc,
  row_number() OVER (PARTITION BY o_custkey, id ORDER BY pos) AS nth FROM ({CENSUS}))
SELECT o_custkey AS document, 'error' AS level, 'id' AS code, spot AS location FROM r WHERE id = ''
UNION ALL SELECT o_custkey, 'error', 'duplicate-id', spot FROM r WHERE id <> '' AND nth > 1
UNION ALL SELECT o_custkey, 'error', 'status', loc FROM r WHERE status = 'parked'
UNION ALL SELECT o_custkey, 'error', 'verification-citations', loc FROM r WHERE verification = 'absent' AND cites > 0
UNION ALL SELECT o_custkey, 'error', 'verification-citations', loc FROM r WHERE verification = 'proved_in_build' AND cites = 0
UNION ALL SELECT o_custkey, 'error', 'compiled-absent', loc FROM r WHERE verification = 'absent' AND status = 'compiled'
UNION ALL SELECT o_custkey, 'error', 'gap-ref', loc FROM r WHERE gap = 'G3'
UNION ALL SELECT c.o_custkey, 'warning', 'orphan-gap', g.gap FROM (SELECT DISTINCT o_custkey FROM r) c, (VALUES ('G0'), ('G1'), ('G2'), ('G9')) g(gap) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o_custkey = c.o_custkey AND r.gap = g.gap)"""
)
def census_validation(s, d):
    return documents.validate_census(censuses(s, d))


@query(
    f"""WITH r AS ({CENSUS}), c AS (SELECT o_custkey, 'D.' || CAST(o_orderkey % 9 + i AS STRING) AS name, count(*) AS n FROM r, (VALUES (1), (2)) k(i) WHERE i <= cites GROUP BY 1, 2)
SELECT o_custkey AS document, 'status' AS field, status AS "value", count(*) AS n FROM r GROUP BY 1, 3
UNION ALL SELECT o_custkey, 'verification', verification, count(*) FROM r GROUP BY 1, 3
UNION ALL SELECT o_custkey, 'reused', name, n FROM c WHERE n > 1
UNION ALL SELECT o_custkey, 'unique_lean_declarations', '', count(*) FROM c GROUP BY 1
UNION ALL SELECT o_custkey, 'items', '', count(*) FROM r GROUP BY 1"""
)
def census_summaries(s, d):
    return documents.census_summary(censuses(s, d))


@query(
    f"""WITH d AS (SELECT 'Lib.' || CAST(p_partkey AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || CAST(p_size AS STRING) AS name FROM part), k AS (SELECT name, split_part(name, '.', 3) AS short FROM d),
q AS (SELECT DISTINCT query FROM (SELECT name AS query FROM d WHERE length(name) < 8 UNION ALL SELECT CAST(p_partkey AS STRING) FROM part))
SELECT query, CASE WHEN query IN (SELECT name FROM d) THEN query WHEN (SELECT count(*) FROM k WHERE short = query) = 1 THEN (SELECT min(name) FROM k WHERE short = query) END AS resolved,
  CASE WHEN query IN (SELECT name FROM d) THEN 1 ELSE (SELECT count(*) FROM k WHERE short = query) END AS candidates FROM q"""
)
def cited_resolution(s, d):
    known = frame(s, d, "SELECT 'Lib.' || CAST(p_partkey AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || CAST(p_size AS STRING) AS name, CAST(p_partkey AS STRING) AS key FROM part")
    asked = known.where(F.length("name") < 8).select(F.col("name").alias("query")).unionByName(known.select(F.col("key").alias("query")))
    return names.resolve_cited(asked, known)


# -- policies -------------------------------------------------------------------------------------

GROUPS = {"sales": ["orders"], "goods": ["part"], "makers": ["supplier.*"], "places": ["nation", "region"]}
RULES = [
    {"id": "sales-from-makers", "source_groups": ["sales"], "deny_groups": ["makers"], "exceptions": ["orders.1", "orders.2*"]},
    {"id": "sales-allow", "source_groups": ["sales"], "allow_groups": ["goods", "makers"]},
    {"id": "makers-reach-places", "source_groups": ["makers"], "deny_groups": ["places"], "transitive": True},
]


@query(
    f"""WITH e AS ({EDGES}) SELECT 'sales-from-makers' AS "rule", dst AS module, src AS imported, dst || '>' || src AS path FROM e WHERE starts_with(dst, 'orders.') AND starts_with(src, 'supplier.') AND dst <> 'orders.1' AND NOT starts_with(dst, 'orders.2')
UNION ALL SELECT 'sales-allow', dst, src, dst || '>' || src FROM e WHERE starts_with(dst, 'orders.') AND NOT starts_with(src, 'part.') AND NOT starts_with(src, 'supplier.')
UNION ALL SELECT 'makers-reach-places', dst, src, dst || '>' || src FROM e WHERE starts_with(dst, 'supplier.')"""
)
def import_policy(s, d):
    known = decls(s, d).select(F.col("name").alias("module"))
    found = policies.import_violations(consumed(s, d).select(F.col("dst").alias("module"), F.col("src").alias("dep")), known, GROUPS, RULES)
    return found.select("rule", "module", "imported", F.array_join("path", ">").alias("path"))


@query(
    f"""WITH RECURSIVE edges AS ({CYCLIC}), reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b), core AS (SELECT a AS node FROM reach WHERE a = b)
SELECT node FROM core UNION SELECT b FROM reach WHERE a IN (SELECT node FROM core)"""
)
def dependency_cycles(s, d):
    e = frame(s, d, CYCLIC)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return policies.leftover(nodes, e.select(F.col("dst").alias("node"), F.col("src").alias("dep")))


@query(
    """WITH l AS (SELECT o_custkey AS run, o_orderkey AS n, o_orderkey % 5 AS k FROM orders), g AS (SELECT *, count(*) FILTER (k IN (0, 1)) OVER w AS ordinal, last_value(CASE WHEN k IN (0, 1) THEN 1 WHEN k = 2 THEN 0 END IGNORE NULLS) OVER w AS open FROM l WINDOW w AS (PARTITION BY run ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT run, ordinal, min(n) FILTER (k IN (0, 1)) AS n, min(CASE WHEN k = 0 THEN 'error' WHEN k = 1 THEN 'warning' END) AS severity, min(CASE WHEN k IN (0, 1) THEN 'F' || CAST(n AS STRING) || '.lean' END) AS file,
  count(*) FILTER (k = 3) AS solid FROM g WHERE open = 1 GROUP BY run, ordinal"""
)
def diagnostic_bodies(s, d):
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("F"), n, F.lit(".lean:3:1: error: bad"))).when(k == 1, F.concat(F.lit("warning: F"), n, F.lit(".lean:4:2: unused"))).when(k == 2, F.lit("[3/9] Building")).when(k == 3, F.concat(F.lit("  note "), n)).otherwise(F.lit("  "))
    found, _ = logs.parse_output(table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("n"), line.alias("line")))
    return long(found.select("run", "ordinal", "n", "severity", "file", F.size(F.filter("body", lambda x: F.trim(x) != "")).alias("solid")), "ordinal", "solid")
