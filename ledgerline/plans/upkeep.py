"""Queries on upkeep: aggregates of a folder tree, checklists, tables that are rewritten version by version."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.functions.session import scratch_dir
from ledgerline.operators import aggregates, checklist, pins, versions
from ledgerline.plans.catalogue import long, query
from ledgerline.sources.projection import frame
from ledgerline.sources.tables import table

#: Parts as modules in folders of type and brand; small ones of size 49 import their own folder's aggregate, of size 50 their type's.
HOME = "'Lib.' || p_type || '.' || replace(p_brand, '#', '')"
MODULE = f"{HOME} || '.P' || CAST(p_partkey AS STRING)"
MODULES = f"""SELECT {MODULE} AS module FROM part
UNION SELECT {HOME} || '.All' FROM part WHERE p_size > 20 UNION SELECT 'Lib.' || p_type || '.All' FROM part
UNION SELECT 'Lib.' || p_type FROM part UNION SELECT 'Base.' || p_type FROM part WHERE p_type <> 'SMALL'"""
LINES = f"""SELECT {MODULE} AS module, {HOME} || '.All' AS dep, 1 AS nth FROM part WHERE p_size = 49
UNION ALL SELECT {MODULE}, 'Lib.' || p_type || '.All', 2 FROM part WHERE p_size = 50
UNION ALL SELECT c.at, p.at, 3 FROM (SELECT {MODULE} AS at, CAST(floor(p_partkey / 2) AS BIGINT) AS up, p_type AS kind FROM part WHERE p_partkey > 1) c JOIN (SELECT {MODULE} AS at, CAST(p_partkey AS BIGINT) AS own, p_type AS kind FROM part) p ON c.up = p.own AND c.kind = p.kind
UNION ALL SELECT {HOME} || '.All', {MODULE}, CAST(10 + row_number() OVER (PARTITION BY p_type, p_brand ORDER BY 'P' || CAST(p_partkey AS STRING)) AS INT) FROM part WHERE p_size <> 3
UNION ALL SELECT f.home || '.All', 'Gone.' || f.p_type, 9 FROM (SELECT DISTINCT {HOME} AS home, p_type FROM part WHERE p_size = 45) f
UNION ALL SELECT 'Lib.' || b.p_type || '.All', b.home || '.All', CAST(row_number() OVER (PARTITION BY b.p_type ORDER BY b.home) AS INT) FROM (SELECT DISTINCT p_type, {HOME} AS home FROM part) b
UNION ALL SELECT DISTINCT 'Lib.' || p_type || '.All', 'Base.' || p_type, 0 FROM part"""
#: What the aggregates should import, by plain reachability from every module.
PLACED = f"""WITH RECURSIVE m AS ({MODULES}), written AS ({LINES}), i AS (SELECT DISTINCT l.module, l.dep FROM written l),
heads AS (SELECT DISTINCT h.folder || '.All' AS aggregate, h.folder FROM (SELECT regexp_replace(module, '\\.[^.]*$', '') AS folder FROM m WHERE module LIKE 'Lib.%.%.%' UNION SELECT 'Lib.' || p_type FROM part UNION SELECT 'Lib') h WHERE h.folder <> 'Lib.PROMO' AND h.folder NOT LIKE 'Lib.PROMO.%'),
r(aggregate, module) AS (SELECT h.aggregate, i.module FROM i JOIN heads h ON h.aggregate = i.dep UNION SELECT r.aggregate, i.module FROM r JOIN i ON i.dep = r.module),
own AS (SELECT h.aggregate, h.folder, m.module, EXISTS (SELECT 1 FROM r WHERE r.aggregate = h.aggregate AND r.module = m.module) AS held FROM m JOIN heads h ON h.folder = regexp_replace(m.module, '\\.[^.]*$', '') WHERE m.module NOT LIKE '%.All' AND m.module <> 'Lib.PROMO'),
foreign_ AS (SELECT i.module AS aggregate, i.dep AS module, i.dep IN (SELECT module FROM m) AS kept FROM i JOIN heads h ON h.aggregate = i.module JOIN m ON m.module = i.module WHERE i.dep NOT LIKE 'Lib.%'),
raised AS (SELECT regexp_replace(folder, '\\.[^.]*$', '') || '.All' AS aggregate, module FROM own WHERE held AND folder <> 'Lib'),
listed AS (SELECT regexp_replace(folder, '\\.[^.]*$', '') || '.All' AS aggregate, aggregate AS module, 1 AS part, regexp_extract(folder, '[^.]*$') AS b FROM heads WHERE folder <> 'Lib'
  UNION SELECT aggregate, module, 2, regexp_extract(module, '[^.]*$') FROM (SELECT aggregate, module FROM own WHERE NOT held UNION SELECT aggregate, module FROM raised UNION SELECT aggregate, module FROM foreign_ WHERE kept)),
placed AS (SELECT aggregate, row_number() OVER (PARTITION BY aggregate ORDER BY part, b, module) AS place, module FROM listed)"""


def tree(s, d) -> aggregates.Aggregates:
    return aggregates.check(frame(s, d, MODULES), frame(s, d, LINES), "Lib", skip=("PROMO",))


@query(PLACED + " SELECT aggregate, CAST(place AS BIGINT) AS place, module FROM placed")
def aggregate_lines(s, d):
    return long(tree(s, d).lines, "place")


@query(
    PLACED
    + """, there AS (SELECT l.module AS aggregate, list(l.dep ORDER BY l.nth, l.dep) AS was FROM written l JOIN m ON m.module = l.module GROUP BY l.module),
due AS (SELECT aggregate, list(module ORDER BY place) AS now FROM placed GROUP BY aggregate)
SELECT d.aggregate, CASE WHEN d.aggregate NOT IN (SELECT module FROM m) THEN 'missing' WHEN t.was = d.now THEN 'current' ELSE 'stale' END AS state, CAST(len(d.now) AS BIGINT) AS lines,
  (SELECT count(*) FROM foreign_ f WHERE f.aggregate = d.aggregate AND NOT kept) AS dangling, (SELECT count(*) FROM own o WHERE o.folder = 'Lib' AND held AND o.aggregate = d.aggregate) AS unplaceable
FROM due d LEFT JOIN there t ON t.aggregate = d.aggregate"""
)
def aggregate_status(s, d):
    return tree(s, d).status


@query(PLACED + " SELECT aggregate, 'dangling' AS kind, module FROM foreign_ WHERE NOT kept UNION ALL SELECT aggregate, 'promoted', module FROM raised UNION ALL SELECT aggregate, 'unplaceable', module FROM own WHERE held AND folder = 'Lib'")
def aggregate_notes(s, d):
    return tree(s, d).notes


#: Documents as files of their source and language, a line for each sentence; those marked good are reviewed, the toxic ones under an older name.
PAPERS = """SELECT source || '/' || lang || '/' || CASE WHEN n_chars > 900 THEN 'long' ELSE 'short' END || '/doc' || CAST(doc_id AS STRING) || CASE lang WHEN 'en' THEN '.lean' WHEN 'de' THEN '.md' WHEN 'fr' THEN '.tex' ELSE '' END AS path,
  CAST(1 + length(text) - length(replace(text, '.', '')) AS INT) AS lines, doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL"""
TICKED = f"SELECT CASE WHEN l.toxic = 1 THEN 'old/doc' || CAST(l.doc_id AS STRING) ELSE p.path END AS path FROM labels l JOIN ({PAPERS}) p ON p.doc_id = l.doc_id WHERE l.quality = 1"
MOVED = f"SELECT 'old/doc' || CAST(p.doc_id AS STRING) AS old, p.path AS new FROM ({PAPERS}) p"
SIGNED = "SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE n_chars > 2000 AND lang = 'en' UNION SELECT DISTINCT source || '/' || lang || ' :: paper source' FROM documents WHERE n_chars > 2000 AND lang = 'fr'"
SUMMED = f"""WITH f AS (SELECT path, doc_id, max(lines) AS lines FROM ({PAPERS}) WHERE path NOT LIKE 'src0%' GROUP BY path, doc_id), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
g AS (SELECT f.*, t.doc_id IS NOT NULL AS done, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || CASE split_part(path, '/', 2) WHEN 'en' THEN '' WHEN 'de' THEN ' :: documentation' WHEN 'fr' THEN ' :: paper source' ELSE ' :: other' END AS grp FROM f LEFT JOIN t USING (doc_id)),
s AS (SELECT grp AS "group", count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (done) AS files_done, CAST(coalesce(sum(lines) FILTER (done), 0) AS BIGINT) AS lines_done, bool_and(done) AS ready, grp IN (SELECT path FROM ({SIGNED})) AS done FROM g GROUP BY grp)"""


def papers(s, d):
    """Files, those marked, groups that are signed."""
    files = checklist.select(frame(s, d, PAPERS), exclude=("src0/**",))
    return files, checklist.renamed(frame(s, d, TICKED), frame(s, d, MOVED)), frame(s, d, SIGNED)


@query(SUMMED + ' SELECT grp AS "group", CAST(row_number() OVER (PARTITION BY grp ORDER BY lines DESC, path) AS BIGINT) AS nth, path, CAST(lines AS BIGINT) AS lines, done FROM g')
def checklist_files(s, d):
    files, marked, _ = papers(s, d)
    return long(checklist.listing(files, marked), "nth").drop("kind")


@query(SUMMED + " SELECT * FROM s")
def checklist_groups(s, d):
    return checklist.groups(*papers(s, d))


@query(
    SUMMED
    + """ SELECT CAST(sum(files_done) AS BIGINT) AS files_done, CAST(sum(files) AS BIGINT) AS files_total, CAST(sum(lines_done) AS BIGINT) AS lines_done, CAST(sum(lines) AS BIGINT) AS lines_total,
count(*) FILTER (done) AS groups_done, count(*) AS groups_total, count(*) FILTER (ready AND NOT done) AS ready_groups FROM s"""
)
def checklist_progress(s, d):
    return checklist.progress(checklist.groups(*papers(s, d)))


#: Orders edit their customer: finished ones the segment, open ones the balance (some with a text that is none), pending ones a field that can't be written.
CHANGES = """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -o_custkey ELSE o_custkey END AS key, CASE o_orderstatus WHEN 'F' THEN 'c_mktsegment' WHEN 'O' THEN 'c_nationkey' ELSE 'c_name' END AS field,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice >= 400000 THEN 'none' WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 25 AS STRING) WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS value, o_orderkey AS nth FROM orders"""
JUDGED = f"""WITH e AS (SELECT x.*, CASE WHEN field = 'c_name' THEN 'not-writable' WHEN field = 'c_nationkey' AND value = 'none' THEN 'wrong-type' WHEN c.c_custkey IS NULL THEN 'no-row' END AS refused,
  CASE field WHEN 'c_mktsegment' THEN c_mktsegment WHEN 'c_nationkey' THEN CAST(c_nationkey AS STRING) END AS first FROM ({CHANGES}) x LEFT JOIN customer c ON c.c_custkey = x.key),
o AS (SELECT *, row_number() OVER w AS up, lag(value) OVER w AS prior, row_number() OVER (PARTITION BY key, field ORDER BY nth DESC) AS down FROM e WHERE refused IS NULL WINDOW w AS (PARTITION BY key, field ORDER BY nth))"""
WRITABLE = ("c_mktsegment", "c_nationkey")


@query(
    JUDGED
    + """ SELECT key, field, nth, CASE WHEN up = 1 THEN first ELSE prior END AS before, value AS after, CASE WHEN down = 1 THEN 'written' ELSE 'replaced' END AS state FROM o
UNION ALL SELECT key, field, nth, NULL, value, refused FROM e WHERE refused IS NOT NULL"""
)
def edit_report(s, d):
    return versions.edited(table(s, d, "customer"), frame(s, d, CHANGES), "c_custkey", WRITABLE)[1]


@query(
    JUDGED
    + """ SELECT 2 AS version, c_custkey, c_name, CASE WHEN n.key IS NULL THEN c_nationkey ELSE CAST(n.value AS BIGINT) END AS c_nationkey, CASE WHEN m.key IS NULL THEN c_mktsegment ELSE m.value END AS c_mktsegment
FROM customer LEFT JOIN (SELECT * FROM o WHERE down = 1 AND field = 'c_nationkey') n ON n.key = c_custkey LEFT JOIN (SELECT * FROM o WHERE down = 1 AND field = 'c_mktsegment') m ON m.key = c_custkey
UNION ALL SELECT 1, c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"""
)
def table_versions(s, d):
    """Both versions of a table: as it was, and after the edits, each committed and read back."""
    folder = f"{scratch_dir(s)}/customers-{uuid.uuid4().hex}"
    first = versions.commit(table(s, d, "customer"), folder, 0, "load")
    second = versions.commit(versions.edited(versions.read(s, folder, first), frame(s, d, CHANGES), "c_custkey", WRITABLE)[0], folder, first, "orders")
    both = [versions.read(s, folder, v).select(F.lit(v).alias("version"), "c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment") for v in (first, second)]
    return both[0].unionByName(both[1])


#: Customers claim their orders; finished orders are pinned, urgent ones with another type, low ones with another text; pending ones have no record.
CLAIMS = "SELECT 'customer.' || CAST(o_custkey AS STRING) AS target, o_orderkey AS nth, CAST(o_orderkey AS STRING) AS declaration FROM orders WHERE o_totalprice >= 300000"
RECORDS = "SELECT CAST(o_orderkey AS STRING) AS name, md5(CAST(o_orderkey AS STRING)) AS type_expr_hash, md5(o_orderpriority) AS type_text_sha256, o_orderstatus = 'P' AS missing FROM orders"
PINNED = """SELECT 'customer.' || CAST(o_custkey AS STRING) AS target, o_orderkey AS nth, CAST(o_orderkey AS STRING) AS declaration, CASE WHEN o_orderpriority = '1-URGENT' THEN 'other' ELSE md5(CAST(o_orderkey AS STRING)) END AS type_expr_hash,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE md5(o_orderpriority) END AS type_text_sha256, 'v1' AS toolchain, 'then' AS pinned_on, CASE WHEN o_totalprice >= 450000 THEN 'dear' ELSE '' END AS note FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice >= 200000"""


@query(
    f"""WITH c AS ({CLAIMS}), p AS ({PINNED}), r AS ({RECORDS}), t AS (SELECT DISTINCT target FROM c),
x AS (SELECT coalesce(c.target, p.target) AS target, coalesce(c.declaration, p.declaration) AS declaration, CASE WHEN p.target IS NULL THEN 'unpinned' WHEN r.missing THEN 'gone' WHEN p.type_expr_hash <> r.type_expr_hash THEN 'drift' WHEN p.type_text_sha256 <> r.type_text_sha256 THEN 'text-drift' ELSE 'current' END AS state
FROM c FULL JOIN (SELECT * FROM p WHERE target IN (SELECT target FROM t)) p ON p.target = c.target AND p.declaration = c.declaration JOIN r ON r.name = coalesce(c.declaration, p.declaration))
SELECT CASE WHEN state IN ('gone', 'drift') THEN 'error' ELSE 'warning' END AS severity, CASE state WHEN 'unpinned' THEN 'statement-unpinned' WHEN 'gone' THEN 'statement-pin-gone' WHEN 'drift' THEN 'statement-drift' ELSE 'statement-text-drift' END AS code, target, declaration FROM x WHERE state <> 'current'"""
)
def pin_findings(s, d):
    return pins.findings(frame(s, d, CLAIMS), frame(s, d, PINNED), frame(s, d, RECORDS))


@query(
    f"""WITH c AS ({CLAIMS}), p AS ({PINNED}), r AS ({RECORDS})
SELECT * FROM p WHERE target NOT IN (SELECT target FROM c) UNION ALL SELECT c.target, c.nth, c.declaration, r.type_expr_hash, r.type_text_sha256, 'v2', 'now', CASE WHEN p.note <> '' THEN p.note END FROM c JOIN r ON r.name = c.declaration AND NOT r.missing LEFT JOIN p ON p.target = c.target AND p.declaration = c.declaration"""
)
def pins_renewed(s, d):
    return pins.renew(frame(s, d, CLAIMS), frame(s, d, PINNED), frame(s, d, RECORDS), "now", "v2")[0]


REASONS = "SELECT CAST(doc_id AS STRING) AS key, 'quality ' || CAST(quality AS STRING) AS reason FROM labels WHERE quality = 0"


@query(f"SELECT key, coalesce(max(r.reason), '') AS reason FROM (SELECT CAST(doc_id AS STRING) AS key FROM labels WHERE toxic = 1) f LEFT JOIN ({REASONS}) r USING (key) GROUP BY key")
def baseline_recorded(s, d):
    return versions.accepted(table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("key")), frame(s, d, REASONS))
