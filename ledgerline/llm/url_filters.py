"""URL rules as a sort-merge range join, in DataFrame functions only.

A host is canonicalised to its labels in reverse order, each ended by a dot, so
``www.example.com`` sorts as ``com.example.www.`` and everything under a rule's
host is one key interval ``[key, key with its last dot raised to '/')``. Intervals
of rules are nested or disjoint, never crossing. Each interval's start and end is a
boundary row that carries the stack of rules active from there on (a rule and the
rules that enclose it; at an end, only those that enclose it). Boundary rows and
URLs are sorted together, and one sweep hands every URL the last stack seen. The
stack is then read from the inside out: the longest rule whose path begins the
URL's path decides.

Scale: URLs are dealt to sweeps by a hash of the whole URL, so a hot host is spread
over all of them; boundary rows are few (two per rule) and go to every sweep. Stacks
are built by equi-joins on host suffixes, not by comparing rules pairwise. One
shuffle of URLs, whose number of sweeps follows the input's size, no broadcast hints.

Defined cases: a null URL or one without ``://`` has empty host and path; without a
fitting rule the verdict is the default and the rule is null; repeated rows give
repeated results; an empty table gives no rows; of equal rules, or of an allow and a
block for the same host and path, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.session import shuffle_width

#: The rules of the registered query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_rows(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows (host, path, verdict)."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])))


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each ended by a dot."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """Rows (key, stack): from this key on, these rules are active, outermost first."""
    host = F.translate("host", UPPER, LOWER)
    r = rules.select(host_key(host).alias("key"), host.alias("host"), "path", "verdict").distinct()
    at = r.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("host", "path", "verdict"))).alias("own"))
    labels = F.filter(F.split("key", r"\.", -1), lambda x: F.lit(True))
    depth = F.size(labels) - 1
    up = at.select("key", F.explode(F.sequence(F.lit(1), depth)).alias("depth")).select(
        "key", "depth", F.expr("concat(substring_index(key, '.', depth), '.')").alias("above")
    )
    chain = up.join(at.select(F.col("key").alias("above"), "own"), "above").groupBy("key").agg(
        F.max("depth").alias("deepest"), F.array_sort(F.collect_list(F.struct("depth", "own"))).alias("chain")
    )
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["own"]))
    start = chain.select("key", flat(F.col("chain")).alias("stack"))
    end = chain.select(
        F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"),
        flat(F.filter("chain", lambda x: x["depth"] < F.col("deepest"))).alias("stack"),
    )
    return start.unionByName(end)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url)."""
    n = sweeps or shuffle_width(pages.select("page_id", "url"))
    point = pages.select("page_id", F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    point = point.select(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(n)).cast("int").alias("sweep"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path"
    )
    marks = boundaries(rules).withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("kind", F.lit(0))
    line = point.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = line.withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = F.filter("active", lambda x: F.col("path").startswith(x["path"]))
    ranked = F.transform(fits, lambda x: F.struct(F.length(x["host"]).alias("h"), F.length(x["path"]).alias("p"), x["verdict"].alias("verdict"), F.concat(x["host"], x["path"]).alias("rule")))
    won = swept.withColumn("won", F.array_max(ranked))
    return won.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, url, strpos(url, '://') AS mark FROM pages
), rest AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS tail FROM cut
), parts AS (
  SELECT page_id,
    translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(v, length(h) * 1000 + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f USING (page_id)
"""
