"""Build logs and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import without_control

#: The two header forms of a diagnostic line.
HEADERS = (r"^(error|warning|info): ([^\n:]+):([0-9]+):([0-9]+): (.*)$", r"^([^\n:]+):([0-9]+):([0-9]+): (error|warning|info): (.*)$")


def parse_headers(lines: DataFrame) -> DataFrame:
    """(n, severity, file, line_no, col, message) of diagnostic header lines (n, line)."""
    a, b = HEADERS
    first, second = F.col("line").rlike(a), F.col("line").rlike(b)
    pick = lambda i, j: F.when(first, F.regexp_extract("line", a, i)).when(second, F.regexp_extract("line", b, j))
    return lines.where(first | second).select("n", pick(1, 4).alias("severity"), pick(2, 1).alias("file"), pick(3, 2).cast("int").alias("line_no"), pick(4, 3).cast("int").alias("col"), pick(5, 5).alias("message"))


# The forms of a diagnostic's two headers, of progress and of a build's own summaries.
SEVERITY = "(?:error|warning|info|trace)"
LOCATED = r"^(.+):([0-9]+):([0-9]+):\s*"
PROGRESS = r"^\s*(?:[✓✔✖✗⏳]\s+)?\[?[0-9]+/[0-9]+\]?(?:\s+|$)"
BUILD_FAILED = r"^error:\s*(?:Lean exited with code -?[0-9]+|build failed)\s*$"
SUMMARY = r"^(?:Some required targets logged failures:|Required targets failed:)$"


def parse_output(lines: DataFrame, by: str = "run") -> tuple[DataFrame, DataFrame]:
    """Diagnostics with their bodies, and every line's role, of logs (by, n, line).

    Diagnostics: (by, ordinal, n, severity, file, line_no, col, message, body); a body is the
    lines up to the next header, progress mark or summary, without blank edges. Roles:
    (by, n, role), one of header, body, synthetic (the build's own lines) and other (before
    any header). A log is one window partition, as its lines only mean something in order.
    """
    order = Window.partitionBy(by).orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    heads = line.rlike(SUMMARY)
    item = line.rlike(r"^\s*-\s+")
    marked = lines.withColumn("line", without_control(line)).withColumns({"heads": heads, "item": item})
    # an item belongs to a summary while nothing but items stands between them
    marked = marked.withColumn("block", F.sum((~F.col("item")).cast("int")).over(so_far))
    marked = marked.withColumn("listed", F.max(F.col("heads")).over(Window.partitionBy(by, "block")) & F.col("item"))
    synthetic = F.col("heads") | F.col("listed") | line.rlike(BUILD_FAILED) | line.rlike(PROGRESS)
    suffix, prefix = line.rlike(rf"{LOCATED}{SEVERITY}:\s*"), line.rlike(rf"^{SEVERITY}:\s*")
    role = F.when(synthetic, "synthetic").when(suffix | prefix, "header")
    marked = marked.withColumn("role", role)
    marked = marked.withColumns({"last": F.last("role", ignorenulls=True).over(so_far), "ordinal": F.sum((F.col("role") == "header").cast("int")).over(so_far)})
    marked = marked.withColumn("role", F.coalesce("role", F.when(F.col("last") == "header", "body").otherwise("other")))
    return diagnostics(marked, by), marked.select(by, "n", "role")


def diagnostics(marked: DataFrame, by: str = "run") -> DataFrame:
    """Diagnostics of lines that have their roles and ordinals (by, n, line, role, ordinal), from a whole log or as a stream gave them."""
    line = F.col("line")
    suffix = line.rlike(rf"{LOCATED}{SEVERITY}:\s*")
    rest = F.regexp_extract("line", rf"^{SEVERITY}:\s*(.*)$", 1)
    part = lambda i: F.when(suffix, F.regexp_extract("line", LOCATED, i)).when(rest.rlike(LOCATED), F.regexp_extract(rest, LOCATED, i))
    severity = F.when(suffix, F.regexp_extract("line", rf"{LOCATED}({SEVERITY}):", 4)).otherwise(F.regexp_extract("line", rf"^({SEVERITY}):", 1))
    message = F.when(suffix, F.regexp_extract("line", rf"{LOCATED}{SEVERITY}:\s*(.*)$", 4)).when(rest.rlike(LOCATED), F.regexp_extract(rest, rf"{LOCATED}(.*)$", 4)).otherwise(rest)
    head = F.struct("n", severity.alias("severity"), part(1).alias("file"), part(2).cast("int").alias("line_no"), part(3).cast("int").alias("col"), F.trim(message).alias("message"))
    found = marked.where("role in ('header', 'body')").groupBy(by, "ordinal").agg(F.min(F.when(F.col("role") == "header", head)).alias("h"), F.array_sort(F.collect_list(F.when(F.col("role") == "body", F.struct("n", "line")))).alias("lines"))
    text = F.transform("lines", lambda x: x["line"])
    solid = F.array_compact(F.transform(text, lambda x, i: F.when(F.trim(x) != "", i)))
    body = F.when(F.size(solid) == 0, F.array().cast("array<string>")).otherwise(F.slice(text, F.array_min(solid) + 1, F.array_max(solid) - F.array_min(solid) + 1))
    return found.select(by, "ordinal", "h.*", body.alias("body"))


def deduplicate_diagnostics(found: DataFrame) -> DataFrame:
    """Equal diagnostics, bodies included, as the first of them, with how often they came and in which runs."""
    key = ["severity", "file", "line_no", "col", "message", "body"]
    return found.groupBy(*key).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("repeats"), F.array_sort(F.collect_set("run")).alias("runs"))


def progress(lines: DataFrame) -> DataFrame:
    """(n, done, total) of progress marks; null where done exceeds the total."""
    done, total = (F.regexp_extract("line", r"\[([0-9]+)/([0-9]+)\]", i) for i in (1, 2))
    return lines.where(F.col("line").rlike(r"\[[0-9]+/[0-9]+\]")).select("n", F.when(done.cast("int") <= total.cast("int"), done.cast("int")).alias("done"), F.when(done.cast("int") <= total.cast("int"), total.cast("int")).alias("total"))


def deduplicate(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, and how often it came."""
    return rows.groupBy(*key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("repeats"))


def gap_clusters(rows: DataFrame, by: str, position: str, gap: int) -> DataFrame:
    """(by, cluster, n, first, last): runs of positions no more than ``gap`` apart."""
    order = Window.partitionBy(by).orderBy(position)
    far = rows.withColumn("new", F.coalesce((F.col(position) - F.lag(position).over(order) > gap).cast("int"), F.lit(1)))
    numbered = far.withColumn("cluster", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"), F.max(position).alias("last"))


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys, least key first on ties."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)
