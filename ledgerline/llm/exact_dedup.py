"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so (a boundary pair between a minimum
and a maximum length), so equal passages give equal chunks wherever they stand.
A chunk's identifier is a 64-bit hash; identifiers are *verified* over the whole corpus
against the chunk's length and 128 bits of its SHA-256, and where one stands for two
contents, those bits join it. A document becomes the ordered list of its chunks'
identifiers, its recipe. Equal recipes are equal texts; after the one scan that cuts them
no text moves again, only recipes do.

Scale: one scan, one aggregation keyed by chunk (fixed-width buffers, combined map-side, so
a hot chunk is one row per task), one aggregation keyed by recipe over two narrow columns,
and one join by recipe (AQE splits a recipe that a third of all rows share). Nothing is
broadcast by hint.

Defined cases: null text counts as empty; empty texts are equal to one another; a
text shorter than the minimum is one chunk; ties on ``doc_id`` keep every row with
that id marked kept; an empty table gives no rows; other columns of the input are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise

MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A chunk ends after one of these characters followed by a space-like character: content decides, not position.
BOUNDARY = r"[.,;:!?ndst]\s"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK, boundary: str = BOUNDARY) -> str:
    return rf"(?s).{{{least},{most - 2}}}?{boundary}|.{{1,{most}}}"


def chunks(text: Column, pattern: str) -> Column:
    """The text cut at content-defined boundaries, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, pattern: str, identifier: Callable[[Column], Column]) -> DataFrame:
    """doc_id, the text's digest, and of its chunks: identifiers, lengths, and two longs from their SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), chunks(text, pattern).alias("cut"))
    sha = lambda c: F.sha2(c, 256)
    return cut.select(
        "doc_id", "digest", F.transform("cut", identifier).alias("ids"), F.transform("cut", lambda c: F.octet_length(c)).alias("n"), F.transform("cut", lambda c: F.xxhash64(sha(c))).alias("v"), F.transform("cut", lambda c: F.xxhash64(F.lit(1), sha(c))).alias("w")
    )


def clashing(cut: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk content."""
    one = cut.select(F.explode(F.arrays_zip("ids", "n", "v", "w")).alias("c")).select("c.*")
    seen = one.groupBy("ids").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("n", "v", "w") for f in (F.min, F.max)])
    return seen.where("n_min < n_max or v_min < v_max or w_min < w_max").select(F.col("ids").alias("id"))


def short_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_dedup(docs: DataFrame, pattern: str | None = None, identifier: Callable[[Column], Column] = short_id) -> DataFrame:
    """Groups of documents whose recipes are equal.

    Returns doc_id, keep_id (the largest doc_id of the group), group_size, kept,
    text_sha256, n_chunks: one row per input row.
    """
    cut = materialise(recipes(docs, pattern or chunk_pattern(), identifier), "op10-recipes")
    bad = materialise(clashing(cut), "op10-clashes", small=True)
    if bad.isEmpty():
        listed = cut.select("doc_id", "digest", F.size("ids").alias("n"), F.col("ids").alias("recipe"))
    else:
        # An unverified identifier is followed by its chunk's digest bits and length.
        numbered = cut.withColumn("row", F.monotonically_increasing_id())
        hit = numbered.select("row", F.explode("ids").alias("id")).join(bad, "id").groupBy("row").agg(F.collect_set("id").alias("clashes"))
        whole = F.flatten(F.transform(F.arrays_zip("ids", "n", "v", "w"), lambda c: F.when(F.array_contains("clashes", c["ids"]), F.array(c["ids"], c["v"], c["w"], c["n"].cast("long"))).otherwise(F.array(c["ids"]))))
        listed = numbered.join(hit, "row", "left").select("doc_id", "digest", F.size("ids").alias("n"), F.when(F.col("clashes").isNull(), F.col("ids")).otherwise(whole).alias("recipe"))
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return listed.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("n").cast("long").alias("n_chunks")
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
