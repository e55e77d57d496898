"""Ledgers: summaries, integrity, pins, drift, rules as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): one histogram per field, in one pass with grouping sets; nulls are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(pairs.alias("p")).where("p.value is not null").groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def findings(rows: DataFrame, rules: list[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    """(level, code, message, location): one row for every (level, code, condition, message, location) that a row breaks; one pass."""
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), msg.alias("message"), loc.alias("location"))) for level, code, cond, msg, loc in rules]))
    return rows.select(F.explode(broken).alias("f")).select("f.*")


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("nth > 1").drop("nth")


def missing(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References to keys that don't exist."""
    return refs.join(known.select(key).distinct(), key, "left_anti")


def reuse(citations: DataFrame, minimum: int = 2) -> DataFrame:
    """(declaration, documents, occurrences) of what at least ``minimum`` documents cite."""
    return citations.groupBy("declaration").agg(F.count_distinct("document").alias("documents"), F.count(F.lit(1)).alias("occurrences")).where(F.col("documents") >= minimum)


def apply_probe(rows: DataFrame, refs: DataFrame, probe: DataFrame, defined: tuple[str, ...] = ("proved_in_build", "partially_in_build", "absent")) -> DataFrame:
    """(row, verification): rows (row, verification) with the state that their probed references (row, declaration) ask for.

    All resolved, some, none: the first of these states that fits and that the document
    defines. Rows without a probed reference, and rows that are ``not_applicable``, stay as they are.
    """
    seen = refs.join(probe, "declaration").groupBy("row").agg(F.count_if("resolved").alias("ok"), F.count(F.lit(1)).alias("n"))
    fits = {"proved_in_build": F.col("ok") == F.col("n"), "partially_in_build": F.col("ok") > 0, "absent": F.col("ok") == 0}
    state = F.coalesce(*[F.when(fits[s] & (F.col("verification").isNull() | (F.col("verification") != "not_applicable")), s) for s in fits if s in defined], F.col("verification"))
    return rows.join(seen, "row", "left").select("row", state.alias("verification"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change): added, removed or moved (another module)."""
    both = old.select("name", F.col("module").alias("was")).join(new.select("name", F.col("module").alias("now")), "name", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "moved")
    return both.select("name", change.alias("change")).where("change is not null")


def baseline(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """(key, status): new findings, accepted ones, and stale acceptances."""
    both = found.select("key", F.lit(True).alias("f")).join(accepted.select("key", F.lit(True).alias("a")), "key", "full_outer")
    return both.select("key", F.when(F.col("a").isNull(), "new").when(F.col("f").isNull(), "stale").otherwise("accepted").alias("status"))


def pin_status(pins: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, status): ok, drifted (another hash than accepted) or gone."""
    now = texts.select("key", F.sha2(normalised(F.col("text")), 256).alias("now"))
    return pins.join(now, "key", "left").select("key", F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("sha256"), "ok").otherwise("drifted").alias("status"))


def normalised(text: Column) -> Column:
    """Line ends unified, trailing blanks and outer blank lines dropped."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unified, "(?m)[ \t]+$", ""), "^\n+|\n+$", "")
