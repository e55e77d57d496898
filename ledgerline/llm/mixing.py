"""Mixing sources to target weights by capped water-filling.

Sizes are words. Every source asks for a share of the total by weight; a source may
be repeated at most ``max_epochs`` times. Rounds of water-filling clamp the sources
whose share exceeds their cap and reshare the excess among the others by weight,
until none is above. Each round is one aggregate over the per-source table, whose
rows are already summed, so a source that holds a third of all rows costs no more.

A source's rate ``target / size`` splits into whole repetitions and a fraction. All
documents take the whole part; the fraction is drawn by seeded order: documents are
ordered by a hash of (seed, doc_id) and taken until the wanted words are reached.
That order is resolved in two steps so that no source is ever sorted in one task:
words per (source, one of 65,536 hash buckets) first, then only documents of the one
bucket in which a source's limit falls. One last document, the nearest in size to what is
still wanting, closes the gap. The draw depends on ids and the seed alone,
so reruns agree whatever the partitioning; if ids repeat or several are missing, it depends on each row's place
in its file as well, and reruns over the same files agree.

Defined cases: null and empty text have size 0 and are taken 0; a null source is a
source of its own; a source whose words are all zero has target 0; rows that repeat a
doc_id, or have none, are drawn one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.llm.blocks import numbered

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 16
SEED = 20240229


def word_count(text: Column) -> Column:
    """Words of a text: places where a non-space follows a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights_by_rank(sources: DataFrame, cycle=(1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, repeating, over sources by code point, null last. One row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    return sources.withColumn("weight", pick)


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, size, weight): proportional shares under caps.

    The loop ends after at most as many rounds as there are distinct cap-to-weight
    ratios; every round's state is one row (what is left to share, weight still open).
    """
    cap = F.lit(float(max_epochs)) * F.col("size")
    total = sources.agg(F.sum("size").cast("double")).first()[0] or 0.0
    level = 0.0
    while True:
        # Clamped: those that the present level already fills; the level never falls.
        full = F.col("weight") * F.lit(level) >= cap
        held, open_weight = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - held) / open_weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.when(F.col("size") > 0, F.least(cap, F.col("weight") * F.lit(level))).otherwise(0.0))


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = SEED, weights=weights_by_rank) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``."""
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count()
    placed = numbered(docs) if repeats else docs.withColumn("row", F.lit(0).cast("long"))
    draw = F.xxhash64(F.lit(seed), "doc_id", "row") if repeats else F.xxhash64(F.lit(seed), "doc_id")
    sized = materialise(
        placed.select("doc_id", "row", "source", word_count(F.col("text")).alias("size"), draw.alias("draw")).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 16), F.lit(BUCKETS)).cast("int")),
        "op4-sizes",
    )
    sources = materialise(sized.groupBy("source").agg(F.sum("size").alias("size")), "op4-sources", small=True)
    goal = water_fill(weights(sources), max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
    goal = goal.select("source", F.col("size").alias("source_size"), "target", "whole", (F.col("target") - F.col("whole") * F.col("size")).alias("want"))

    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    filled = sized.where("size > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumn("after", F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
    edge = filled.alias("f").join(goal.alias("g"), same("f", "g")).select(
        "f.source", "f.bucket", "f.before", "f.after", "g.source_size", "g.target", "g.whole", "g.want"
    )
    every = sized.alias("d").join(edge.alias("e"), same("d", "e") & (F.col("d.bucket") == F.col("e.bucket")) & (F.col("d.size") > 0)).select(
        "d.doc_id", "d.row", "d.source", "d.size", "d.draw", "d.bucket", "e.before", "e.after", "e.source_size", "e.target", "e.whole", "e.want"
    )
    at_limit = F.expr("after > want and before < want")
    settled = every.where(~at_limit).withColumn("extra", F.when(F.col("after") <= F.col("want"), 1).otherwise(0))
    split = every.where(at_limit)
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("before") + F.sum("size").over(within)
    split = split.withColumn("extra", F.when(reached <= F.col("want"), 1).otherwise(0))
    drawn = materialise(settled.unionByName(split), "op4-drawn")
    # What is still wanting after the last document that fits whole: the one document left whose size comes nearest to it.
    lack = drawn.groupBy("source").agg((F.first("want") - F.sum(F.col("extra") * F.col("size"))).alias("lack")).where("lack > 0")
    open_ = drawn.where("extra = 0").alias("d").join(lack.alias("l"), same("d", "l")).where(F.abs(F.col("l.lack") - F.col("d.size")) < F.col("l.lack"))
    last = open_.groupBy("d.source").agg(F.min_by(F.struct("d.doc_id", "d.row", "d.draw", "d.size"), F.struct(F.abs(F.col("l.lack") - F.col("d.size")), F.col("d.draw"), F.col("d.doc_id"), F.col("d.row"))).alias("x"))
    last = last.select(F.col("source"), F.col("x.doc_id").alias("doc_id"), F.col("x.row").alias("row"), F.col("x.draw").alias("draw"), F.col("x.size").alias("size"))
    chosen = same("d", "x") & F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.row") == F.col("x.row")) & (F.col("d.draw") == F.col("x.draw")) & (F.col("d.size") == F.col("x.size")) & (F.col("d.extra") == 0)
    drawn = drawn.alias("d").join(last.alias("x"), chosen, "left").select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", "d.whole", F.when(F.col("x.size").isNotNull(), 1).otherwise(F.col("d.extra")).alias("extra"))
    none = sized.where("size = 0").alias("d").join(goal.alias("g"), same("d", "g")).select("d.doc_id", "d.source", "d.size", "g.source_size", "g.target", F.lit(0).cast("long").alias("copies"))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies")]
    out = drawn.select(*cols).unionByName(none)
    return out.withColumn("taken", F.col("size") * F.col("copies"))
