"""Statement pins: the hashes a declaration's statement had when it was reviewed, renewed and compared with what it has now.

Pins are (target, nth, declaration, type_expr_hash, type_text_sha256, toolchain, pinned_on, note), records (name, type_expr_hash, type_text_sha256, missing),
targets (target, nth, declaration), one row for each declaration a target claims.

Scale: equi-joins on (target, declaration) and on the name; a declaration's record is one row, so a popular declaration is a hot key of a join to one row, which AQE splits.

Defined cases: a target whose only declaration is null loses its pins; pins of targets that aren't asked for stay; a declaration repeated within a target
counts once, by its first place; of several pins of one declaration the first gives its note when pins are renewed, the last is the one that is judged; a null hash never agrees;
of several records of one name that with the least hashes counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["target", "nth", "declaration", "type_expr_hash", "type_text_sha256", "toolchain", "pinned_on", "note"]


def _current(records: DataFrame) -> DataFrame:
    some = records.where("name is not null and not coalesce(missing, false)").groupBy(F.col("name").alias("declaration")).agg(F.min(F.struct("type_expr_hash", "type_text_sha256")).alias("r"))
    return some.select("declaration", F.col("r.type_expr_hash").alias("now_expr"), F.col("r.type_text_sha256").alias("now_text"), F.lit(True).alias("known"))


def _claimed(targets: DataFrame) -> DataFrame:
    return targets.where("target is not null and declaration is not null").groupBy("target", "declaration").agg(F.min("nth").alias("nth"))


def renew(targets: DataFrame, pins: DataFrame, records: DataFrame, on: str, toolchain: str = "", note: str = "") -> tuple[DataFrame, DataFrame]:
    """The pins after renewal, and findings (severity, code, target, declaration); a note that stands is kept unless a new one is given."""
    met = _claimed(targets).join(_current(records), "declaration", "left")
    noted = pins.groupBy("target", "declaration").agg(F.min(F.struct("nth", "note")).getField("note").alias("old"))
    fresh = met.where("known").join(noted, ["target", "declaration"], "left").select(
        "target", "nth", "declaration", F.col("now_expr").alias("type_expr_hash"), F.col("now_text").alias("type_text_sha256"),
        F.lit(toolchain).alias("toolchain"), F.lit(on).alias("pinned_on"), (F.lit(note) if note else F.when(F.col("old") != "", F.col("old"))).alias("note"),
    )
    others = pins.join(targets.select("target").distinct(), "target", "left_anti").select(*FIELDS)
    lost = met.where("known is null").select(F.lit("error").alias("severity"), F.lit("statement-pin-missing").alias("code"), "target", "declaration")
    return others.unionByName(fresh), lost


def judged(targets: DataFrame, pins: DataFrame, records: DataFrame) -> DataFrame:
    """(target, declaration, claimed, pinned_on, state) of every claim and every pin of the targets: unpinned, current, text-drift, drift or gone."""
    asked = pins.where("declaration is not null").join(targets.select("target").distinct(), "target", "left_semi")
    last = asked.withColumn("n", F.row_number().over(Window.partitionBy("target", "declaration").orderBy(F.desc("nth"), F.desc("pinned_on"), "type_expr_hash", "type_text_sha256"))).where("n = 1")
    last = last.select("target", "declaration", "type_expr_hash", "type_text_sha256", "pinned_on", F.lit(True).alias("pinned"))
    both = _claimed(targets).select("target", "declaration", F.lit(True).alias("claimed")).join(last, ["target", "declaration"], "full").join(_current(records), "declaration", "left")
    agree = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    state = (
        F.when(F.col("pinned").isNull(), "unpinned").when(F.col("known").isNull(), "gone")
        .when(~agree("type_expr_hash", "now_expr"), "drift").when(~agree("type_text_sha256", "now_text"), "text-drift").otherwise("current")
    )
    return both.select("target", "declaration", F.coalesce("claimed", F.lit(False)).alias("claimed"), "pinned_on", state.alias("state"))


#: States with their severity and code.
FINDINGS = [("unpinned", "warning", "statement-unpinned"), ("gone", "error", "statement-pin-gone"), ("drift", "error", "statement-drift"), ("text-drift", "warning", "statement-text-drift")]


def findings(targets: DataFrame, pins: DataFrame, records: DataFrame) -> DataFrame:
    """(severity, code, target, declaration)."""
    pick = lambda n: F.coalesce(*[F.when(F.col("state") == row[0], row[n]) for row in FINDINGS])
    return judged(targets, pins, records).where("state <> 'current'").select(pick(1).alias("severity"), pick(2).alias("code"), "target", "declaration")
