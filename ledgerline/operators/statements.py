"""Statement records: typed closures, roles, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise


def expands() -> Column:
    """Definitions and inductives are unfolded, boundaries and missing records aren't."""
    return F.col("kind").isin("def", "inductive") & ~F.coalesce("boundary", F.lit(False)) & ~F.coalesce("missing", F.lit(False))


def plumbing() -> Column:
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return F.array_contains(flags, "instance") | F.array_contains(flags, "projection") | (F.col("kind") == "ctor")


def children(records: DataFrame) -> DataFrame:
    """(src, dst, role): what a statement's type names (type), and what only its body names (body)."""
    none = F.array().cast("array<string>")
    types, bodies = F.coalesce("type_deps", none), F.array_except(F.coalesce("body_deps", none), F.coalesce("type_deps", none))
    tagged = F.concat(F.transform(types, lambda x: F.struct(x.alias("dst"), F.lit("type").alias("role"))), F.transform(F.when(F.col("kind").isin("def", "inductive"), bodies).otherwise(none), lambda x: F.struct(x.alias("dst"), F.lit("body").alias("role"))))
    return records.where("not coalesce(missing, false)").select(F.col("name").alias("src"), F.explode(tagged).alias("c")).select("src", "c.dst", "c.role")


def closure_edges(records: DataFrame, seed: str) -> DataFrame:
    """Typed edges met from a seed: the seed and what expands are unfolded; edges to what is already known are kept."""
    step = materialise(children(records), "children")
    open_ = records.where(expands()).select("name")
    spark = records.sparkSession
    front = spark.range(1).select(F.lit(seed).alias("name"))
    done, out = front, None
    while True:
        found = materialise(step.join(front.select(F.col("name").alias("src")), "src", "left_semi"), "typed")
        out = found if out is None else out.unionByName(found)
        front = materialise(found.select(F.col("dst").alias("name")).distinct().join(open_, "name", "left_semi").join(done, "name", "left_anti"), "typed-front")
        if front.isEmpty():
            return out.distinct()
        done = materialise(done.unionByName(front), "typed-done")


def closure_summary(records: DataFrame, seed: str) -> DataFrame:
    """(name, part) of what is reached: unknown, plumbing, boundary, unfolded or leaf, the first that holds."""
    reached = closure_edges(records, seed).select(F.col("dst").alias("name")).where(F.col("name") != seed).distinct()
    known = records.select("name", F.when(F.coalesce("missing", F.lit(False)), "unknown").when(plumbing(), "plumbing").when(F.coalesce("boundary", F.lit(False)), "boundary").when(expands(), "unfolded").otherwise("leaf").alias("part"))
    return reached.join(known, "name", "left").select("name", F.coalesce("part", F.lit("unknown")).alias("part"))


def dependency_role(dep: Column) -> Column:
    """type, proof, or unknown where types weren't indexed."""
    return F.when(F.col("type_deps").isNull(), "unknown").when(F.array_contains("type_deps", dep), "type").otherwise("proof")


def pin_states(pins: DataFrame, records: DataFrame, claimed: DataFrame) -> DataFrame:
    """(declaration, status): the structural hash is judged first, the text only if it is equal; claims without a pin are unpinned."""
    now = records.select(F.col("name").alias("declaration"), "type_expr_hash", F.sha2("type", 256).alias("text_hash"), F.coalesce("missing", F.lit(False)).alias("gone"))
    p = pins.select("declaration", F.col("type_expr_hash").alias("pin_hash"), F.col("type_text_sha256").alias("pin_text"))
    both = p.join(now, "declaration", "left")
    status = F.when(F.col("gone").isNull() | F.col("gone"), "declaration-gone").when(F.col("pin_hash") != F.col("type_expr_hash"), "statement-drift").when(F.col("pin_text") != F.col("text_hash"), "text-drift").otherwise("current")
    open_ = claimed.select("declaration").distinct().join(p, "declaration", "left_anti").select("declaration", F.lit("unpinned").alias("status"))
    return both.select("declaration", status.alias("status")).unionByName(open_)
