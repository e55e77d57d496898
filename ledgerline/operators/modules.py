"""Import graphs of modules: closures, policies, coverage, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import graph, pairs


def import_closure(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """(seed, node, distance): what each root module reaches through imports (module, dep)."""
    return graph.walk(imports.select(F.col("module").alias("src"), F.col("dep").alias("dst")), roots)


def closure_overlap(closures: DataFrame) -> DataFrame:
    """(a, b, common) for two roots whose closures meet."""
    return pairs.common(closures.withColumnRenamed("seed", "owner"))


def policy_violations(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, module, dep) of direct imports that a rule's (rule, from_prefix, deny_prefix) dotted prefixes forbid.

    Prefixes of a name are enumerated, so both sides meet by equi-joins.
    """
    def prefixes(column: str):
        parts = F.split(column, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.concat_ws(".", F.slice(parts, 1, d)))

    hit = imports.withColumn("from_prefix", F.explode(prefixes("module"))).join(rules, "from_prefix")
    return hit.where(F.array_contains(prefixes("dep"), F.col("deny_prefix"))).select("rule", "module", "dep").distinct()


def coverage_partition(scope: DataFrame, closure: DataFrame, excluded: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, status): covered, excluded, inherited (reaches an excluded one) or uncovered."""
    reaches = graph.walk(imports.select(F.col("dep").alias("src"), F.col("module").alias("dst")), excluded.select(F.col("module").alias("node"))).select(F.col("node").alias("module")).distinct()
    flag = lambda d, name: d.select("module").distinct().withColumn(name, F.lit(True))
    joined = scope.select("module").distinct().join(flag(closure, "c"), "module", "left").join(flag(excluded, "e"), "module", "left").join(flag(reaches, "i"), "module", "left")
    return joined.select("module", F.when(F.col("c"), "covered").when(F.col("e"), "excluded").when(F.col("i"), "inherited").otherwise("uncovered").alias("status"))


def rungs(imports: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, rung): the first rung (columns rung, node) whose dependency closure holds a module."""
    walked = graph.walk(imports.select(F.col("module").alias("src"), F.col("dep").alias("dst")), seeds.select(F.col("rung").alias("seed"), "node"))
    return walked.groupBy("node").agg(F.min("seed").alias("rung"))
