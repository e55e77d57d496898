"""Delivery of a roadmap: which suggested declarations a project has, and where.

Suggestions are (topic, name, nth); a project's declarations (name, path, module). A suggestion meets the declarations of its name, else those of its last
part, and of these only the ones in the libraries asked for. Of several the first counts by preferred place, depth of the path, then path; all of them,
in that order, are kept as the ambiguity.

Scale: two equi-joins; a suggestion's candidates are gathered, which are the declarations that share its last part. Topics are sums.

Defined cases: a suggestion that repeats within a topic counts once, by its first place; an exact name that lies outside the libraries
doesn't fall back to its last part; null names and paths are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(path: Column, module: Column, prefix: str) -> Column:
    """Whether a declaration lies in a folder or a module, or is it."""
    folder, unit = prefix.rstrip("/"), prefix.rstrip(".")
    return (path == folder) | path.startswith(folder + "/") | (module == unit) | module.startswith(unit + ".")


def delivery(suggested: DataFrame, decls: DataFrame, libraries: tuple[str, ...] = (), preferred: tuple[str, ...] = ()) -> DataFrame:
    """(topic, name, nth, path, candidates): the place of each suggestion, null where it is missing; candidates where there are several, the best first."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    wanted = suggested.where("name is not null").groupBy("topic", "name").agg(F.min("nth").alias("nth"))
    path, module = F.col("path"), F.coalesce("module", F.lit(""))
    inside = F.lit(True)
    for i, prefix in enumerate(libraries):
        inside = within(path, module, prefix) if not i else inside | within(path, module, prefix)
    place = F.coalesce(*[F.when(within(path, module, p), F.lit(i)) for i, p in enumerate(preferred)], F.lit(len(preferred)))
    known = decls.where("name is not null and path is not null").select("name", last(F.col("name")).alias("tail"), inside.alias("inside"), F.struct(place.alias("place"), F.size(F.split("path", "/")).alias("depth"), "path").alias("rank"))
    exact = known.select(F.col("name"), "inside", "rank")
    names = wanted.select("name").distinct()
    by_name = names.join(exact, "name")
    short = names.join(exact.select("name").distinct(), "name", "left_anti").withColumn("tail", last(F.col("name"))).join(known.select("tail", "inside", "rank"), "tail").select("name", "inside", "rank")
    met = by_name.unionByName(short).where("inside").groupBy("name").agg(F.transform(F.array_sort(F.collect_list("rank")), lambda x: x["path"]).alias("paths"))
    found = wanted.join(met, "name", "left")
    return found.select("topic", "name", "nth", F.get("paths", F.lit(0)).alias("path"), F.when(F.size("paths") > 1, F.col("paths")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def topics(delivered: DataFrame) -> DataFrame:
    """(topic, total, delivered, ambiguous)."""
    return delivered.groupBy("topic").agg(F.count(F.lit(1)).alias("total"), F.count("path").alias("delivered"), F.count_if(F.size("candidates") > 1).alias("ambiguous"))
