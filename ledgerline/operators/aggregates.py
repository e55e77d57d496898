"""Aggregates of a folder tree: for each folder the module that imports all below it, as it should be, against what is there.

A folder's aggregate imports the aggregates of the folders in it, then its own modules, then what it already re-exports from other libraries. A module that
reaches its own folder's aggregate can't stand there without a ring; it goes to the folder above, which takes it as it is; in the base folder it has no place.

Scale: imports are walked backwards from the aggregates up to the next aggregate; which aggregates reach which is found among them alone; the rest
are equi-joins and sums. A line is a row, so that a wide folder isn't gathered; only its order is set in one sorted window, which spills.

Defined cases: null modules and imports are left out; a module or an import that repeats counts once, by its first place; a folder that holds nothing to
import has no aggregate, though the folder above names it if it has modules at any depth; a tree without modules has no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.operators import graph


class Aggregates(NamedTuple):
    """lines (aggregate, place, module): what each should import. status (aggregate, state, lines, dangling, unplaceable): current, stale or missing.
    notes (aggregate, kind, module): dangling re-exports, modules promoted to an aggregate, modules without a place."""

    lines: DataFrame
    status: DataFrame
    notes: DataFrame


def _up(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _held(own: DataFrame, imports: DataFrame, heads: DataFrame) -> DataFrame:
    """The modules (columns module and aggregate of own) that reach their folder's aggregate (column ``module`` of heads).

    A module enters the aggregates by the first ones on its ways, which it reaches through modules that are none; from there on it is the
    aggregates' matter which of them reaches which, and that is found once for all modules.
    """
    plain = imports.join(heads, "module", "left_anti")
    entered = plain.join(heads.withColumnRenamed("module", "dep"), "dep", "left_semi").select(F.col("dep").alias("node")).distinct()
    entry = graph.walk(plain.select(F.col("dep").alias("src"), F.col("module").alias("dst")), entered).where("distance > 0")
    entry = materialise(entry.select(F.col("node").alias("module"), F.col("seed").alias("entry")), "entries")
    of_heads = imports.join(heads, "module", "left_semi")
    straight = of_heads.join(heads.withColumnRenamed("module", "dep"), "dep", "left_semi").select("dep", "module")
    through = of_heads.join(entry.withColumnRenamed("module", "dep"), "dep").select(F.col("entry").alias("dep"), "module")
    among = straight.unionByName(through).distinct().select(F.col("dep").alias("src"), F.col("module").alias("dst"))
    ahead = graph.walk(among, own.select(F.col("aggregate").alias("node")).distinct()).select(F.col("seed").alias("aggregate"), F.col("node").alias("entry"))
    return own.join(entry, "module").join(ahead, ["aggregate", "entry"], "left_semi").drop("entry").distinct()


def check(
    modules: DataFrame, imports: DataFrame, base: str, library: str | None = None, name: str = "All", skip: Iterable[str] = (),
    reexports: bool = True, root_import: str | None = None, respect_cycles: bool = True,
) -> Aggregates:
    """Aggregates under the dotted folder ``base`` of a repository's modules (module) and imports (module, dep, nth), nothing written.

    ``skip`` names folders that are left out, with the module of the same name beside them; ``library`` is what counts as one's own (by default base's first part).
    """
    library, skip = library or base.split(".")[0], list(skip)
    depth = base.count(".") + 1
    modules = materialise(modules.where("module is not null").select("module").distinct(), "modules")
    imports = materialise(imports.where("module is not null and dep is not null").groupBy("module", "dep").agg(F.min("nth").alias("nth")), "imports")
    skipped = lambda parts: F.arrays_overlap(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))), F.array(*[F.lit(x) for x in skip]).cast("array<string>"))

    below = modules.where(F.col("module").startswith(base + ".")).withColumn("parts", F.split("module", r"\."))
    above = F.transform(F.sequence(F.lit(depth), F.size("parts") - 1), lambda i: F.slice("parts", 1, i))
    every = below.select(F.explode(above).alias("parts")).distinct().select(F.array_join("parts", ".").alias("folder"), skipped(F.col("parts")).alias("out"))
    every = materialise(every, "folders")
    folders = every.where("not out").select("folder")
    heads = folders.select(F.concat("folder", F.lit("." + name)).alias("aggregate"), "folder")
    present = heads.join(modules.withColumnRenamed("module", "aggregate"), "aggregate", "left_semi")

    own = below.select("module", _up(F.col("module")).alias("folder")).where(_last(F.col("module")) != name).join(folders, "folder", "left_semi")
    own = own.join(every.where("out").select(F.col("folder").alias("module")), "module", "left_anti").select("folder", "module", F.concat("folder", F.lit("." + name)).alias("aggregate"))
    if respect_cycles:
        known = heads.select(F.col("aggregate").alias("module"))  # an aggregate may be imported before it exists
        held = materialise(_held(own, imports.select("module", "dep"), known).select(own.columns), "deferred")
        own = own.join(held, ["aggregate", "module"], "left_anti")
    else:
        held = own.where(F.lit(False))
    raised = held.where(F.col("folder") != base).select(F.concat(_up(F.col("folder")), F.lit("." + name)).alias("aggregate"), "module")
    stuck = held.where(F.col("folder") == base).select("aggregate", "module")

    mine = (F.col("dep") == library) | F.col("dep").startswith(library + ".")
    foreign = imports.withColumnRenamed("module", "aggregate").join(present.select("aggregate"), "aggregate", "left_semi").where(~mine).select("aggregate", F.col("dep").alias("module"))
    if not reexports:
        foreign = foreign.where(F.lit(False))
    kept, dangling = foreign.join(modules, "module", "left_semi").select("aggregate", "module"), foreign.join(modules, "module", "left_anti").select("aggregate", "module")

    child = folders.where(F.col("folder") != base).select(F.concat(_up(F.col("folder")), F.lit("." + name)).alias("aggregate"), F.concat("folder", F.lit("." + name)).alias("module"), F.lit(1).alias("part"), _last(F.col("folder")).alias("by"))
    leaves = own.select("aggregate", "module").unionByName(raised).unionByName(kept).select("aggregate", "module", F.lit(2).alias("part"), _last(F.col("module")).alias("by"))
    listed = child.unionByName(leaves)
    if root_import:
        listed = listed.unionByName(heads.where(F.col("folder") == base).select("aggregate", F.lit(root_import).alias("module"), F.lit(0).alias("part"), F.lit("").alias("by")))
    once = listed.groupBy("aggregate", "module").agg(F.min(F.struct("part", "by")).alias("k"))
    lines = materialise(once.select("aggregate", F.row_number().over(Window.partitionBy("aggregate").orderBy("k", "module")).alias("place"), "module"), "lines")

    order = F.row_number().over(Window.partitionBy("aggregate").orderBy("nth", "module"))
    there = imports.select(F.col("module").alias("aggregate"), F.col("dep").alias("module"), "nth").join(present.select("aggregate"), "aggregate", "left_semi").select("aggregate", order.alias("place"), F.col("module").alias("was"))
    compared = lines.join(there, ["aggregate", "place"], "full").groupBy("aggregate").agg(F.count("module").alias("lines"), F.count_if(~F.col("module").eqNullSafe(F.col("was"))).alias("differ"))
    tag = lambda df, kind: df.select("aggregate", F.lit(kind).alias("kind"), "module")
    notes = tag(dangling, "dangling").unionByName(tag(raised, "promoted")).unionByName(tag(stuck, "unplaceable"))
    counts = notes.groupBy("aggregate").agg(F.count_if(F.col("kind") == "dangling").alias("dangling"), F.count_if(F.col("kind") == "unplaceable").alias("unplaceable"))
    whole = compared.where("lines > 0").join(present.select("aggregate", F.lit(True).alias("there")), "aggregate", "left").join(counts, "aggregate", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("differ") > 0, "stale").otherwise("current")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return Aggregates(lines, whole.select("aggregate", state.alias("state"), "lines", zero("dangling"), zero("unplaceable")), notes)
