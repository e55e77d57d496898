"""Review checklists over the files of a tree: groups, marks that survive regeneration and renames, progress.

Scale: marks and renames meet files by path; groups are sums, and a group's place in the list is set by one sorted window, which spills. Patterns are parameters.

Defined cases: null paths are left out; a path that repeats is one file, of its most lines; null lines count as none; a mark on an old path holds for the new
one, and still for the old; several files may come from one old path. Without files there are no groups, and progress is one row of zeros.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a checked line of a checklist.
DONE = r"^\s*-\s*\[[xX]\]\s+`([^`]+)`"
#: What is left out by default, and kinds of files by ending.
EXCLUDED = (".git/**", ".lake/**", "build/**", "vendor/**", "external/**")
KINDS = {
    ".lean": "Lean source", ".py": "tooling", ".sh": "tooling", ".md": "documentation", ".json": "data/config", ".yaml": "data/config", ".yml": "data/config",
    ".toml": "build config", ".tex": "paper source", ".bib": "bibliography",
}
LOOSE = "(root files)"


def marks(lines: DataFrame) -> DataFrame:
    """(path) of the checked items among a checklist's lines (line)."""
    return lines.select(F.regexp_extract("line", DONE, 1).alias("path")).where("path <> ''").distinct()


def renamed(marked: DataFrame, renames: DataFrame) -> DataFrame:
    """Marks (path) with those carried over by renames (old, new)."""
    moved = marked.join(renames.select(F.col("old").alias("path"), "new"), "path").select(F.col("new").alias("path"))
    return marked.select("path").unionByName(moved).where("path is not null").distinct()


def _suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)[^/](\.[^./]+)$", 1)


def kind(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(_suffix(path))), F.lit("other"))


def group(path: Column, depth: int = 2, by_kind: bool = True) -> Column:
    """The first parts of a path, with the kind of file where it isn't source."""
    parts = F.split(path, "/")
    prefix = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, max(1, depth)), "/")).otherwise(LOOSE)
    return F.when(_suffix(path) != ".lean", F.concat(prefix, F.lit(" :: "), kind(path))).otherwise(prefix) if by_kind else prefix


def select(files: DataFrame, include: Iterable[str] = ("*",), exclude: Iterable[str] = EXCLUDED) -> DataFrame:
    """Files (path, lines) that match a pattern and no excluded one; an excluded pattern less its last stars and slash also excludes all that begins so."""
    like = lambda p: F.col("path").rlike(f"^{fnmatch.translate(p)}")
    any_ = lambda tests: F.coalesce(F.greatest(F.lit(False), *tests), F.lit(False)) if tests else F.lit(False)
    wanted, unwanted = [like(p) for p in include], [t for p in exclude for t in (like(p), F.col("path").startswith(p.rstrip("*").rstrip("/")))]
    kept = files.where("path is not null").where(any_(wanted) if wanted else F.lit(True)).where(~any_(unwanted))
    return kept.groupBy("path").agg(F.coalesce(F.max("lines"), F.lit(0)).cast("long").alias("lines"))


def listing(files: DataFrame, marked: DataFrame, depth: int = 2, by_kind: bool = True) -> DataFrame:
    """(group, nth, path, lines, kind, done): every file once, the longest of a group first."""
    met = files.join(marked.select("path", F.lit(True).alias("m")).distinct(), "path", "left").select(group(F.col("path"), depth, by_kind).alias("group"), "path", "lines", kind(F.col("path")).alias("kind"), F.col("m").isNotNull().alias("done"))
    return met.select("group", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("lines"), "path")).alias("nth"), "path", "lines", "kind", "done")


def groups(files: DataFrame, marked: DataFrame, signed: DataFrame, depth: int = 2, by_kind: bool = True) -> DataFrame:
    """(group, files, lines, files_done, lines_done, ready, done): ready when every file is marked; done when the group itself is (``signed``: path)."""
    met = files.join(marked.select("path", F.lit(True).alias("m")).distinct(), "path", "left")
    summed = met.groupBy(group(F.col("path"), depth, by_kind).alias("group")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.count("m").alias("files_done"), F.coalesce(F.sum(F.when(F.col("m"), F.col("lines"))), F.lit(0)).alias("lines_done")
    )
    named = signed.where("path is not null").select(F.col("path").alias("group"), F.lit(True).alias("g")).distinct()
    return summed.join(named, "group", "left").select("group", "files", "lines", "files_done", "lines_done", (F.col("files") == F.col("files_done")).alias("ready"), F.col("g").isNotNull().alias("done"))


def progress(summed: DataFrame) -> DataFrame:
    """One row over all groups; ready_groups counts those that wait for their own mark only."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return summed.agg(
        total("files_done", "files_done"), total("files", "files_total"), total("lines_done", "lines_done"), total("lines", "lines_total"),
        F.count_if("done").alias("groups_done"), F.count(F.lit(1)).alias("groups_total"), F.count_if(F.col("ready") & ~F.col("done")).alias("ready_groups"),
    )
