"""Hierarchical dotted names: prefixes, resolution, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_prefix(module: Column, depth: int) -> Column:
    """The first ``depth`` components of a dotted name; 0 means all of it."""
    return module if depth == 0 else F.array_join(F.slice(F.split(module, r"\."), 1, depth), ".")


def under(name: Column, prefix: str) -> Column:
    """Dotted prefix test: the name itself or anything below it."""
    return (name == prefix) | name.startswith(prefix + ".")


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def filter_decls(decls: DataFrame, kind=None, module=None, library=None, name_like=None) -> DataFrame:
    """Declarations by kind, dotted module prefix, library and a regular expression on the name; nulls never match."""
    if kind is not None:
        decls = decls.where(F.col("kind") == kind)
    if module is not None:
        decls = decls.where(under(F.col("module"), module))
    if library is not None:
        decls = decls.where(F.col("library") == library)
    return decls.where(F.col("name").rlike(name_like)) if name_like else decls


def resolve(refs: DataFrame, decls: DataFrame) -> DataFrame:
    """(consumer, reference, resolved): exact name, else the deepest enclosing namespace of the consumer that declares it.

    A consumer's own name isn't a namespace of its. References that resolve to nothing keep
    a null; short names are never captured.
    """
    parts = F.split("consumer", r"\.")
    spaces = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: d > 0), lambda d: F.struct(d.alias("depth"), F.concat_ws(".", F.slice(parts, 1, d), F.col("reference")).alias("full")))
    options = F.array_append(spaces, F.struct(F.lit(1 << 20).alias("depth"), F.col("reference").alias("full")))
    known = decls.select(F.col("name").alias("full")).distinct()
    asked = refs.select("consumer", "reference").distinct()
    found = asked.withColumn("o", F.explode(options)).select("consumer", "reference", "o.depth", "o.full").join(known, "full")
    best = found.groupBy("consumer", "reference").agg(F.max_by("full", "depth").alias("resolved"))
    return asked.join(best, ["consumer", "reference"], "left")


class ConflictError(ValueError):
    """Records of one declaration that contradict each other."""


def merge_declarations(decls: DataFrame, optional: tuple[str, ...] = (), exact: tuple[str, ...] = (), sets: tuple[str, ...] = ()) -> DataFrame:
    """One row per name: the shallowest module (then the shortest, then the least) wins; how many rows it had.

    ``optional`` columns take their one value that isn't null, ``exact`` columns must agree,
    ``sets`` (arrays) must hold the same members in every row. Contradictions raise; they are
    sought before anything is merged.
    """
    depth = F.size(F.split("module", r"\."))
    fold = {c: F.col(c) for c in (*optional, *exact)} | {c: F.array_join(F.array_sort(F.array_distinct(c)), "\x1f") for c in sets}
    if fold:
        spread = decls.groupBy("name").agg(*[F.count_distinct(x).alias(c) for c, x in fold.items()])
        bad = spread.where(" or ".join(f"`{c}` > 1" for c in fold)).orderBy("name").first()
        if bad is not None:
            raise ConflictError(f"records of {bad.name} differ in {', '.join(c for c in fold if bad[c] > 1)}")
    kept = [F.first(c, ignorenulls=True).alias(c) for c in (*optional, *exact)] + [F.array_sort(F.array_distinct(F.first(c, ignorenulls=True))).alias(c) for c in sets]
    merged = decls.groupBy("name").agg(F.min(F.struct(depth.alias("d"), F.length("module").alias("n"), F.col("module").alias("module"))).alias("m"), F.count(F.lit(1)).alias("copies"), *kept)
    return merged.select("name", F.col("m.module").alias("module"), "copies", *optional, *exact, *sets)


class UnresolvedError(LookupError):
    """A name that stands for no declaration, or for several."""


def resolve_one(decls: DataFrame, query: str) -> str:
    """The declaration of that full name, else the only one of that short name."""
    found = decls.where((F.col("name") == query) | (short_name(F.col("name")) == query)).select("name").distinct().orderBy("name").limit(10).collect()
    full = [r.name for r in found if r.name == query]
    if not full and len(found) != 1:
        raise UnresolvedError(f"no declaration named {query!r}" if not found else f"{query!r} could be any of {', '.join(r.name for r in found)}")
    return (full or [found[0].name])[0]


def resolve_cited(cited: DataFrame, decls: DataFrame) -> DataFrame:
    """(query, resolved, candidates): the full name, else the short name's declaration where there is exactly one; how many there are."""
    known = decls.select("name").distinct()
    asked = cited.select("query").distinct()
    full = asked.join(known, F.col("query") == F.col("name")).select("query", F.col("name").alias("resolved"), F.lit(1).cast("long").alias("candidates"))
    rest = asked.join(full.select("query"), "query", "left_anti")
    short = rest.join(known.withColumn("query", short_name(F.col("name"))), "query", "left").groupBy("query").agg(F.min("name").alias("least"), F.count("name").alias("candidates"))
    return full.unionByName(short.select("query", F.when(F.col("candidates") == 1, F.col("least")).alias("resolved"), "candidates"))


def reattribute_equations(decls: DataFrame) -> DataFrame:
    """Generated equations (``.eq_1``, ``._eq_1``, ``.eq_def``) take the library and module of the declaration they belong to, where the libraries differ."""
    parent = F.nullif(F.regexp_extract("name", r"^(.+)\.(?:_?eq_[0-9]+|eq_def)$", 1), F.lit(""))
    owner = decls.select(F.col("name").alias("of"), F.col("library").alias("own_library"), F.col("module").alias("own_module")).dropDuplicates(["of"])
    joined = decls.withColumn("parent", parent).join(owner, F.col("parent") == F.col("of"), "left")
    moves = F.col("of").isNotNull() & ~F.col("own_library").eqNullSafe(F.col("library"))
    return joined.select(*[F.when(moves, F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) if c in ("library", "module") else F.col(c) for c in decls.columns])


def tagged(module: Column, tags: list[str]) -> Column:
    """Any tag is a component of the dotted name."""
    return F.arrays_overlap(F.split(module, r"\."), F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
