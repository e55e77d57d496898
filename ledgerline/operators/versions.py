"""Tables that are rewritten as a whole: each version is a folder of Parquet files, named by one row of a journal; edits, and what they did.

A version comes into being when its journal row is moved into place, a move that fails if the version is there already. Readers see whole versions only; of
two writers that start from one version the second is told, and nothing of its work is seen. What a lost or broken writer wrote stays unnamed in its folder.
The move is Hadoop's own, atomic on file systems that rename so (HDFS, not plain object stores).

Scale: rows are written once and read once for their digest, a sum of row hashes that doesn't depend on order; edits are summed by key before they meet the
table. The report sorts the edits to one field of one row in a window, which spills. The driver sees numbers only.

Defined cases: a version may be empty; a null value in an edit empties the field; null keys are met by no edit; a key that repeats in the table is edited in
each of its rows, and reported for each; of edits to one field of one key the one with the largest ``nth`` stands (of equal ones the largest value), and all are reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOURNAL = "at timestamp, author string, note string, base int, rows_before long, rows long, digest_before string, digest string, data string"


class LostWriter(RuntimeError):
    """Another writer made the version that this one was to make."""


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each version: its number, when and by whom, the version it came from, rows and digest before and after, and its data's folder."""
    try:
        return spark.read.schema(JOURNAL + ", version int").option("basePath", f"{folder}/journal").parquet(f"{folder}/journal")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], JOURNAL + ", version int")


def head(spark: SparkSession, folder: str) -> int:
    """The newest version, 0 before the first."""
    return journal(spark, folder).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version's rows, by default the newest one's."""
    version = head(spark, folder) if version is None else version
    row = journal(spark, folder).where(F.col("version") == version).select("data").first()
    if row is None:
        raise LookupError(f"{folder} has no version {version}")
    return spark.read.parquet(row.data)


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever the order of its rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def _place(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder to a place that must be free; false if it isn't."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = lambda p: fs.Path(fs.Path(p).toUri())
    context = fs.FileContext.getFileContext(path(target).getFileSystem(conf).getUri(), conf)
    context.mkdir(path(target).getParent(), fs.permission.FsPermission.getDirDefault(), True)
    try:
        context.rename(path(source), path(target), spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def commit(df: DataFrame, folder: str, base: int, author: str = "", note: str = "") -> int:
    """Makes ``df`` the version after ``base`` and returns its number; LostWriter if that version exists by then."""
    spark, version = df.sparkSession, base + 1
    known = journal(spark, folder)
    newest = known.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    if newest != base:
        raise LostWriter(f"version {base} isn't the newest of {folder}, {newest} is")
    data, staged = f"{folder}/data/{uuid.uuid4().hex}", f"{folder}/staged/{uuid.uuid4().hex}"
    df.write.parquet(data)
    before = known.where(F.col("version") == base).select(F.col("rows").alias("rows_before"), F.col("digest").alias("digest_before"))
    made = digest(spark.read.schema(df.schema).parquet(data)).join(before, how="left")
    made = made.select(
        F.current_timestamp().alias("at"), F.lit(author).alias("author"), F.lit(note).alias("note"), F.lit(base).alias("base"),
        "rows_before", "rows", "digest_before", "digest", F.lit(data).alias("data"),
    )
    made.coalesce(1).write.parquet(staged)
    if not _place(spark, staged, f"{folder}/journal/version={version}"):
        raise LostWriter(f"version {version} of {folder} was written meanwhile")
    return version


def edited(df: DataFrame, edits: DataFrame, key: str, writable: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """The table with edits (key, field, value, nth; values as text) applied, and a report (key, field, nth, before, after, state) of every edit.

    state: written, replaced by a later edit, or refused for its field (not-writable), its key (no-row) or its value (wrong-type). A refused edit changes nothing, whatever came before or after it.
    """
    writable, types = list(writable), dict(df.dtypes)
    if unknown := set(writable) - set(types) | {key} & set(writable):
        raise ValueError(f"can't be written: {sorted(unknown)}")
    fits = F.lit(False)
    for f in writable:
        fits = F.when(F.col("field") == f, F.col("value").isNull() | F.col("value").try_cast(types[f]).isNotNull()).otherwise(fits)
    asked = edits.select(F.col("key").cast(types[key]).alias("key"), "field", F.col("value").cast("string").alias("value"), "nth")
    judged = asked.withColumn("state", F.when(~F.coalesce(F.col("field").isin(writable), F.lit(False)), "not-writable").when(~fits, "wrong-type"))

    last = lambda f: F.max(F.when(F.col("field") == f, F.struct("nth", "value"))).alias(f"to_{i[f]}")
    i = {f: n for n, f in enumerate(writable)}
    inner = [f"was_{n}" for n in range(len(df.columns))]
    renamed = df.toDF(*inner)
    at = inner[df.columns.index(key)]
    if not writable:
        return df, judged.select("key", "field", "nth", F.lit(None).cast("string").alias("before"), F.col("value").alias("after"), "state")
    wanted = judged.where("state is null").groupBy("key").agg(*[last(f) for f in writable])
    joined = renamed.join(wanted, F.col(at) == F.col("key"), "left")
    changed = joined.select(*[
        F.when(F.col(f"to_{i[c]}").isNotNull(), F.col(f"to_{i[c]}.value").cast(types[c])).otherwise(F.col(w)).alias(c) if c in i else F.col(w).alias(c)
        for c, w in zip(df.columns, inner)
    ])

    fields = F.map_from_entries(F.array(*[F.struct(F.lit(f), F.col(inner[df.columns.index(f)]).cast("string")) for f in writable]))
    rows = renamed.select(F.col(at).alias("key"), fields.alias("fields"), F.monotonically_increasing_id().alias("row")).where("key is not null")
    met = judged.join(rows, "key", "left")
    refused = F.coalesce("state", F.when(F.col("row").isNull(), "no-row"))
    told = lambda d, before, state: d.select("key", "field", "nth", before.alias("before"), F.col("value").alias("after"), state.alias("state"))
    ordered = Window.partitionBy("key", "row", "field").orderBy("nth", "value")
    before = F.when(F.row_number().over(ordered) == 1, F.try_element_at("fields", "field")).otherwise(F.lag("value").over(ordered))
    report = told(met.where(refused.isNull()), before, F.when(F.lead(F.lit(1)).over(ordered).isNotNull(), "replaced").otherwise("written"))
    report = report.unionByName(told(met.where(refused.isNotNull()), F.lit(None).cast("string"), refused))
    return changed, report


def accepted(found: DataFrame, before: DataFrame) -> DataFrame:
    """(key, reason): the findings (key) as a new baseline; those that were accepted before (key, reason) keep their reason, of several the least."""
    kept = before.where("key is not null").groupBy("key").agg(F.min("reason").alias("reason"))
    return found.where("key is not null").select("key").distinct().join(kept, "key", "left").select("key", F.coalesce("reason", F.lit("")).alias("reason"))
