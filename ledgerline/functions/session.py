"""Session plumbing shared by every operator: scratch tables, sizing, shipping code."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Catalyst's estimate for data it knows nothing of is the largest long.
UNKNOWN = 1 << 60


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests, notebooks on one machine) a temporary
    folder is chosen once and recorded in the session; never on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.environ.setdefault("LEDGERLINE_SCRATCH", tempfile.mkdtemp(prefix="ledgerline-"))
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts lineage like ``checkpoint()`` but stays columnar, so later readers prune
    columns, and a lost executor only costs a re-read. ``small``: shuffles are read in
    partitions of the advisory size, however few, not in one for every core; for rows
    of ids, as each file costs its executor two child processes on a local file system.
    """
    spark, setting = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(setting)
    try:
        if small:
            spark.conf.set(setting, "false")
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for ``df`` (file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_width(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions that keep each near ``bytes_each``, at least the session's own number (which serves where the size is unknown)."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return floor if size >= UNKNOWN else min(1 << 17, max(floor, -(-size // bytes_each)))


def few_files(spark: SparkSession, width: int | None = None) -> int:
    """Files for a table that is small beside the input: one for every sixteen partitions of the input's width, at least one per core."""
    width = width or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, width // 16)


#: Rows in an Arrow batch: batches of whole texts stay at some megabytes on both sides of the pipe.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound the batches they get."""
    sc = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerline-code-"), "ledgerline_code.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
