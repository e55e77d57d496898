"""The citation index kept by a stream: documents arrive in versions, their citations are replaced.

A stream carries (view, slug, document, stamp, body): a version of a document, or with a null body that
it went. State is keyed by (view, slug) and holds the stamp of the version in force and its
citations. A version with the stamp in force, or an earlier one, is skipped: repeated and late files change
nothing, and the stamp of a document that went stays, so that a late file doesn't revive it. A later version
retracts the citations that it lacks and adds those that are new.

The output is the log of these changes, appended to a table (change +1 or -1); adding up a citation's changes gives whether
it is in force, so ``current`` over the log equals an index built from the last versions alone. The log is written once per
change by the file sink, whatever is run again after a failure.

Defined cases: rows without a stamp are skipped; of versions of one stamp that arrive together the least body counts; an empty stream gives an empty
log. The state lives in RocksDB, so a key's citations need not fit in memory with all others'; one document's do: they are one
value, read and written at once, so that a version costs a fixed number of calls to the state store, however many citations it has.
States travel to the Python workers and back with the rows, many keys in an Arrow batch, not by a call over a socket for each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.session import scratch_dir, ship
from ledgerline.operators.walk import cited

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "view string, slug string, document string, name string, row string, row_title string, field string, change int"
HELD = "stamp long, citations string"


def _cited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [None if b is None else json.dumps(cited(b)) for b in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("view", "slug", "document", "stamp")), pa.array(found, pa.string())], names=["view", "slug", "document", "stamp", "citations"])


class Versions(StatefulProcessor):
    """Per document: the stamp in force and the citations of its version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            for r in part.itertuples(index=False):
                if pd.isna(r.stamp):
                    continue
                told = int(r.stamp), r
                if last is None or told[0] > last[0] or (told[0] == last[0] and repr(self._listed(r)) < repr(self._listed(last[1]))):
                    last = told
        if last is None:
            return
        stamp, told = self.held.get() if self.held.exists() else (None, "[]")
        if stamp is not None and last[0] <= stamp:
            return
        now = dict(self._listed(last[1]))
        held = {tuple(c): tuple(v) for c, v in json.loads(told)}
        gone = [(c, v, -1) for c, v in held.items() if now.get(c) != v]
        came = [(c, v, 1) for c, v in now.items() if held.get(c) != v]
        self.held.update((last[0], json.dumps(list(now.items()))))
        changes = [(*key, v[0], c[0], c[1], v[1], c[2], n) for c, v, n in gone + came]
        if changes:
            yield pd.DataFrame(changes, columns=[x.split()[0] for x in LOG.split(", ")]).astype({"change": "int32"})

    @staticmethod
    def _listed(r) -> list[tuple[tuple[str, str, str], tuple[str, str]]]:
        if not isinstance(r.citations, str):
            return []
        return sorted(((name, row, field), (r.document, title)) for name, row, field, title in json.loads(r.citations))

    def close(self) -> None:
        pass


class _Held:
    """The value of a group's state, as ``Versions`` takes it."""

    def __init__(self, state: GroupState) -> None:
        self.state = state

    def exists(self) -> bool:
        return self.state.exists

    def get(self) -> tuple:
        return self.state.get

    def update(self, value: tuple) -> None:
        self.state.update(value)


def _turned(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    job = Versions()
    job.held = _Held(state)
    yield from job.handleInputRows(key, rows, None)


def changes(versions: DataFrame) -> DataFrame:
    """The log of a stream of versions."""
    spark = versions.sparkSession
    ship(spark)
    if spark.conf.get(STORE) != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)
    given = versions.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("view", "slug", "document")], F.col("stamp").cast("long").alias("stamp"), F.col("body").cast("string").alias("body"))
    read = given.mapInArrow(_cited, "view string, slug string, document string, stamp long, citations string")
    return read.groupBy("view", "slug").applyInPandasWithState(_turned, LOG, HELD, "append", GroupStateTimeout.NoTimeout)


def keep_log(versions: DataFrame, folder: str | None = None) -> DataFrame:
    """Run the stream over what is there, appending to the log in ``folder``, and return the whole log."""
    folder = folder or f"{scratch_dir(versions.sparkSession)}/citations-{uuid4().hex}"
    query = changes(versions).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return versions.sparkSession.read.schema(LOG).parquet(f"{folder}/log")


def current(log: DataFrame) -> DataFrame:
    """(view, slug, document, name, row, row_title, field) in force."""
    columns = [x.split()[0] for x in LOG.split(", ")][:-1]
    return log.groupBy(*columns).agg(F.sum("change").alias("n")).where("n > 0").select(*columns)


def shared(index: DataFrame, minimum: int = 2) -> DataFrame:
    """(name, documents, occurrences) of names that several documents cite."""
    # per document first, so that no distinct count is needed; an index dealt by document isn't moved for it
    each = index.groupBy("view", "slug", "name").agg(F.count(F.lit(1)).alias("n"))
    counted = each.groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))
    return counted.where(F.col("documents") >= minimum)
