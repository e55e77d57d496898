"""Build logs read while they grow: pieces of bytes in, lines with their roles and throttled progress out.

A stream carries (run, seq, data, last): the pieces of each run's output, numbered from 0 and cut anywhere, inside a character or a line break too. State is keyed by
run: the next piece's number, the bytes after the last line break, pieces that came early, and what the lines so far mean (whether a summary is open, the last role, the ordinal of the last header, the progress last shown). A
piece that was already read is skipped, an early one waits for those before it.

Every line goes out once, in the role and with the ordinal that ``logs.parse_output`` gives it over the whole log, so ``logs.diagnostics`` over the output equals
it whatever the cut. A line that marks progress is ``shown`` if it is the first, the last of its total, or at least a twentieth of the total after the one
shown before.

Defined cases: a run's last piece, if it says so, ends its open line; rows without a run, number or data are skipped; bytes that are no UTF-8 are replaced; a run's pieces that
wait are held in its state, each at most once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.functions.session import scratch_dir, ship
from ledgerline.operators import logs
from ledgerline.streaming.citations import ROCKSDB, STORE

PIECE = "run string, seq long, data binary, last boolean"
LINES = "run string, n long, line string, role string, ordinal long, done int, total int, shown boolean"
BREAK = re.compile(rb"\r\n|\r|\n")
CONTROL = re.compile("\x1b\\[[0-9;?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|\r")
MARK = re.compile(r"\[?([0-9]+)/([0-9]+)\]?")
HEADS, FAILED, PROGRESS = (re.compile(x) for x in (logs.SUMMARY, logs.BUILD_FAILED, logs.PROGRESS))
HEADER = re.compile(rf"{logs.LOCATED}{logs.SEVERITY}:\s*|^{logs.SEVERITY}:\s*")
LISTED = re.compile(r"^\s*-\s+")
#: A step of progress that is shown: this part of the total.
STEPS = 20


class Reader:
    """What the lines of one run mean, one after the other."""

    def __init__(self, n: int = 0, open_: bool = False, header: bool = False, ordinal: int = 0, counter: tuple[int, int] = (-1, -1), reported: int = -1):
        self.n, self.open, self.header, self.ordinal, self.counter, self.reported = n, open_, header, ordinal, counter, reported

    def progress(self, line: str) -> tuple[int | None, int | None, bool]:
        """(done, total, shown) of a line that marks progress."""
        if not PROGRESS.match(line):
            return None, None, False
        done, total = map(int, MARK.search(line).groups())
        if total <= 0 or done > total:
            return None, None, False
        if self.counter == (done, total):
            return done, total, False
        self.counter = done, total
        shown = done == total or self.reported < 0 or done - self.reported >= max(1, total // STEPS)
        self.reported = done if shown else self.reported
        return done, total, shown

    def read(self, raw: bytes) -> tuple:
        """(n, line, role, ordinal, done, total, shown) of the next line."""
        line = CONTROL.sub("", raw.decode("utf-8", "replace"))
        heads, item = bool(HEADS.search(line)), bool(LISTED.search(line))
        synthetic = heads or (item and self.open) or bool(FAILED.search(line)) or bool(PROGRESS.search(line))
        self.open = heads or (item and self.open)
        if synthetic:
            role, self.header = "synthetic", False
        elif HEADER.search(line):
            role, self.header, self.ordinal = "header", True, self.ordinal + 1
        else:
            role = "body" if self.header else "other"
        out = (self.n, line, role, self.ordinal, *self.progress(line))
        self.n += 1
        return out


class Pieces(StatefulProcessor):
    """A run's pieces in their order, whatever the order they came in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, pending binary, n long, open boolean, header boolean, ordinal long, done int, total int, reported int")
        self.early = handle.getMapState("early", "seq long", "data binary, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_, pending, n, open_, header, ordinal, done, total, reported = self.place.get() if self.place.exists() else (0, b"", 0, False, False, 0, -1, -1, -1)
        reader, pending, came = Reader(n, open_, header, ordinal, (done, total), reported), bytes(pending), {}
        for part in rows:
            for r in part.itertuples(index=False):
                if not (pd.isna(r.seq) or r.data is None) and r.seq >= next_:
                    came.setdefault(int(r.seq), (bytes(r.data), bool(r.last) if not pd.isna(r.last) else False))
        out = []
        while True:
            if next_ in came:
                data, last = came.pop(next_)
                self.early.removeKey((next_,))
            elif self.early.containsKey((next_,)):
                data, last = self.early.getValue((next_,))
                self.early.removeKey((next_,))
            else:
                break
            next_ += 1
            whole = pending + bytes(data)
            held = b"\r" if whole.endswith(b"\r") and not last else b""  # its line feed may be in the next piece
            *lines, pending = BREAK.split(whole[: len(whole) - len(held)])
            pending += held
            if last and pending:
                lines, pending = [*lines, pending], b""
            out += [(*key, *reader.read(x)) for x in lines]
        for seq, piece in came.items():
            self.early.updateValue((seq,), piece)
        self.place.update((next_, pending, reader.n, reader.open, reader.header, reader.ordinal, *reader.counter, reader.reported))
        if out:
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in LINES.split(", ")])
            yield frame.astype({"done": "Int32", "total": "Int32"})

    def close(self) -> None:
        pass


def lines(pieces: DataFrame) -> DataFrame:
    """The lines of a stream of pieces, as each is complete."""
    spark = pieces.sparkSession
    ship(spark)
    if spark.conf.get(STORE) != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)
    return pieces.where("run is not null").select("run", "seq", "data", "last").groupBy("run").transformWithStateInPandas(Pieces(), LINES, "append", "none")


def keep_lines(pieces: DataFrame, folder: str | None = None) -> DataFrame:
    """Run the stream over what is there, appending to the table in ``folder``, and return the whole table."""
    folder = folder or f"{scratch_dir(pieces.sparkSession)}/buildlog-{uuid4().hex}"
    query = lines(pieces).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/lines").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return pieces.sparkSession.read.schema(LINES).parquet(f"{folder}/lines")


def cut(texts: DataFrame, size: int) -> DataFrame:
    """(run, seq, data, last) of whole logs (run, text): pieces of ``size`` bytes."""
    data = F.encode("text", "UTF-8")
    count = F.greatest(F.ceil(F.octet_length("text") / size), F.lit(1)).cast("int")
    numbered = texts.select("run", data.alias("data"), count.alias("count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    return numbered.select("run", F.col("seq").cast("long").alias("seq"), F.substring("data", F.col("seq") * size + 1, F.lit(size)).alias("data"), (F.col("seq") == F.col("count") - 1).alias("last"))
