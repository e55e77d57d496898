"""Content-cut blocks: how repeated windows of a corpus are found without moving the corpus.

A window of L units is keyed by the least hash among its k-grams. Consecutive windows
whose least k-gram is the same one, at the same place, form a block; equal windows have equal keys, so they can only meet
under one key. One row per block (key, hash of the block's content, where it stands) is
what moves; for windows of 35 words about one row in nine words, for 100 bytes about one
row in forty.

Under one key, a block whose whole content stands somewhere else too is repeated as a
whole. A block whose key is shared but whose content isn't may hold windows that repeat:
it is *mixed* and has to be compared window by window. Every other block is unique.

Tasks combine equal contents before rows move, so a passage that a third of all documents
hold sends one row a task to its key; its other copies are dealt out evenly. Rows of a key
are streamed in order of (key, content, place) with constant state, so a key that holds a
large part of all rows is never gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.llm.kernels import U64, Rolling, mix64, row_starts, signed, sliding_min

#: Documents without an id stand before all others.
NO_ID = -(1 << 63)
BLOCK_SCHEMA = "key long, content long, doc long, row long, start int, n int, weight int"
CLASS_SCHEMA = "key long, doc long, row long, start int, n int, copies int, first boolean, mixed boolean"
#: Windows in one packed span.
MOST = (1 << 24) - 1


def cut_blocks(values: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(key, content, row, start within row, windows) of the blocks of rows of units."""
    at, row = row_starts(first, length)
    if not len(at):
        return (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    rolled = Rolling(values)
    gram = mix64(rolled.fixed(k))
    key = sliding_min(gram, length - k + 1)[at]
    # A new block begins with a new least k-gram, or with the same one at another place: when it was a window's first.
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (gram[at[:-1]] == key[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    start = at[head]
    # over the grams, not the units: sums of units cancel out for some patterns of two units
    content = mix64(Rolling(gram).ranges(start, start + size + length - k) ^ size.astype(U64))
    return key[head], content, row[head], start - first[:-1][row[head]], size


#: Rows that a task combines before it sends them.
COMBINED = 1 << 18
NAMES = ["key", "content", "doc", "row", "start", "n", "weight"]


def combined(chunks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows (key, content, doc, row, start, n, weight) of many chunks, equal contents of a task combined.

    Of equal contents only the first goes on, with weight 2; the others are known to be
    copies of something earlier and get weight 0: they needn't meet the rest of their key.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush():
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        by = np.lexsort((columns[4], columns[3], columns[2], columns[5], columns[1], columns[0]))
        key, content, doc, row, start, n, weight = (x[by] for x in columns)
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (n[1:] != n[:-1])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc != doc[lead]) | (row != row[lead]) | (start != start[lead])
        weight = np.where(head, np.minimum(np.add.reduceat(weight, np.flatnonzero(head))[np.cumsum(head) - 1], 2), np.where(later, 0, weight))
        whole = pa.RecordBatch.from_arrays([signed(key), signed(content), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(weight.astype(np.int32))], names=NAMES)
        return [whole.slice(i, 1 << 15) for i in range(0, whole.num_rows, 1 << 15)]

    for chunk in chunks:
        if len(chunk[0]):
            held.append(chunk)
            size += len(chunk[0])
        if size >= COMBINED:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def block_rows(doc: np.ndarray, number: np.ndarray, cut: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    key, content, row, start, size = cut
    return key, content, doc[row], number[row], start, size, np.ones(len(key), np.int64)


def classify_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows, those whose key is shared: copies of their content (1, or 2 for more), whether they are the first of it, whether the key has other contents.

    Rows of weight 0 are copies already and pass through.
    ``mixed`` is right for first rows; for others it may be false. The one row carried
    from batch to batch is the first of the last content.
    """
    held: list[np.ndarray] | None = None
    extra, was_mixed = 0, False

    def out(cols, copies, first, mixed, keep):
        key, _, doc, row, start, n = (c[keep] for c in cols)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(row), pa.array(start), pa.array(n), pa.array(np.minimum(copies[keep], 2).astype(np.int32)), pa.array(first[keep]), pa.array(mixed[keep])], names=["key", "doc", "row", "start", "n", "copies", "first", "mixed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        weight = cols.pop()
        if not weight.all():
            passed = weight == 0
            yield out(cols, np.full(len(passed), 2), np.zeros(len(passed), bool), np.zeros(len(passed), bool), passed)
            cols, weight = [c[~passed] for c in cols], weight[~passed]
            if not len(weight):
                continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            weight = np.concatenate([[1], weight])
        else:
            extra, was_mixed = 0, False
        key, content, size = cols[0], cols[1], cols[5]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_run = new_key.copy()
        new_run[1:] |= (content[1:] != content[:-1]) | (size[1:] != size[:-1])
        run = np.cumsum(new_run) - 1
        group = np.cumsum(new_key) - 1
        run_n = np.bincount(run, weight).astype(np.int64)
        run_n[0] += extra
        runs = np.bincount(group[new_run])
        runs[0] += was_mixed
        copies, mixed = run_n[run], runs[group] > 1
        head = np.flatnonzero(new_run)[run]
        is_first = (cols[2] == cols[2][head]) & (cols[3] == cols[3][head]) & (cols[4] == cols[4][head])
        last = int(np.flatnonzero(new_run)[-1])
        keep = (copies > 1) | mixed
        keep[last] = False
        if keep.any():
            yield out(cols, copies, is_first, mixed, keep)
        held = [c[last : last + 1].copy() for c in cols]
        extra, was_mixed = int(run_n[-1]) - 1, bool(runs[-1] > 1)
    if held is not None and (extra or was_mixed):
        yield out(held, np.array([extra + 1]), np.array([True]), np.array([was_mixed]), np.array([True]))


def classify(rows: DataFrame, width: int) -> DataFrame:
    """The shared rows of a table of blocks; see ``classify_stream``."""
    deal = F.when(F.col("weight") > 0, F.col("key")).otherwise(F.xxhash64("doc", "row", "start"))
    return rows.repartition(width, deal).sortWithinPartitions("key", "content", "n", "doc", "row", "start").mapInArrow(classify_stream, CLASS_SCHEMA)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own in ``row``, the same in every scan: file and place of a plain file scan; else the rows are written with numbers."""
    if docs._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "LogicalRelation":
        return materialise(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "_numbered_file long, _numbered_path string")
    placed = docs.withColumns({"_numbered_path": F.col("_metadata.file_path"), "_numbered_place": F.col("_metadata.row_index")})
    return placed.join(F.broadcast(files), "_numbered_path").select(*docs.columns, (F.shiftleft("_numbered_file", 40) + F.col("_numbered_place")).alias("row"))


def of_documents(docs: DataFrame) -> DataFrame:
    """(doc, row, text) with nulls settled: no id is the least id, no text is empty.

    ``row`` tells rows of one id apart and orders them. It is 0 where every id stands once,
    which is counted first, over the ids alone.
    """
    docs = docs.select("doc_id", "text")
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count()
    row = numbered(docs) if repeats else docs.withColumn("row", F.lit(0).cast("long"))
    return row.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "row", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def packed(flag: Column | None = None) -> Column:
    """Columns start and n, and a flag, in one long: an entry of a document's list of spans."""
    return F.shiftleft(F.col("start").cast("long"), 25) + F.shiftleft(F.col("n").cast("long"), 1) + (flag.cast("long") if flag is not None else F.lit(0))


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 25, (x >> 1) & MOST, (x & 1).astype(bool)


def span_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a column of lists (null: empty)."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, at = span_lists(batch.column("spans"))
        start, n, _ = unpacked(values)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        by = np.lexsort((start, row))
        # rows apart from one another, so that one running maximum serves all
        apart = int((start + n).max(initial=0)) + 2
        start = start[by] + row[by] * apart
        end = np.maximum.accumulate(start + n[by])
        new = np.ones(len(start), bool)
        new[1:] = start[1:] > end[:-1]
        head = np.flatnonzero(new)
        s, e, r = start[head], end[np.append(head[1:], len(start)) - 1] if len(head) else end, row[by][head]
        parts = -(-(e - s) // MOST)
        again = np.repeat(np.arange(len(s)), parts)
        k = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        s, e, r = s[again] + k * MOST, np.minimum(e[again], s[again] + (k + 1) * MOST), r[again]
        offsets = np.searchsorted(r, np.arange(len(at))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(((s - r * apart) << 25) | ((e - s) << 1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), lists], names=["doc", "row", "spans"])


def merged_lists(spans: DataFrame) -> DataFrame:
    """(doc, row, spans): per document its spans (doc, row, start, n), overlapping and touching ones made one, packed."""
    lists = spans.groupBy("doc", "row").agg(F.collect_list(packed()).alias("spans"))
    return lists.mapInArrow(_merge, "doc long, row long, spans array<long>")


def with_lists(docs: DataFrame, lists: DataFrame, how: str, on: tuple = ("doc", "row"), limit: int = 64 << 20) -> DataFrame:
    """Join documents to one small row per document (doc, row, and perhaps spans).

    The size the small side takes in memory is counted first: under ``limit`` it is
    broadcast, beyond it both sides are shuffled by document.
    """
    entries = F.sum(F.size("spans")) if "spans" in lists.columns else F.lit(0)
    rows, entries = lists.agg(F.count(F.lit(1)), F.coalesce(entries, F.lit(0))).first()
    side = F.broadcast(lists) if 64 * rows + 8 * entries <= limit else lists
    return docs.join(side, list(on), how)
