"""Suffix-array dedup of byte strings with a run-length index.

Every byte that a string of ``length`` bytes covers which also starts earlier is removed;
the first copy stays. The corpus is cut into content-chosen blocks of windows
(``blocks``). A block whose content stands at an earlier place is a copy as a whole.
Blocks that share a key but not their content are where copies begin and end: their
bytes, one string per different content, are routed by key, and each piece of some
megabytes of them, whole keys together, becomes a run-length Burrows-Wheeler index with
sampled run ends (``run_index``). Matching statistics streamed from it mark the windows
that match others; the earliest place of each stays. Copies of a whole block add nothing to
the runs of such an index, and so they are settled by their content's hash instead.

Scale: three scans of the text and no shuffle of it: one row per block moves (about one
in forty bytes), then the bytes of boundary blocks, then one list of spans per document.
Rows of a key are streamed with constant state. A key whose boundary blocks are more than
``MEMBERS`` would make an unbounded piece: its windows are routed one by one, by a 128-bit
hash of their bytes, through the same stream, with the same result.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; rows
without doc_id stand before all others; rows that share an id, or have none, are documents
of their own, in the order of their rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship, shuffle_width
from ledgerline.llm import blocks
from ledgerline.llm.kernels import BYTE_VALUE, U64, Rolling, mix64, pieces
from ledgerline.llm.run_index import RunIndex

LENGTH, GRAM = 100, 24
PIECE_BYTES, MEMBERS = 1 << 20, 20_000
PLACE = "doc long, row long, start int, n int"


def _index(length: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, number = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for i, j, raw, offs in pieces(batch.column("text")):
                yield blocks.block_rows(doc[i:j], number[i:j], blocks.cut_blocks(BYTE_VALUE[raw], offs, length, gram))

    return lambda batches: blocks.combined(cut(batches))


def _located(batch: pa.RecordBatch, length: int):
    """Per piece: bytes, and (start, windows, key, row) of the listed blocks that lie within their rows."""
    flat, at = blocks.span_lists(batch.column("spans"))
    start, n, _ = blocks.unpacked(flat[0::2])
    key, at = flat[1::2], at // 2
    for i, j, raw, offs in pieces(batch.column("text")):
        lo, hi = at[i], at[j]
        if lo == hi:
            continue
        row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        s, m, k = start[lo:hi], n[lo:hi], key[lo:hi]
        fits = s + m + length - 1 <= np.diff(offs)[row]
        yield i, j, raw, offs, s[fits], m[fits], k[fits], row[fits]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for i, j, raw, offs, s, m, key, row in _located(batch, length):
                size = m + length - 1
                data = raw[_spread(s + offs[row], size)]
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[i:j][row]), pa.array(number[i:j][row]), pa.array(s.astype(np.int32)), body], names=["key", "doc", "row", "start", "body"])

    return run


def _windows(length: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, number = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for i, j, raw, offs, s, m, _, row in _located(batch, length):
                value = BYTE_VALUE[raw]
                one, two = Rolling(value), Rolling(mix64(value[:-1] + mix64(value[1:])))  # of bytes, and of pairs of bytes
                where, wrow = _spread(s, m), np.repeat(row, m)
                begin = where + offs[wrow]
                key, content = mix64(one.ranges(begin, begin + length)), mix64(two.ranges(begin, begin + length - 1) ^ U64(length))
                yield key, content, doc[i:j][wrow], number[i:j][wrow], where, np.ones(len(where), np.int64), np.ones(len(where), np.int64)

    return lambda batches: blocks.combined(cut(batches))


def later_copies(doc: np.ndarray, row: np.ndarray, start: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(doc, row, start, n): runs of windows of the strings that also stand at an earlier place among them."""
    size = np.array([len(b) for b in bodies])
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    first = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.int64)  # 0 between strings
    text[_spread(first, size)] = raw.astype(np.int64) + 1
    number = RunIndex(text).classes(length)
    count = size - length + 1
    begin = _spread(first, count)
    of = np.repeat(np.arange(len(size)), count)
    place = start[of] + begin - first[of]
    # the order of strings by document; places that are one and the same aren't copies
    by = np.lexsort((row, doc))
    new = np.ones(len(by), bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (row[by][1:] != row[by][:-1])
    turn = np.empty(len(by), np.int64)
    turn[by] = np.cumsum(new) - 1
    at = (turn[of] << 32) | place
    earliest = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(earliest, number[begin], at)
    again = at != earliest[number[begin]]
    opens = again.copy()
    opens[1:] &= ~again[:-1] | (of[1:] != of[:-1])
    closes = again.copy()
    closes[:-1] &= ~again[1:] | (of[1:] != of[:-1])
    s, e = np.flatnonzero(opens), np.flatnonzero(closes)
    return doc[of[s]], row[of[s]], place[s], e - s + 1


def _mark(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: pa.Table):
            doc, row, start, n = later_copies(rows["doc"].to_numpy(), rows["row"].to_numpy(), rows["start"].to_numpy().astype(np.int64), rows["body"].to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "row", "start", "n"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 2048)
                at += part.num_rows
                held.append(part)
                size += part.nbytes
                if size < PIECE_BYTES:
                    continue
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if whole:
                    yield flush(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            flat, at = blocks.span_lists(batch.column("spans"))
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                raw = texts[i].as_py().encode()
                total, gone, spans = len(raw), 0, 0
                if at[i] < at[i + 1] and total:
                    s, n, _ = blocks.unpacked(flat[at[i] : at[i + 1]])
                    s, n = s[s < total], n[s < total]
                    e = np.minimum(s + n + length - 1, total)
                    keep = np.cumsum(np.bincount(s, minlength=total + 1) - np.bincount(e, minlength=total + 1))[:total] == 0
                    gone = total - int(keep.sum())
                    spans = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
                    raw = np.frombuffer(raw, np.uint8)[keep].tobytes()
                for column, value in zip(out, (total, gone, spans, hashlib.sha256(raw).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_spans(text: DataFrame, width: int, length: int = LENGTH, gram: int = GRAM, members: int = MEMBERS) -> DataFrame:
    """(doc, row, start, n): runs of n windows from byte ``start`` on that also start earlier."""
    shared = materialise(blocks.classify(text.mapInArrow(_index(length, gram), blocks.BLOCK_SCHEMA), width), "op1-blocks")
    copies = shared.where("copies > 1 and not first").select("doc", "row", "start", "n")
    ends = shared.where("mixed and first").select("key", "doc", "row", "start", "n")
    large = materialise(ends.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > members).select("key"), "op1-large")

    def listed(rows: DataFrame, tag: str) -> DataFrame:
        return materialise(rows.groupBy("doc", "row").agg(F.flatten(F.collect_list(F.array(blocks.packed(), "key"))).alias("spans")), tag)

    few = listed(ends.join(large, "key", "left_anti"), "op1-boundaries")
    strings = blocks.with_lists(text, few, "inner").mapInArrow(_strings(length), "key long, doc long, row long, start int, body binary")
    marked = strings.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_mark(length), PLACE)
    out = copies.unionByName(marked)
    if not large.isEmpty():
        many = listed(ends.join(large, "key", "left_semi"), "op1-large-boundaries")
        windows = blocks.with_lists(text, many, "inner").mapInArrow(_windows(length), blocks.BLOCK_SCHEMA)
        out = out.unionByName(blocks.classify(windows, width).where("copies > 1 and not first").select("doc", "row", "start", "n"))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ship(docs.sparkSession)
    text = blocks.of_documents(docs)
    lists = materialise(blocks.merged_lists(repeated_spans(text, shuffle_width(docs), length, gram, members)), "op1-spans")
    out = blocks.with_lists(text, lists, "left").mapInArrow(_remove(length), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("doc") != blocks.NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
