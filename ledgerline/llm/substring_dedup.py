"""Substring dedup over words by hashes of content-cut blocks and of windows.

This stands in place of relative Lempel-Ziv parsing: there are no factors with a source
and no longest-match extension, as the result needs only which words are covered. Every
document's text is cut into blocks at places its content chooses (``blocks``), and all
blocks of all documents are grouped by hash. A block whose content stands at another
place is repeated as a whole; of a block that shares its key but not its content every
window of ``length`` words is checked against the windows of the blocks it shares its key
with, by a 128-bit hash of the window's words. Runs of repeated windows are merged, and
the words they cover are removed.

Scale: three scans of the text and no shuffle of it: what moves is one 32-byte row per
block, then one per window of boundary blocks, then one list of spans per document with
any. The lists are broadcast only when their written size is small, and joined by
document otherwise. Streams over sorted rows keep constant state per key.

Defined cases: null text has no words; a document shorter than a window keeps all its
words; rows that share a doc_id, or have none, are documents of their own; repeated rows
repeat each other's windows and so lose them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship, shuffle_width
from ledgerline.llm import blocks
from ledgerline.llm.kernels import U64, Rolling, mix64, pieces, word_hashes, words

LENGTH, PHRASE = 35, 18


def _index(length: int, phrase: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, number = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for i, j, raw, offs in pieces(batch.column("text")):
                start, end, first = words(raw, offs)
                yield blocks.block_rows(doc[i:j], number[i:j], blocks.cut_blocks(word_hashes(raw, start, end), first, length, phrase))

    return lambda batches: blocks.combined(cut(batches))


def _windows(length: int):
    """Boundary blocks' windows as rows of the index's own form: key and content are the two halves of a window's hash."""

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, number = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            flat, at = blocks.span_lists(batch.column("spans"))
            s, n, c = blocks.unpacked(flat)
            for i, j, raw, offs in pieces(batch.column("text")):
                start, end, first = words(raw, offs)
                values = word_hashes(raw, start, end)
                one, two = Rolling(values), Rolling(mix64(values[:-1] + mix64(values[1:])))  # of words, and of pairs of words
                lo, hi = at[i], at[j]
                if lo == hi:
                    continue
                row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                size = n[lo:hi]
                where = np.repeat(s[lo:hi] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                wrow, copies = np.repeat(row, size), np.repeat(c[lo:hi], size)
                begin = where + first[wrow]
                fits = begin + length <= first[wrow + 1]
                where, wrow, copies, begin = where[fits], wrow[fits], copies[fits], begin[fits]
                key, content = mix64(one.ranges(begin, begin + length)), mix64(two.ranges(begin, begin + length - 1))
                # weight 2: their content is known to stand at another place
                yield key, content, doc[i:j][wrow], number[i:j][wrow], where, np.ones(len(where), np.int64), 1 + copies.astype(np.int64)

    return lambda batches: blocks.combined(cut(batches))


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            flat, at = blocks.span_lists(batch.column("spans"))
            n_words, n_removed, digest = [], [], []
            for i in range(batch.num_rows):
                tokens = texts[i].as_py().encode().split()
                kept, gone = tokens, 0
                if at[i] < at[i + 1] and tokens:
                    s, n, _ = blocks.unpacked(flat[at[i] : at[i + 1]])
                    fits = s < len(tokens)
                    s, e = s[fits], np.minimum(s[fits] + n[fits] + length - 1, len(tokens))
                    edge = np.bincount(s, minlength=len(tokens) + 1) - np.bincount(e, minlength=len(tokens) + 1)
                    keep = np.cumsum(edge)[: len(tokens)] == 0
                    gone = len(tokens) - int(keep.sum())
                    kept = list(compress(tokens, keep.tolist()))
                n_words.append(len(tokens))
                n_removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc", "n_words", "n_removed", "kept_sha256"])

    return run


def duplicate_factors(text: DataFrame, width: int, length: int = LENGTH, phrase: int = PHRASE) -> DataFrame:
    """(doc, row, start, n): runs of n windows from word ``start`` on whose words also stand elsewhere."""
    index = text.mapInArrow(_index(length, phrase), blocks.BLOCK_SCHEMA)
    shared = materialise(blocks.classify(index, width), "op7-blocks")
    ends = shared.where("mixed and first").groupBy("doc", "row").agg(F.collect_list(blocks.packed(F.col("copies") > 1)).alias("spans"))
    ends = materialise(ends, "op7-boundaries")
    windows = blocks.with_lists(text, ends, "inner").mapInArrow(_windows(length), blocks.BLOCK_SCHEMA)
    checked = blocks.classify(windows, width).where("copies > 1")
    return shared.where("copies > 1").select("doc", "row", "start", "n").unionByName(checked.select("doc", "row", "start", "n"))


def substring_dedup(docs: DataFrame, length: int = LENGTH, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    ship(docs.sparkSession)
    text = blocks.of_documents(docs)
    lists = materialise(blocks.merged_lists(duplicate_factors(text, shuffle_width(docs), length, phrase)), "op7-factors")
    out = blocks.with_lists(text, lists, "left").mapInArrow(_remove(length), "doc long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("doc") != blocks.NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
