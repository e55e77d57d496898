"""Alignment of two tokenisations of one text.

Both tokenisers cut the bytes of space + text into intervals. The intervals of B are indexed
once, by their sorted starts and ends; a bisecting search for the start and for the end of
an A token gives the run of B tokens that it overlaps, one link each. A gap between two B
tokens that no A token spans is a place where both end: it bounds the groups.

A single space between two other characters starts a token in both tokenisers (checked when
they are loaded: no piece of B goes on after a word with a space, and A splits by its byte-level
pattern), so a text is a sequence of units, each of which is encoded and aligned once while
it stays in the worker's cache. For other tokenisers the unit is the whole text.

Counts. Each document's row, with its distinct linked pairs and how often it links them, is written once. The
pairs' documents are counted from there. The ``HEAD`` most frequent pairs (all pairs of one count together)
and the highest count of each A id, at most one for each entry of A's vocabulary, are sent to
all workers, which sum them over the written pairs. A pair beyond the head is joined to its count
by the digest of the groups, once for all documents of equal groups; so every pair enters, and
HEAD only divides the work between memory and shuffle.

Scale: one scan of whole texts, which aren't moved; what is written is the distinct pairs, a fraction of
the text; the shuffle holds counted pairs and those beyond the head. A worker holds its cache
(``CACHED`` characters of units), the head (16 bytes a pair) and a piece of text, or one longer document.

Defined cases: null and empty texts, and texts that either tokeniser doesn't give back byte for byte,
have no tokens: zeros, and '' as digest; a null doc_id stays null; repeated rows count as documents
of their own; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship
from ledgerline.llm.kernels import pieces

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAD = 1 << 20
CACHED = 1 << 19
#: Between two characters that are not white space, a single space starts a token in both.
UNIT = re.compile(r"(?<=\S) (?=\S)")
BESIDE = re.compile(r" \s|\s ")
#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOGETHER = 1 << 14
MARK = "▁"
ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Files:
    """Contents of the two vocabulary files; workers load them from memory."""

    a: bytes
    b: bytes

    @classmethod
    def read(cls, folder: str = FOLDER, a: str = A_FILE, b: str = B_FILE) -> Files:
        parts = []
        for name in (a, b):
            with open(os.path.join(folder, name), "rb") as f:
                parts.append(f.read())
        return cls(*parts)


def byte_characters() -> dict[str, int]:
    """The byte of each character that a byte-level vocabulary writes it with: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenisers:
    """Both tokenisers and the bytes of their tokens."""

    def __init__(self, files: Files):
        from sentencepiece import SentencePieceProcessor

        self.files = files
        self.b = SentencePieceProcessor(model_proto=files.b)
        told = json.loads(files.a)
        split, bpe, char = told.get("pre_tokenizer") or {}, told["model"], byte_characters()
        names = {i: t for t, i in bpe["vocab"].items()} | {x["id"]: x["content"] for x in told.get("added_tokens") or []}
        read = lambda t: bytes(char[c] for c in t) if all(c in char for c in t) else t.encode()
        self.bytes_a = [read(names.get(i, "")) for i in range(max(names) + 1)]
        pieces_b = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces_b)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        by_pattern = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
        self.units = bool(by_pattern) and not any(MARK in p.lstrip(MARK) for p in pieces_b)
        self.fast = self._ranked(bpe) if self.units else None

    @cached_property
    def a(self):
        """A's own tokeniser, loaded where the ranks don't serve."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(self.files.a.decode())
        a.encode_special_tokens = True
        return a

    def _ranked(self, bpe: dict):
        """A's entries as ranks, which encode faster; only where every merge has its entry in order."""
        from tiktoken import Encoding

        merged = [bpe["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in bpe["merges"]]
        single = {self.bytes_a[i] for i in bpe["vocab"].values() if len(self.bytes_a[i]) == 1}
        plain = not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or len(single) < 256 or merged != list(range(256, 256 + len(merged))):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merged))}
        return Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.units:
            return [text]
        if text[0] != " " and text[-1] != " " and not BESIDE.search(text):
            return text.split(" ")
        return UNIT.split(text)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of space + each unit, and each unit's numbers of tokens; none where either tokeniser changes the bytes."""
        # A unit with white space at its ends would merge with its neighbours.
        if not self.fast or len(units) == 1 or any(u[0].isspace() or u[-1].isspace() for u in units):
            return self._each(units)
        parts, first = [], 0
        while first < len(units):
            last, size = first + 1, len(units[first])
            while last < len(units) and size < TOGETHER:
                size += len(units[last])
                last += 1
            parts.append(self._together(units[first:last]))
            first = last
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All units as one text: a token ends wherever a unit does."""
        text = " ".join(units)
        given = (" " + text).encode()
        a, b = self.fast.encode_ordinary(" " + text), self.b.encode(text)
        if b"".join([self.bytes_a[x] for x in a]) != given or b"".join([self.bytes_b[x] for x in b]) != given:
            return self._each(units)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        counts = [np.diff(np.searchsorted(np.cumsum(length[ids]), ends, "right"), prepend=0) for ids, length in ((a, self.length_a), (b, self.length_b))]
        return a, b, *counts

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        spaced = [" " + u for u in units]
        a = [self.fast.encode_ordinary(u) for u in spaced] if self.fast else [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        for i, u in enumerate(units):
            given = (" " + u).encode()
            if b"".join([self.bytes_a[x] for x in a[i]]) != given or b"".join([self.bytes_b[x] for x in b[i]]) != given:
                a[i], b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a, b))
        return *(np.fromiter((i for x in t for i in x), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b))), n_a, n_b


@dataclass
class Aligned:
    """Alignment of two tokenisations of the same bytes: the links as places in a and b, and each token's group."""

    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Align by token lengths in bytes; the sums of both are equal."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    start_a, start_b = end_a - length_a, end_b - length_b
    first = np.searchsorted(end_b, start_a, "right")
    last = np.searchsorted(start_b, end_a, "left")
    n = last - first
    link_a = np.repeat(np.arange(len(n)), n)
    link_b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    # Gap j lies before B token j; an A token that overlaps first .. last - 1 spans the gaps first + 1 .. last - 1.
    spans = np.zeros(len(end_b) + 2, np.int64)
    np.add.at(spans, first + 1, 1)
    np.add.at(spans, np.maximum(last, first + 1), -1)
    spanned = np.cumsum(spans)[: len(end_b)] > 0
    group_b = np.cumsum(~spanned) - 1
    return Aligned(link_a, link_b, group_b[first] if len(first) else first, group_b)


@dataclass
class Units:
    """Encoded and aligned units of a worker, by slot."""

    tokenisers: Tokenisers
    slot: dict[str, int] = field(default_factory=dict)
    held: int = 0
    text: list[bytes] = field(default_factory=list)
    #: Per slot: tokens of A and B, groups, links.
    facts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self):
        name = lambda sign, size: np.array([f"{i}{sign}".encode() for i in range(size)])
        sizes = len(self.tokenisers.bytes_a), len(self.tokenisers.bytes_b)
        self.names = name(",", sizes[0]), name("|", sizes[0]), name(",", sizes[1]), name(";", sizes[1])
        self.sizes = np.char.str_len(self.names[0]), np.char.str_len(self.names[2])

    def slots(self, units: list[str]) -> np.ndarray:
        """Slots of the units, which are all held afterwards; the cache starts anew when it is full."""
        if self.held > CACHED:
            self.slot, self.held, self.text = {}, 0, []
            self.facts, self.pairs, self.first = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        new = list(dict.fromkeys(u for u in units if u not in self.slot))
        odd = [u for u in new if u[0].isspace() or u[-1].isspace()]
        for some in ([u for u in new if not (u[0].isspace() or u[-1].isspace())] if odd else new, odd):
            if some:
                self._add(some)
        return np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))

    def _add(self, new: list[str]) -> None:
        ids_a, ids_b, n_a, n_b = self.tokenisers.encode(new)
        found = align(self.tokenisers.length_a[ids_a], self.tokenisers.length_b[ids_b])
        # A unit ends a token of both, so no group and no link leaves it.
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        unit_of_a = np.repeat(np.arange(len(new)), n_a)
        opens = np.ones(len(ids_b), bool)
        opens[1:] = found.group_b[1:] != found.group_b[:-1]
        groups = np.bincount(np.repeat(np.arange(len(new)), n_b)[opens], minlength=len(new))
        link_unit = unit_of_a[found.link_a]
        links = np.bincount(link_unit, minlength=len(new))
        pairs = (ids_a[found.link_a] << 32) | ids_b[found.link_b]
        self.text += self._texts(ids_a, ids_b, found, opens, end_a + end_b)
        base = len(self.slot)
        self.slot.update((u, base + i) for i, u in enumerate(new))
        self.held += sum(map(len, new))
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, groups, links], 1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, pairs])

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned, opens: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """Texts of the units' groups: each group's A tokens, then its B tokens; ``upto`` counts the tokens to each unit's end."""
        n = len(ids_a) + len(ids_b)
        whole, size = np.empty(n, f"S{max(x.itemsize for x in self.names)}"), np.empty(n, np.int64)
        last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        last_a[:-1] = found.group_a[1:] != found.group_a[:-1]
        last_b[:-1] = opens[1:]
        at_a = np.arange(len(ids_a)) + np.searchsorted(found.group_b, found.group_a, "left")
        at_b = np.arange(len(ids_b)) + np.searchsorted(found.group_a, found.group_b, "right")
        whole[at_a] = np.where(last_a, self.names[1][ids_a], self.names[0][ids_a])
        whole[at_b] = np.where(last_b, self.names[3][ids_b], self.names[2][ids_b])
        size[at_a], size[at_b] = self.sizes[0][ids_a], self.sizes[1][ids_b]
        flat = whole.tobytes().replace(b"\0", b"")
        end = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], upto])].tolist()
        return [flat[i:j] for i, j in zip(end[:-1], end[1:], strict=True)]

    def pairs_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs held for the slots, and for each the place of its slot in the list."""
        n = self.first[slots + 1] - self.first[slots]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[slots], n)
        return self.pairs[at], np.repeat(np.arange(len(slots)), n)


def _documents(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of batches: (batch, first row, slots of all units, row of each unit, rows that have tokens)."""
    for batch in batches:
        texts = batch.column("text")
        for i, j, _, _ in pieces(texts):
            split = [units.tokenisers.split(x) for x in texts.slice(i, j - i).to_pylist()]
            slots = units.slots([u for x in split for u in x])
            row = np.repeat(np.arange(j - i), [len(x) for x in split])
            bad = np.zeros(j - i, bool)
            bad[row[units.facts[slots, 0] == 0]] = True
            some = np.bincount(row, minlength=j - i) > 0
            keep = ~bad[row]
            yield batch, i, slots[keep], row[keep], some & ~bad


def _per_row(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of whole numbers by ascending row, exact at any size."""
    sums = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(row, np.arange(rows + 1))
    return sums[at[1:]] - sums[at[:-1]]


def _encoded(files_of):
    """A document's row, with its distinct pairs in ascending order and how often it links each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Tokenisers(files_of.value))
        for batch, i, slots, row, whole in _documents(batches, units):
            rows = len(whole)
            facts = [_per_row(row, units.facts[slots, k], rows) for k in range(4)]
            at = np.searchsorted(row, np.arange(rows + 1))
            text, listed = units.text, slots.tolist()
            digests = [hashlib.sha256(b"".join([text[s] for s in listed[at[r] : at[r + 1]]])[:-1]).hexdigest() if whole[r] else "" for r in range(rows)]
            pair, place = units.pairs_of(slots)
            of = row[place]
            by = np.lexsort((pair, of))
            pair, of = pair[by], of[by]
            opens = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(opens, len(pair)))
            offsets = pa.array(np.searchsorted(of[opens], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, rows), *map(pa.array, facts), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pair[opens])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return run


@dataclass
class Counts:
    """Documents of the most frequent pairs, by ascending key, and each A id's highest count."""

    keys: np.ndarray
    n: np.ndarray
    best: np.ndarray


def _score(counts_of):
    """Rows of ``_encoded`` with their sums over the head, and with only the pairs beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counts_of.value
        for batch in batches:
            rows = batch.num_rows
            size = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            pair, times = (batch.column(n).flatten().to_numpy() for n in ("pairs", "times"))
            row = np.repeat(np.arange(rows), size)
            at = np.minimum(np.searchsorted(c.keys, pair), max(len(c.keys) - 1, 0))
            hit = c.keys[at] == pair if len(c.keys) else np.zeros(len(pair), bool)
            n = np.where(hit, c.n[at], 0) if len(c.keys) else np.zeros(len(pair), np.int64)
            best = np.where(hit & (n == c.best[pair >> 32]), times, 0)
            offsets = pa.array(np.searchsorted(row[~hit], np.arange(rows + 1)).astype(np.int32))
            over = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (pair, times)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(_per_row(row, best, rows)), pa.array(_per_row(row, n * times, rows)), *over], names=[*names, "n_best", "count_sum", "pairs", "times"])

    return run


def encoded(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct linked pairs (A's id in the upper half, B's in the lower) and their times."""
    ship(docs.sparkSession)
    files_of = docs.sparkSession.sparkContext.broadcast(files or Files.read())
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(_encoded(files_of), ENCODED)


def head_threshold(counted: DataFrame, rows: int) -> int:
    """The least count that at most ``rows`` pairs reach. Only the distinct counts above the answer are read."""
    above, answer = 0, 1 << 62
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("n")).toLocalIterator():
        above += r.pairs
        if above > rows:
            break
        answer = r.n
    return answer


def align_tokens(docs: DataFrame, files: Files | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    written = materialise(encoded(docs, files), "op11-documents")
    counted = materialise(written.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "op11-pairs")
    least = head_threshold(counted, head)
    top = counted.where(F.col("n") >= least).toArrow()
    key, n = top["pair"].to_numpy(), top["n"].to_numpy()
    by = np.argsort(key)
    # At most one row for each entry of A's vocabulary.
    highest = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("best"))
    listed = highest.toArrow()
    a = listed["a"].to_numpy()
    best = np.zeros(int(a.max(initial=0)) + 1, np.int64)
    best[a] = listed["best"].to_numpy()
    scored = written.mapInArrow(_score(spark.sparkContext.broadcast(Counts(key[by], n[by], best))), SCORED)
    names = [x.split()[0] for x in RESULT.split(", ")]
    beyond = counted.where(F.col("n") < least)
    if beyond.limit(1).count() == 0:
        return scored.select(*names)
    scored = materialise(scored, "op11-scored")
    rest = scored.where(F.size("pairs") > 0).groupBy("groups_sha256").agg(F.first(F.arrays_zip("pairs", "times")).alias("rest"))
    rest = rest.select("groups_sha256", F.inline("rest").alias("pair", "times")).join(beyond, "pair")
    rest = rest.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(highest), "a")
    more = rest.groupBy("groups_sha256").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    whole = scored.drop("pairs", "times").join(more, "groups_sha256", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*names)
