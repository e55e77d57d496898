"""Benchmark decontamination by BM25 with block-max WAND over every training passage.

The benchmark's items form an inverted index: terms, impacts (BM25 divided by the item's
own score, so one threshold serves all items), per-term maxima, and blocks of items with
block maxima. Every document, whole, is a sequence of overlapping passages; every passage
is a query. WAND's bound (the sum of its terms' maxima) drops a passage that can't reach
the threshold with any item; the block maxima drop whole blocks of items for it; what is
left is scored. All passages above the threshold are retrieved, there is no top-k cut.

An item longer than a passage is indexed as a whole and in parts of a passage's length,
each with impacts divided by its own score. Two neighbouring passages of a document cover
every part it holds word for word, so one of them scores at least half of it: retrieval
doesn't depend on an item's length. An item's score is the best of its entries.

A retrieved (document, item) is verified: the share of the item's question n-grams and of
its answer n-grams that the document holds. An item's text is split at a sentence end: its
last sentences, of eight words at least, are the answer, what stands before is the
question; a text without such an end is split in the middle.

Scale: one scan of the text without a shuffle. The index is built from the benchmark in
chunks of at most ``CHUNK`` bytes of item text, each broadcast with that bound; a larger
benchmark takes more scans, not more memory. Item counts of terms, the number of items
and their mean length are taken over the whole benchmark once, so a chunk scores as one
index would. Verified hits are summed per (doc, item).

Defined cases: null text has no passages; an item without words is never found; items or
documents that repeat are reported each; fewer words than an n-gram: the whole sequence is
the n-gram; nulls in ids stay null in results; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship
from ledgerline.llm.kernels import U64, Rolling, mix64, pieces, signed, string_parts, word_hashes, words

PASSAGE, STRIDE = 64, 32
THRESHOLD, OVERLAP, GRAM = 0.35, 0.5, 5
K1, B, BLOCK = 1.2, 0.75, 16
ANSWER = 8
CHUNK = 1 << 20
HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
SPLIT = re.compile(r"[.?!]\s+(?=\S)")


@dataclass
class Index:
    ids: list
    item: np.ndarray  # the item of each entry of the blocks: an item as a whole, or a part of a long one
    terms: np.ndarray  # sorted hashes
    bound: np.ndarray  # greatest impact of each term, and a zero for words outside
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # terms of a block of entries, their maxima, their impacts
    question: list[tuple[int, np.ndarray]]  # order and hashes of an item's n-grams
    answer: list[tuple[int, np.ndarray]]


def terms_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case word hashes; punctuation at a word's ends is dropped."""
    start, end, first = words(raw, offs)
    plain = np.ones(256, bool)
    plain[[ord(c) for c in ".,;:!?\"'()[]"]] = False
    for _ in range(3):
        tail = (end - start > 1) & ~plain[raw[end - 1]]
        end = end - tail
        head = (end - start > 1) & ~plain[raw[start]]
        start = start + head
    return word_hashes(raw, start, end, lower=True), first


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes of a word sequence."""
    if len(values) < n or not n:
        return np.zeros(0, U64)
    return np.unique(mix64(Rolling(values).fixed(n) + U64(n)))


def part_grams(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Order and n-grams of a part of an item; fewer words than an n-gram count as one."""
    n = min(GRAM, len(values))
    return n, grams(values, n)


def _terms_of_strings(strings: list[str]) -> list[np.ndarray]:
    raw, offs = string_parts(pa.array(strings, pa.string()))
    values, first = terms_of(raw, offs)
    return [values[first[i] : first[i + 1]] for i in range(len(strings))]


def halves(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentences that together hold ``ANSWER`` words, if a question is left."""
    for m in reversed(list(SPLIT.finditer(text))):
        if len(text[m.end() :].split()) >= ANSWER:
            return text[: m.end()], text[m.end() :]
    at = text.find(" ", len(text) // 2)
    return (text[:at], text[at:]) if at > 0 else (text, "")


def item_parts(values: np.ndarray) -> list[np.ndarray]:
    """Parts of a passage's length that cover an item longer than that; the last one ends with the item."""
    size = len(values)
    return [values[lo : lo + PASSAGE] for lo in (*range(0, size - PASSAGE, PASSAGE), size - PASSAGE)] if size > PASSAGE else []


@dataclass
class Statistics:
    """Of all items of a benchmark; ``df`` belongs to the sorted ``terms``, which hold an index's terms at least."""

    items: int
    words: int
    terms: np.ndarray
    df: np.ndarray


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, items, words): a row per item and term; the item itself and its words are counted with its first term."""
    for batch in batches:
        for _, _, raw, offs in pieces(batch.column("text")):
            values, first = terms_of(raw, offs)
            bags = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            size = np.zeros(sum(map(len, bags)), np.int64)
            some = np.array([len(x) for x in bags], np.int64)
            size[(np.cumsum(some) - some)[some > 0]] = np.diff(first)[some > 0]
            term = np.concatenate(bags) if bags else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([signed(term), pa.array((size > 0).astype(np.int64)), pa.array(size)], names=["term", "items", "words"])


def build(items: list[tuple[int, str]], statistics: Statistics | None = None) -> Index:
    """The index of some items; without statistics they are the whole benchmark."""
    items = [(i, t) for i, t in items if t and t.split()]
    bags = _terms_of_strings([t for _, t in items])
    terms = np.unique(np.concatenate(bags)) if bags else np.zeros(0, U64)
    length = np.array([len(x) for x in bags], float)
    counted = [np.unique(np.searchsorted(terms, x), return_counts=True) for x in bags]
    if statistics is None:
        df = np.bincount(np.concatenate([t for t, _ in counted]), minlength=len(terms)) if bags else np.zeros(0)
        statistics = Statistics(len(items), int(length.sum()), terms, df)
    df = statistics.df[np.searchsorted(statistics.terms, terms)]
    mean = statistics.words / max(1, statistics.items)
    idf = np.log(1 + (statistics.items - df + 0.5) / (df + 0.5))
    postings, item = [], []
    for d, (t, n) in enumerate(counted):
        impact = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[d] / mean))
        for own in (np.arange(len(t)), *(np.searchsorted(t, np.searchsorted(terms, part)) for part in item_parts(bags[d]))):
            own = np.unique(own)
            postings.append((t[own], impact[own] / max(1e-9, float(impact[own].sum()))))
            item.append(d)
    bound = np.zeros(len(terms) + 1)
    for t, x in postings:
        np.maximum.at(bound, t, x)
    blocks = []
    for lo in range(0, len(postings), BLOCK):
        own = np.unique(np.concatenate([t for t, _ in postings[lo : lo + BLOCK]]))
        impacts = np.zeros((len(own) + 1, BLOCK))
        for d, (t, x) in enumerate(postings[lo : lo + BLOCK]):
            impacts[np.searchsorted(own, t), d] = x
        blocks.append((own, impacts.max(1), impacts))
    parts = [halves(t) for _, t in items]
    return Index(
        [i for i, _ in items], np.array(item, np.int64), terms, bound, blocks, [part_grams(v) for v in _terms_of_strings([q for q, _ in parts])], [part_grams(v) for v in _terms_of_strings([a for _, a in parts])]
    )


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the overlapping passages of rows of words."""
    size = np.diff(first)
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - PASSAGE) // STRIDE)), 0)
    row = np.repeat(np.arange(len(size)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE + first[:-1][row]
    return start, np.minimum(start + PASSAGE, first[1:][row]), row


def retrieve(index: Index, values: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of every passage and item at or above the threshold."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(values) or not len(index.terms):
        return none
    at = np.minimum(np.searchsorted(index.terms, values), len(index.terms) - 1)
    term = np.where(index.terms[at] == values, at, len(index.terms))
    start, end, row = passages(first)
    sums = np.concatenate([[0.0], np.cumsum(index.bound[term])])
    pivot = np.flatnonzero(sums[end] - sums[start] >= threshold)  # WAND: all others can't reach it
    found = []
    for lo in range(0, len(pivot), 4096):
        p = pivot[lo : lo + 4096]
        place = start[p][:, None] + np.arange(PASSAGE)
        query = np.where(place < end[p][:, None], term[np.minimum(place, len(term) - 1)], len(index.terms))
        query.sort(axis=1)
        query[:, 1:][query[:, 1:] == query[:, :-1]] = len(index.terms)  # each term once
        able = np.flatnonzero(index.bound[query].sum(1) >= threshold)
        query, p = query[able], p[able]
        for block, (own, most, impacts) in enumerate(index.blocks):
            local = np.minimum(np.searchsorted(own, query), len(own) - 1)
            local = np.where(own[local] == query, local, len(own))
            hot = np.flatnonzero(most[local].sum(1) >= threshold)  # block maxima
            if len(hot):
                scores = impacts[local[hot]].sum(1)
                q, d = np.nonzero(scores >= threshold)
                found.append((row[p[hot[q]]], index.item[d + block * BLOCK], scores[q, d]))
    if not found:
        return none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _overlap(wanted: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(wanted, held).mean()) if len(wanted) else 1.0


def _search(index_of, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_of.value
        for batch in batches:
            ids = batch.column("doc_id")
            rows = []
            for i, _, raw, offs in pieces(batch.column("text")):
                values, first = terms_of(raw, offs)
                row, item, score = retrieve(index, values, first, threshold)
                best: dict = {}
                for r, d, s in zip(row.tolist(), item.tolist(), score.tolist(), strict=True):
                    best[r, d] = max(s, best.get((r, d), 0.0))
                own: dict = {}
                for (r, d), s in sorted(best.items()):
                    shares = []
                    for n, wanted in (index.question[d], index.answer[d]):
                        if (r, n) not in own:
                            own[r, n] = grams(values[first[r] : first[r + 1]], n)
                        shares.append(_overlap(wanted, own[r, n]))
                    q, a = shares
                    if q >= overlap and a >= overlap:
                        rows.append((ids[i + r].as_py(), index.ids[d], s, q, a))
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], kinds[c]) for c in range(5)], names=names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, chunk: int = CHUNK) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified hit."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    out, held, size, counts, total = None, [], 0, None, None

    def search(last: bool):
        nonlocal counts, total
        if last and out is None:
            index = build(held)
        else:
            if counts is None:
                found = asked.select("text").mapInArrow(_item_terms, "term long, items long, words long")
                counts = materialise(found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("items").alias("items"), F.sum("words").alias("words")), "op3-terms", small=True)
                total = counts.agg(F.sum("items"), F.sum("words")).first()
            own = np.unique(np.concatenate(_terms_of_strings([t for _, t in held])))
            wanted = spark.createDataFrame(pa.table({"term": signed(own)}))
            df = counts.join(F.broadcast(wanted), "term").select("term", "df").toArrow()
            term, n = df["term"].to_numpy().view(U64), df["df"].to_numpy()
            by = np.argsort(term)
            index = build(held, Statistics(total[0] or 0, total[1] or 0, term[by], n[by]))
        index_of = spark.sparkContext.broadcast(index)
        return given.mapInArrow(_search(index_of, threshold, overlap), HIT)

    for r in asked.orderBy("item_id", "text").toLocalIterator():
        if size >= chunk:
            out = search(False) if out is None else out.unionByName(search(False))
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    return search(True) if out is None else out.unionByName(search(True))
