"""Language identification by word-first backoff.

A word (a run of letters, lower case) that the model knows is scored by its log
frequency per language. A word it doesn't know falls back to its character n-grams, from
the longest order down: the first order of which the model knows any n-gram scores the
word by their mean, at reduced weight. A document's scores add up over its words; the
score is the posterior of the best language.

Fitting reads only labelled documents outside the held-out fold, at most about
``SAMPLE_ROWS`` of them and of each language at least ``EACH`` (all, if it has fewer),
chosen by a hash of their rows (ids may be missing or repeat): the stated bound of the sample. Whole texts count. Word and
n-gram counts are aggregated in the cluster, and the model keeps every word and n-gram of
the sample, so that its size is bounded by the sample's texts alone.

Scale: prediction is one scan without a shuffle, vectorised over Arrow batches in pieces
of bounded size, whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0; text with
letters of which nothing is known gets the most frequent language; without any labelled
row everything is ``und``; nulls in doc_id fall in no held-out fold; an empty table gives
no rows; ties between languages go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship
from ledgerline.llm.blocks import numbered
from ledgerline.llm.kernels import BYTE_VALUE, U64, Rolling, mix64, pieces, string_parts

FOLDS, FOLD = 5, 0
SAMPLE_ROWS, EACH, ORDER = 20_000, 500, 4
BACKOFF = 0.4
#: ASCII letters and every byte of a longer character count as letters of a word.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = FOLD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]


def _hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64(Rolling(BYTE_VALUE[raw]).ranges(start, end) + (end - start).astype(U64))


def _table(counted: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of (lang, unit, n): sorted hashes of the units and, per language, log frequency less the mean over languages."""
    got = counted.select("unit", F.array_position(F.lit(languages), F.col("lang")).alias("at"), "n").toArrow()
    units, hashes = got["unit"].combine_chunks(), np.zeros(0, U64)
    if len(units):
        raw, offs = string_parts(units)
        hashes = _hash_ranges(raw[offs[0] :], offs[:-1] - offs[0], offs[1:] - offs[0])
    keys, row = np.unique(hashes, return_inverse=True)
    count = np.zeros((len(keys), len(languages)))
    np.add.at(count, (row, got["at"].to_numpy() - 1), got["n"].to_numpy())
    # One count is shared out by the languages' sizes, so that a unit a language hasn't says nothing more of a large one than of a small one.
    total = np.maximum(count.sum(0), 0.5)
    log = np.log(count + total / total.sum()) - np.log(total)
    return keys, (log - log.mean(1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    labelled = numbered(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("row", "lang", "text")
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sample_rows / max(1, sum(rows.values()))
    shares = {lang: min(1.0, max(share, EACH / n)) for lang, n in rows.items()}
    least = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(x * (1 << 30)))) for lang, x in shares.items()], F.lit(0))
    chosen = labelled.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < least)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z\u0080-\x{10FFFF}]+"), F.lit(0))).alias("unit")).groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))
    words = materialise(words, "op5-words")
    languages = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(languages)
    if not names:
        empty = (np.zeros(0, U64), np.zeros((0, 0), np.float32))
        return Model([], np.zeros(0), empty, [empty] * order)
    grams = []
    for n in range(order, 0, -1):
        units = F.expr(f"transform(sequence(1, length(unit) - {n - 1}), i -> substring(unit, i, {n}))")
        grams.append(_table(words.where(F.length("unit") >= n).select("lang", F.explode(units).alias("unit"), "n").groupBy("lang", "unit").agg(F.sum("n").alias("n")), names))
    prior = np.log(np.array([languages[x] for x in names], float) / sum(languages.values()))
    return Model(names, prior, _table(words, names), grams)


def _look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Row of each hash in the table, -1 if it isn't there."""
    keys = table[0]
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def _runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    heads = offs[:-1][offs[:-1] < len(mask)]
    opens[heads] = mask[heads]
    tails = offs[1:][offs[1:] > 0] - 1
    closes[tails] = mask[tails]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def score_piece(model: Model, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Summed log scores, rows by languages."""
    rows, width = len(offs) - 1, len(model.languages)
    total = np.tile(model.prior, (rows, 1))
    if not len(raw):
        return total
    start, end = _runs(LETTER[raw], offs)
    if not len(start):
        return total
    rolled = Rolling(BYTE_VALUE[raw])
    hashes = mix64(rolled.ranges(start, end) + (end - start).astype(U64))
    row = np.searchsorted(offs, start, "right") - 1
    at = _look_up(model.words, hashes)
    known = at >= 0
    for lang in range(width):
        total[:, lang] += np.bincount(row[known], model.words[1][at[known], lang], rows)
    unseen = np.flatnonzero(~known)
    if not len(unseen):
        return total
    _, one, back = np.unique(hashes[unseen], return_index=True, return_inverse=True)
    one = unseen[one]
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    bounds = np.append(chars, len(raw))
    first = np.searchsorted(chars, start[one])
    size = np.searchsorted(chars, end[one]) - first
    score = np.zeros((len(one), width))
    todo = np.arange(len(one))
    for k, table in enumerate(model.grams):
        n = len(model.grams) - k
        fits = np.maximum(size[todo] - n + 1, 0)
        word = np.repeat(todo, fits)
        where = np.repeat(first[todo] - (np.cumsum(fits) - fits), fits) + np.arange(fits.sum())
        s, e = bounds[where], bounds[where + n]
        at = _look_up(table, mix64(rolled.ranges(s, e) + (e - s).astype(U64)))
        word, at = word[at >= 0], at[at >= 0]
        seen = np.bincount(word, minlength=len(one))
        for lang in range(width):
            score[:, lang] += np.bincount(word, table[1][at, lang], len(one)) / np.maximum(seen, 1)
        todo = todo[seen[todo] == 0]
        if not len(todo):
            break
    for lang in range(width):
        total[:, lang] += BACKOFF * np.bincount(row[unseen], score[back, lang], rows)
    return total


def _predict(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            letter, lower = batch.column("letter").to_numpy(zero_copy_only=False), batch.column("lowered")
            preds, scores = [], []
            for i, j, raw, offs in pieces(lower):
                if model.languages:
                    total = score_piece(model, raw, offs)
                    best = total.argmax(1)
                    top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                has = letter[i:j] if model.languages else np.zeros(j - i, bool)
                for r in range(j - i):
                    preds.append(model.languages[int(best[r])] if has[r] else "und")
                    scores.append(float(top[r]) if has[r] else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    ship(docs.sparkSession)
    model_of = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.select("doc_id", "held_out", F.col("text").rlike(r"\p{L}").alias("letter"), F.lower("text").alias("lowered"))
    return given.mapInArrow(_predict(model_of), "doc_id long, held_out boolean, lang_pred string, score double")
