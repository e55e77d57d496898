"""Toxicity by a weighted lexicon.

Folding. Texts are lower-cased; look-alike letters of other scripts, digits and signs that stand for
letters become those letters (l, 1, ! and | become i), invisible characters go, and what is neither
letter nor digit becomes one space. The same folding stands before learning and before scoring.

The lexicon holds word beginnings with weights, learned from labelled documents. How often a word
occurs in toxic documents is counted by different neighbours (the words on both sides), so that copies
of one document support a word once; counts of words add up to counts of their beginnings. A beginning enters
if it has ``SUPPORT`` neighbours and if its log ratio of frequencies, less ``DOUBT`` standard errors,
exceeds ``MARGIN``; its weight is that lower bound. A beginning of which ``WHOLLY`` goes on in one longer
beginning gives way to it. Of beginnings of one word the longest counts.

Exceptions are words that start like a term, and phrases of a term with the word before or after
it, that clean documents hold at least ``HARMLESS`` times and mostly. Terms and exceptions lie in one
Aho-Corasick automaton; a term within an exception doesn't count.

Score. A document's mass (the weights of its terms) and its mass per word enter a logistic
curve as logarithms. The curve is fitted on labelled documents too, each weighed with a lexicon that was
learned from the other half of the sample.

Fitting reads at most about ``SAMPLE_ROWS`` labelled documents, of each class at least
``EACH`` (all, if it has fewer), chosen by a hash of their ids among the labels; of rows that share an
id one counts: the stated bound of the sample, and of the lexicon.

Scale: labels are counted and sampled without texts; the sample's ids are broadcast, whose number is
bounded; words are counted in the cluster. Scoring is one scan without a shuffle.

Defined cases: null and empty texts have mass 0 and get the curve's least score; nulls in doc_id fall
in no held-out fold and have no label; an id with several labels is toxic if one of them is; null labels
don't count; without any usable label everything scores 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship

FOLDS, FOLD = 3, 1
SAMPLE_ROWS, EACH, THRESHOLD = 20_000, 5_000, 0.7
SUPPORT, DOUBT, MARGIN, HARMLESS, WHOLLY = 4, 2.0, 1.5, 3, 0.9
SHORTEST, LONGEST = 3, 16
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("авеоросухіјѕкмтнӏαεικνορτυχəɑɡıʟ", "abeopocyxijskmthiaeikvoptuxeagii", strict=True))
#: Digits and signs that stand for letters; letters and signs of one stroke are one.
DIGITS = dict(zip("013456789l", "oieasgtbgi", strict=True))
SIGNS = dict(zip("@$!|", "asii", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
TABLE = str.maketrans(ALIKE | DIGITS | {chr(0xFF41 + i): "i" if i == 11 else chr(97 + i) for i in range(26)} | dict.fromkeys(INVISIBLE))
SIGN = re.compile(r"[@$!|](?=[^\W\d_])")
BETWEEN = re.compile(r"[\W_]+")


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = FOLD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fold(text: str) -> str:
    """The folded words, a space before and after each; one space if there is none."""
    text = text.lower().translate(TABLE)
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    words = BETWEEN.sub(" ", text).strip(" ")
    return f" {words} " if words else " "


@dataclass
class Lexicon:
    """Weights of word beginnings, and exceptions (words and phrases)."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found


def hits(automaton, folded: str) -> dict[int, float]:
    """Weight of the longest term at each word start (the place of the space before it), exceptions taken out."""
    found, harmless = {}, []
    for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end - length + 1
        if weight is None:
            harmless.append((start, end))
        else:
            found[start] = weight  # of the terms that start here the longest comes last
    return {at: w for at, w in found.items() if not any(s <= at < e for s, e in harmless)} if harmless else found


def features(automaton, folded: str) -> tuple[float, float]:
    """Logarithms of a text's mass and of its mass per hundred words."""
    mass, words = sum(hits(automaton, folded).values()), folded.count(" ") - 1
    return (math.log1p(mass), math.log1p(100 * mass / words)) if words > 0 else (0.0, 0.0)


@dataclass
class Model:
    lexicon: Lexicon
    #: Intercept and slopes of the logistic curve; None scores 0.
    curve: tuple[float, float, float] | None

    def scores(self, texts: list[str]) -> list[float]:
        if self.curve is None:
            return [0.0] * len(texts)
        automaton = self.lexicon.automaton()
        x = np.array([features(automaton, fold(t)) for t in texts]).reshape(-1, 2)
        return (1 / (1 + np.exp(-(self.curve[0] + x @ np.array(self.curve[1:]))))).tolist()


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, each: int = EACH) -> tuple[DataFrame, dict[int, float]]:
    """(toxic, half, text) of the sampled labelled documents, and each class's share that was sampled."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    there = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {c: min(1.0, max(rows / sum(there.values()), each / n)) for c, n in there.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    least = F.when(F.col("toxic") == 1, F.lit(int(shares.get(1, 0) * (1 << 30)))).otherwise(F.lit(int(shares.get(0, 0) * (1 << 30))))
    chosen = materialise(known.where(draw < least).coalesce(1), "op13-labels")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    return materialise(one.select("toxic", half.alias("half"), "text"), "op13-sample"), shares


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, half, around, n): words of clean documents with their numbers, of toxic ones with each pair of neighbours."""
    for batch in batches:
        clean, toxic = Counter(), set()
        for is_toxic, half, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "text")), strict=True):
            words = fold(text).split()
            if is_toxic:
                toxic.update((w, half, f"{a} {b}") for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False))
            else:
                clean.update((w, half) for w in words)
        rows = [(w, h, None, n) for (w, h), n in clean.items()] + [(w, h, x, 1) for w, h, x in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["word", "half", "around", "n"])


def word_counts(sampled: DataFrame) -> DataFrame:
    """(word, t0, n0, t1, n1): per half of the sample, different neighbours in toxic documents and occurrences in clean ones."""
    seen = sampled.mapInArrow(_words, "word string, half int, around string, n long")
    once = seen.groupBy("word", "half", F.xxhash64("around").alias("around"), F.col("around").isNotNull().alias("toxic")).agg(F.sum("n").alias("n"))
    count = lambda half, toxic: F.sum(F.when((F.col("half") == half) & (F.col("toxic") == F.lit(toxic)), F.lit(1) if toxic else F.col("n")).otherwise(0))
    return once.groupBy("word").agg(count(0, True).alias("t0"), count(0, False).alias("n0"), count(1, True).alias("t1"), count(1, False).alias("n1"))


def log_ratio(t: Column, n: Column, toxic: float, clean: float) -> Column:
    """Lower bound of the logarithm of the ratio of a word's frequencies in toxic and in clean documents."""
    t, n = t + F.lit(0.5), n + F.lit(0.5)
    return F.log(t) - F.log(n) - F.lit(math.log((toxic + 1) / (clean + 1))) - F.lit(DOUBT) * F.sqrt(1 / t + 1 / n)


def _learn(words: DataFrame, halves: tuple[int, ...]) -> Lexicon:
    """Weights of the word beginnings, by the counts of some halves of the sample."""
    t, n = sum(F.col(f"t{h}") for h in halves), sum(F.col(f"n{h}") for h in halves)
    counted = words.select("word", t.alias("t"), n.alias("n"))
    toxic, clean = counted.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not toxic or not clean:
        return Lexicon({})
    starts = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.substring("word", 1, k)))
    stems = counted.where(F.length("word") >= SHORTEST).select(starts.alias("stem"), "t", "n").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    bound = log_ratio(F.col("t"), F.col("n"), toxic, clean)
    rows = stems.where(F.col("t") >= SUPPORT).select("stem", "t", bound.alias("weight")).where(F.col("weight") > MARGIN).collect()
    support = {r.stem: r.t for r in rows}
    # A beginning that one letter more nearly always follows is part of that longer one.
    parts = {r.stem[:-1] for r in rows if r.t >= WHOLLY * support.get(r.stem[:-1], math.inf)}
    found = {r.stem: r.weight for r in rows if r.stem not in parts}
    kept: dict[str, float] = {}
    for stem in sorted(found, key=len):  # a longer beginning says nothing new unless it weighs more than the one within it
        inner = next((stem[:k] for k in range(len(stem) - 1, SHORTEST - 1, -1) if stem[:k] in kept), None)
        if inner is None or found[stem] > kept[inner]:
            kept[stem] = found[stem]
    return Lexicon(kept)


def _phrases(lexicon_of):
    """(phrase, toxic, n): words that a term begins, alone and with either neighbour; in toxic documents each once per pair of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon_of.value.automaton()
        for batch in batches:
            seen = Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                folded = fold(text)
                for at in hits(automaton, folded):
                    end = folded.index(" ", at + 1)
                    before = folded[folded.rindex(" ", 0, at) + 1 : at] if at else ""
                    after = folded[end + 1 : folded.index(" ", end + 1)] if end + 1 < len(folded) else ""
                    word = folded[at + 1 : end]
                    seen.update((p, toxic) for p in {word, f"{before} {word}".strip(), f"{word} {after}".strip()})
            phrase, toxic = zip(*seen) if seen else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(toxic, pa.int32()), pa.array(seen.values(), pa.int64())], names=["phrase", "toxic", "n"])

    return run


def with_exceptions(lexicon: Lexicon, sampled: DataFrame, shares: dict[int, float]) -> Lexicon:
    """The lexicon with the exceptions that the sample shows, classes weighed by what of them was sampled."""
    of = sampled.sparkSession.sparkContext.broadcast(lexicon)
    n = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    seen = sampled.select("toxic", "text").mapInArrow(_phrases(of), "phrase string, toxic int, n long").groupBy("phrase").agg(n(0).alias("clean"), n(1).alias("bad"))
    mostly = F.col("clean") / F.lit(shares.get(0, 1.0)) > 3 * F.col("bad") / F.lit(shares.get(1, 1.0))
    listed = {r.phrase for r in seen.where((F.col("clean") >= HARMLESS) & mostly).collect()}
    return Lexicon(lexicon.weights, listed | lexicon.exceptions)


def _features(lexicons_of):
    """(toxic, mass, density): each document weighed with the lexicon of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [x.automaton() for x in lexicons_of.value]
        for batch in batches:
            x = [features(automata[1 - half], fold(text)) for half, text in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([v[k] for v in x], pa.float64()) for k in range(2))], names=["toxic", "mass", "density"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Weighted logistic regression on two features, slopes held back by a ridge and never below 0."""
    rate = float((weight * y).sum() + 0.5) / float(weight.sum() + 1)
    least = np.array([math.log(rate / (1 - rate)), 0.0, 0.0])
    keep = [0, 1, 2]
    while True:
        a, b = np.column_stack([np.ones(len(x)), x])[:, keep], least[keep].copy()
        hold = np.diag([1e-9 if k == 0 else ridge for k in keep])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + hold, a.T @ (weight * (y - p)) - hold @ (b - least[keep]))
            size = np.abs(step).max()
            b += step / max(1.0, size)
            if size < 1e-8:
                break
        bad = [k for k, v in zip(keep, b, strict=True) if k and v < 0]
        if not bad:
            out = least.copy()
            out[keep] = b
            return tuple(out.tolist())
        keep = [k for k in keep if k not in bad]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, each: int = EACH) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    sampled, shares = sample(docs, labels, rows, each)
    words = materialise(word_counts(sampled), "op13-words")
    halves = [with_exceptions(_learn(words, (h,)), sampled.where(F.col("half") == h), shares) for h in (0, 1)]
    lexicon = with_exceptions(_learn(words, (0, 1)), sampled, shares)
    of = spark.sparkContext.broadcast(halves)
    seen = sampled.mapInArrow(_features(of), "toxic int, mass double, density double").toArrow()
    if not seen.num_rows:
        return Model(Lexicon({}), None)
    y = seen["toxic"].to_numpy().astype(float)
    weight = np.where(y > 0, 1 / shares.get(1, 1.0), 1 / shares.get(0, 1.0))
    weight *= len(y) / weight.sum()
    return Model(lexicon, fit_curve(np.column_stack([seen["mass"].to_numpy(), seen["density"].to_numpy()]), y, weight))


def _predict(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        automaton, curve = model.lexicon.automaton(), np.array(model.curve or (0.0, 0.0, 0.0))
        for batch in batches:
            x = np.array([features(automaton, fold(t)) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-(curve[0] + x @ curve[1:]))) if model.curve else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)
    model_of = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(_predict(model_of), "doc_id long, held_out boolean, score double, predicted int")
