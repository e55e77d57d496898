"""Toxicity: folding, matching, exceptions, held-out accuracy on planted documents, odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import toxicity

BAD = ["grubwort", "snarfel", "blotik", "zumprat"]
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def fold_of(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def corpus(n=600, seed=2):
    """(doc_id, text, toxic); every fifth document is toxic, with two to six bad words among a hundred or so."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abdefghkmnoprstuvz") for _ in range(r.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(n):
        words, bad = [r.choice(vocab) for _ in range(r.randint(30, 150))], i % 5 == 0
        for _ in range(r.randint(2, 6) * bad):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_folding():
    assert toxicity.fold("You 1D10T!") == toxicity.fold("you idiot") == " you idiot "
    assert toxicity.fold("іdіоt") == toxicity.fold("idi​ot") == toxicity.fold("IDIOT,") == " idiot "
    assert toxicity.fold("$tup!d tr@sh") == toxicity.fold("stupid trash")
    assert toxicity.fold("ｌｏｓｅｒ") == toxicity.fold("loser") == toxicity.fold("|oser")
    assert toxicity.fold("") == toxicity.fold(" *** ") == " "
    assert toxicity.fold("niño größe") == " niño größe "


def plain_hits(lexicon, folded):
    """Longest term at each word, without those that an exception covers."""
    words = folded.split()
    harmless = set()
    for e in lexicon.exceptions:
        parts = e.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                harmless |= set(range(i, i + len(parts)))
    best = [max((t for t in lexicon.weights if w.startswith(t)), key=len, default=None) for w in words]
    return [lexicon.weights[t] for i, t in enumerate(best) if t and i not in harmless]


def test_matching_against_plain():
    r = random.Random(4)
    for _ in range(200):
        word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 5)))
        lexicon = toxicity.Lexicon({word(): i + 1.0 for i in range(r.randint(0, 6))}, {" ".join(word() for _ in range(r.randint(1, 2))) for _ in range(r.randint(0, 4))})
        folded = toxicity.fold(" ".join(word() for _ in range(r.randint(0, 30))))
        assert sorted(toxicity.hits(lexicon.automaton(), folded).values()) == sorted(plain_hits(lexicon, folded))


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = spark.createDataFrame([x[:2] for x in rows], DOCS)
    # What the held-out fold is labelled with must not matter.
    labels = spark.createDataFrame([(i, 1, 1 - t if fold_of(i) else t) for i, _, t in rows], LABELS)
    return toxicity.fit(docs, labels)


def test_held_out_documents(spark, model):
    rows = corpus()
    docs = spark.createDataFrame([x[:2] for x in rows], DOCS)
    got = {r.doc_id: r for r in toxicity.score(docs, None, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == fold_of(i) for i, r in got.items())
    fresh = [(i, t) for i, _, t in rows if fold_of(i)]
    assert np.mean([got[i].predicted == t for i, t in fresh]) > 0.98
    assert set(model.lexicon.weights) == {toxicity.fold(b).strip() for b in BAD}


def test_disguised_words_and_length(model):
    clean = "dobe mepu " * 10
    hit, odd, none = model.scores([clean + "you snarfel blotik", clean + "you 5n@rfel, BL0TIK", clean])
    assert hit == odd > 0.7 > none
    [long] = model.scores([clean * 200 + "snarfel blotik"])
    assert none < long < hit


def test_exceptions(spark):
    """A phrase that clean documents use, and a harmless word that begins like a term, don't count; the bare term does."""
    rows = corpus()
    r = random.Random(9)
    extra = [(10_000 + i, f"{r.choice(['fo', 'gu', 'ne'])} {i} blotik opera {r.random()} snarfelbox mu", 0) for i in range(60)]
    whole = rows + extra
    model = toxicity.fit(spark.createDataFrame([x[:2] for x in whole], DOCS), spark.createDataFrame([(i, 0, t) for i, _, t in whole], LABELS))
    assert {"biotik opera", "snarfeibox"} <= model.lexicon.exceptions
    lone, phrase, word = model.scores(["mepu blotik dobe", "mepu blotik opera", "mepu snarfelbox dobe"])
    assert lone > phrase == word == model.scores(["mepu dobe"])[0]


def test_copies_support_a_word_once(spark):
    """Hundreds of copies of one toxic document don't turn its other words into terms."""
    rows = corpus()
    rows += [(20_000 + i, "wholly uncommon sentence snarfel here", 1) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame([x[:2] for x in rows], DOCS), spark.createDataFrame([(i, 0, t) for i, _, t in rows], LABELS))
    assert not any(x.startswith(("who", "unc", "sen")) for x in model.lexicon.weights)


def test_sample_is_bounded(spark):
    rows = corpus()
    docs = spark.createDataFrame([x[:2] for x in rows] + [(0, f"again {i}") for i in range(500)] + [(None, f"no id {i}") for i in range(500)], DOCS)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1)] * 50 + [(0, 1, None)], LABELS)
    sampled, shares = toxicity.sample(docs, labels, rows=100, each=20)
    assert 60 < sampled.count() < 150 and 0 < shares[0] < 1


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, ""), (1, ""), (None, " \n "), (2, "x" * 5000), (3, "αβγ 日本語 " * 50)]])
@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1)], [(1, 0, 1), (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 1, 0)]])
def test_odd_tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"toxic": F.lit("clash"), "score": F.lit(None).cast("int")})
    got = toxicity.score(docs, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_long_text(spark, model):
    text = "dobe mepu " * 60_000
    got = toxicity.score(spark.createDataFrame([(1, text), (2, text + "snarfel " * 5000)], DOCS), None, model).collect()
    assert sorted((r.doc_id, r.predicted) for r in got) == [(1, 0), (2, 1)]
