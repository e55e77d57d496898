"""Rows count, whatever their ids: missing and repeated ids in mixing, PII, language ID; columns that clash with helpers."""

import random

from pyspark.sql import functions as F

from ledgerline.llm import blocks, language_id, mixing, pii


def test_mixing_of_rows_without_ids(spark, tmp_path):
    """Sources of rows without an id, of rows that repeat one, and a plain one: every target is met to within a document."""
    r = random.Random(3)
    rows = [(None, "b", "w " * 10) for _ in range(300)] + [(7, "a", "w " * r.randint(5, 15)) for _ in range(300)] + [(1000 + i, "c", "w " * r.randint(5, 15)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(rows, "doc_id long, source string, text string")):
        got = mixing.mix(docs).toPandas()
        assert len(got) == len(rows)
        by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), given=("source_size", "first"), size=("size", "sum"))
        assert (abs(by.taken - by.target) <= 15).all() and (by.given == by["size"]).all()
        assert (got.taken <= 3 * got["size"]).all()
    docs = spark.read.parquet(str(tmp_path / "docs"))
    told = lambda: sorted(map(str, mixing.mix(docs).groupBy("doc_id", "size", "copies").count().collect()))
    assert told() == told()


def test_disclosing_terms_without_ids(spark):
    """The same term spans, at the default threshold, with ids, without any, and with one id for all."""
    rows = [(i, f"filler word{'abcdefgh'[i]} number {'xyzuvwst'[i]}ome then zanzibar reach me at boss@corp.example today") for i in range(8)]
    rows += [(100 + i, f"nothing to see in this plain text {'pqrstuvw'[i % 8]}ery common filler then today reach") for i in range(200)]
    spans = []
    for of in (lambda i: i, lambda i: None, lambda i: 5):
        docs = spark.createDataFrame([(of(i), t) for i, t in rows], "doc_id long, text string")
        spans.append(sorted(x.spans for x in pii.find_pii(docs).collect() if x.spans))
    assert "term:" in spans[0][0] and spans[0] == spans[1] == spans[2]


def test_language_sample_keeps_its_bound(spark):
    """Rows without an id are sampled one by one."""
    own = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    docs = spark.createDataFrame([(None, "en", f"some words x{own(i)}") for i in range(3000)] + [(3, "fr", f"des mots y{own(i)}") for i in range(3000)], "doc_id long, lang string, text string")
    model = language_id.fit(docs, sample_rows=400)
    known = len(model.words[0])
    assert 800 < known < 1400  # some 500 documents of each language, a word of its own in each


def test_numbering_leaves_columns_alone(spark, tmp_path):
    given = spark.createDataFrame([(i, f"p{i}", i * 10) for i in range(20)], "doc_id long, path string, place long")
    given.repartition(2).write.parquet(str(tmp_path / "x"))
    docs = spark.read.parquet(str(tmp_path / "x"))
    got = blocks.numbered(docs)
    assert sorted((r.doc_id, r.path, r.place) for r in got.collect()) == [(i, f"p{i}", i * 10) for i in range(20)]
    assert got.agg(F.count_distinct("row")).first()[0] == 20


def test_an_unknown_word_asks_once(spark):
    """Words outside the trie ask for their count and their weight as contexts in one row, and the rest answers in one."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ledgerline.llm import lm_scoring

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a b d", "e a"] * 4)], "doc_id long, text string")
    trie, rest, _ = lm_scoring.train(docs, head=0, ngrams=0)
    words = rest.where(F.col("word") == lm_scoring.WORD)
    assert words.count() == words.select("key").distinct().count() == 6 and rest.where(F.col("word").between(0, 5)).count() == 6
    assert words.where((F.col("amount") <= F.floor("amount")) | (F.floor("amount") < 1)).count() == 0

    class Held:
        value = trie

    batch = pa.RecordBatch.from_pydict({"row": pa.array([7]), "held_out": pa.array([False]), "text": pa.array(["a b"])})
    asked = [r["word"] for b in lm_scoring._score(Held)(iter([batch])) for r in b.to_pylist()]
    assert asked.count(lm_scoring.WORD) == 3 and len(asked) == 4 + 3 + 3


def test_tokens_move_in_columns(spark):
    """What the tokens ask for is dealt out in a few rows for each task, not in a row for each token, and every token meets its answer."""
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    from ledgerline.llm import lm_scoring
    from tests.llm import brute

    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, 700))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    model = brute.bigram_model([[*t.split(), ""] for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2])
    for head, ngrams in ((0, 0), (300, 500)):
        got = lm_scoring.score(docs, head, ngrams)
        exchanged = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in exchanged
        for r in got.collect():
            tokens = [*texts[r.doc_id][1].split(), ""]
            assert abs(r.score - model(tokens)) <= 2e-4 * len(tokens)
        trie, rest, _ = lm_scoring.train(docs, head, ngrams)
        trie_of = spark.sparkContext.broadcast(trie)
        given = docs.select(F.col("doc_id").alias("row"), lm_scoring.held_out(F.col("doc_id")).alias("held_out"), "text")
        asked = given.mapInArrow(lm_scoring._score(trie_of), "row long, key long, word long, amount double")
        dealt = given.mapInArrow(lm_scoring._deal(3, lm_scoring._score(trie_of)), "part int, kind int, data binary").collect()
        records = sum(len(r.data) // 8 // lm_scoring.FIELDS[r.kind] for r in dealt)
        assert asked.count() == records > 20_000 and len(dealt) <= 2 * 3 * len(lm_scoring.FIELDS)
        assert {r.part for r in dealt} == {0, 1, 2}
