"""Token alignment against a plain version that encodes whole texts and compares every pair of intervals."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import token_alignment
from tests.llm import fixtures

ODD = ["  leading", "trailing ", "two  spaces", "a\n b", "tab\tx y", "x y z", "é ü ñandú", "日本語 テキスト", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ mark ▁here", "nul \x00 byte", "it's we'll 123 4567", "😀 😀 x", " ", "\n", "ﬁ ligature", "é composed", "\x1c odd \x1d space", "a 　 b", " line"]


def intervals(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(rows):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] of (doc_id, text)."""
    tok = token_alignment.Tokenisers(token_alignment.Files.read())
    done, holders = [], Counter()
    for doc, text in rows:
        text = text or ""
        a = tok.a.encode(" " + text, add_special_tokens=False).ids
        b = tok.b.encode(text)
        given = (" " + text).encode()
        if not text or b"".join(tok.bytes_a[i] for i in a) != given or b"".join(tok.bytes_b[i] for i in b) != given:
            done.append((doc, [], [], [], []))
            continue
        at_a, at_b = intervals([tok.bytes_a[i] for i in a]), intervals([tok.bytes_b[i] for i in b])
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (s, _) in zip(a, at_a) if start <= s < cut) + "|" + ",".join(str(i) for i, (s, _) in zip(b, at_b) if start <= s < cut))
            start = cut
        links = [(i, j) for i, (s, e) in zip(a, at_a) for j, (u, v) in zip(b, at_b) if s < v and u < e]
        holders.update(set(links))
        done.append((doc, a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return sorted(
        (-1 if doc is None else doc, len(a), len(b), len(groups), len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, a, b, groups, links in done
    )


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_against_plain(spark, head):
    rows = [(d, (t or "")[:900]) for d, t in fixtures.corpus(docs=12)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1, ODD[0]), (None, "no id here"), (None, "no id here"), (5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(token_alignment.align_tokens(docs, head=head)) == plain(rows)


def test_alignment_is_the_overlap_of_intervals():
    r = random.Random(5)
    for _ in range(200):
        size = r.randint(1, 40)
        cut = lambda: np.diff([0, *sorted(r.sample(range(1, size), r.randint(0, size - 1))), size])
        a, b = cut(), cut()
        got = token_alignment.align(a, b)
        at_a, at_b = intervals([bytes(n) for n in a]), intervals([bytes(n) for n in b])
        assert list(zip(got.link_a, got.link_b)) == [(i, j) for i, (s, e) in enumerate(at_a) for j, (u, v) in enumerate(at_b) if s < v and u < e]
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        assert got.group_a.tolist() == [sum(c <= s for c in both) for s, _ in at_a]
        assert got.group_b.tolist() == [sum(c <= s for c in both) for s, _ in at_b]


def test_cache_starts_anew(spark, monkeypatch):
    rows = [(i, f"word{i} other{i * 7} thing") for i in range(50)]
    tok = token_alignment.Tokenisers(token_alignment.Files.read())
    monkeypatch.setattr(token_alignment, "CACHED", 60)
    units = token_alignment.Units(tok)
    for _, text in rows:
        slots = units.slots(tok.split(text))
        a, b, *_ = tok.encode([text])
        assert units.facts[slots, 0].sum() == len(a) and units.facts[slots, 1].sum() == len(b)
    assert len(units.slot) < 60


def test_long_text_and_odd_tables(spark):
    """A text of over one piece without a space, an empty table, clashing columns."""
    long = "abcdefghij" * 30_000
    docs = spark.createDataFrame([(1, long, "x", 5)], "doc_id long, text string, pairs string, n_a int")
    [r] = token_alignment.align_tokens(docs).collect()
    tok = token_alignment.Tokenisers(token_alignment.Files.read())
    a, b, *_ = tok.encode([long])
    assert (r.doc_id, r.n_a, r.n_b) == (1, len(a), len(b)) and r.n_links == r.n_a + r.n_b - r.n_groups
    assert token_alignment.align_tokens(docs.where(F.lit(False))).collect() == []


def test_files_are_given_by_folder():
    files = token_alignment.Files.read(os.path.realpath(token_alignment.FOLDER))
    assert len(files.a) > 0 and len(files.b) > 0
