"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_words(rows, length=35):
    """{doc_id: (n_words, n_removed, sha)}; rows: (doc_id, text) with distinct ids."""
    seen = Counter()
    for _, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] += 1
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def substring_bytes(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_components(rows, k=4, percent=85):
    """{doc_id: (n_shingles, component_id)}."""
    sets = {}
    for doc, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        common = Counter(e for x in s for e in holders[x] if e < d)
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def bigram_model(texts, discount=0.75):
    """A function that scores a list of tokens (log10), from lists of training tokens that each end in the end token."""
    word, pair, after = Counter(), Counter(), Counter()
    for tokens in texts:
        word.update(tokens)
        pair.update(zip(["", *tokens], tokens, strict=False))
    for h, _ in pair:
        after[h] += 1
    floor = sum(word.values()) + len(word) + 1

    def score(tokens):
        out = 0.0
        for h, w in zip(["", *tokens], tokens, strict=False):
            p = (word[w] + 1) / floor
            if word[h]:
                p = (max(pair[h, w] - discount, 0) + discount * after[h] * p) / word[h]
            out += math.log10(p)
        return out

    return score
