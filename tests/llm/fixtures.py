"""Small planted tables."""

import random


def corpus(seed=7, docs=60, vocabulary=400):
    """(doc_id, text) rows with copies, near copies, shared passages, odd texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 9))) for _ in range(vocabulary)]
    text = lambda n: "".join(r.choice(vocab).capitalize() if r.random() < 0.1 else r.choice(vocab) for _ in range(1)) + "".join(r.choice([" ", " ", " ", "\n", "  ", "\t"]) + r.choice(vocab) for _ in range(n - 1))
    rows = [(i * 3, text(r.randint(5, 300))) for i in range(docs)]
    passage = text(60)
    for i in range(0, docs, 5):
        d, t = rows[i]
        rows[i] = (d, t + " " + passage + " " + text(20))
    nxt = docs * 3
    for i in range(0, docs, 4):
        d, t = rows[i]
        rows.append((nxt, t))
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        rows.append((nxt + 1, " ".join(w)))
        nxt += 2
    rows += [(nxt, ""), (nxt + 1, None), (nxt + 2, "   \n "), (nxt + 3, "one"), (nxt + 4, "one"), (nxt + 5, "a " * 900), (nxt + 6, "x" * 700), (nxt + 7, "日本語 テキスト " * 40), (nxt + 8, text(34)), (nxt + 9, text(35))]
    return rows
