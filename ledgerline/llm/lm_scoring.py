"""N-gram language-model scoring with an Elias-Fano trie.

Counting. Words (lower case for A-Z), one end token per document, and pairs of a token and
the one before it (the end token before a document's first) are counted over every training
document, singletons included. The ``HEAD`` most frequent words (all words of one count
together) are the trie's vocabulary.

The trie. Level 1 holds the vocabulary's word hashes (Elias-Fano), their counts, their
numbers of different successors and quantised back-off weights. Each further level holds the
n-grams within the vocabulary whose count reaches the least threshold under which at most
``NGRAMS`` are left: the successors of a context, as an Elias-Fano sequence of word numbers
made monotone by the last value of the context before; monotone pointers from contexts to
their successors; quantised smoothed log probabilities. A look-up is a successor search
relative to the context. The arrays lie in one buffer that workers memory-map.

The rest. Words and pairs that aren't in the trie are not dropped: the tokens that miss it
are sent by what they miss. A pair of vocabulary words is counted again where its tokens
meet, so its count moves once; pairs with a word outside the vocabulary, and such words (with
what they weigh as contexts), meet their row of a table. What moves is not a row for each
token: a task sorts its tokens by the part of the shuffle that they meet in, and sends each
part the columns of some thousands of them, byte by byte (all first bytes, then all second
ones), which compress well. So every word and every pair that was counted enters
the score: HEAD and NGRAMS only divide the work between memory and shuffle; they don't
change a score (beyond quantisation). Only for orders above 2 are the longer n-grams those
of the trie.

Smoothing is absolute discounting, interpolated downwards: p(w|h) = max(c(hw)-D, 0)/c(h) +
b(h) p(w), b(h) = D N(h)/c(h) for N(h) different successors, and the add-one unigram below;
a context that training never saw costs nothing. As p(w|h) = b(h) p(w) (1 + (c(hw)-D) /
(D N(h) p(w))), what the rest holds is a term to add to a sum of logarithms.

Scale: scans of whole texts, vectorised, in pieces of bounded size. Counts combine within a
task before the shuffle, which grows with the corpus, as does the rest; the driver and the
broadcast see the trie alone, whose size has a stated bound whatever the corpus.

Defined cases: null and empty text is the end token alone; nulls in doc_id count as
training documents; without any training document N = V = 0 and every token costs
log10(1/1) = 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship, shuffle_width
from ledgerline.llm.blocks import NO_ID, numbered
from ledgerline.llm.elias_fano import EliasFano, memory_map, pack
from ledgerline.llm.kernels import U64, mix64, pieces, word_hashes, words

FOLDS, FOLD = 7, 2
HEAD, NGRAMS, ORDER, DISCOUNT = 1 << 20, 1 << 21, 2, 0.75
#: The end token's hash: no word hashes to it, as words are not empty.
END = U64(0x8000000000000001)
CHUNK = 2 << 20
SLICE = 1 << 18
LEAST = -12.0
#: What a row of the rest is about, in place of a pair's second word: a pair of vocabulary words, a word; then sums of a document.
PAIR, WORD, VALUE, PLUS, KNOWN, TOKENS = range(6)
#: Keys below are vocabulary numbers; word hashes lie beyond.
NUMBERS = 1 << 24
#: Further kinds of what is dealt out: pairs of vocabulary words that held-out tokens ask for, that are only counted; pairs with another word; rows of the rest.
HELD, SEEN, OUTER, REST = range(6, 10)
#: The columns of each kind.
FIELDS = {PAIR: 2, HELD: 2, SEEN: 2, WORD: 2, OUTER: 3, REST: 3} | dict.fromkeys((VALUE, PLUS, KNOWN, TOKENS), 2)
DEAL = 1 << 19
#: An amount up to here stands for a pair that is only counted.
NOTHING = 1e-29


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = FOLD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's end token included, and offsets per row."""
    start, end, first = words(raw, offs)
    rows = len(offs) - 1
    at = first + np.arange(rows + 1)
    out = np.full(len(start) + rows, END, U64)
    row = np.repeat(np.arange(rows), np.diff(first))
    out[np.arange(len(start)) + row] = word_hashes(raw, start, end, lower=True)
    return out, at


def _counted(chunks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(key[, word], n) of the keys of many arrays, combined over some millions at a time. All words are 0 but where given."""
    held, size = [], 0

    def rows(names, *columns):
        whole = pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=names)
        return [whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)]

    def flush():
        key, n = np.unique(np.concatenate([x[0] for x in held]), return_counts=True)
        if len(held[0]) == 1:
            return rows(["key", "n"], key, n)
        out = rows(["key", "word", "n"], key, np.full(len(key), PAIR), n)
        first, second = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        if len(first):
            by = np.lexsort((second, first))
            first, second = first[by], second[by]
            at = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
            out += rows(["key", "word", "n"], first[at], second[at], np.diff(np.append(at, len(first))))
        return out

    for x in chunks:
        if any(map(len, x)):
            held.append(x)
            size += sum(map(len, x))
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((tokens(raw, offs)[0],) for batch in batches for _, _, raw, offs in pieces(batch.column("text")))


class Trie:
    """Look-ups in a packed trie."""

    def __init__(self, data: bytes):
        parts = memory_map(data)
        group = lambda p: {k.removeprefix(p): v for k, v in parts.items() if k.startswith(p)}
        self.vocabulary = EliasFano(group("words."))
        self.count, self.successors = parts["count"], parts["successors"]
        self.total, self.types = int(parts["totals"][0]), int(parts["totals"][1])
        self.backoff = [parts["backoff.1"]]
        self.levels = []
        n = 2
        while f"pointers.{n}.shape" in parts:
            self.levels.append((EliasFano(group(f"pointers.{n}.")), EliasFano(group(f"successors.{n}.")), parts[f"codes.{n}"]))
            self.backoff.append(parts[f"backoff.{n}"])
            n += 1

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the vocabulary's words, -1 for others."""
        if not self.vocabulary.n:
            return np.full(len(hashes), -1)
        one, back = np.unique(hashes, return_inverse=True)
        return self.vocabulary.find(one)[back]

    def successor(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of (context, word) in a level, -1 where it isn't."""
        pointers, successors, _ = self.levels[level]
        out = np.full(len(context), -1)
        ok = np.flatnonzero((context >= 0) & (word >= 0))
        if not len(ok) or not successors.n:
            return out
        # Each pair once and in order, so that neighbours in the arrays are read together.
        pair, place = np.unique((context[ok] << 24) | word[ok], return_inverse=True)
        of, wanted = pair >> 24, pair & (NUMBERS - 1)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        one, back = of[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
        lo, hi = pointers.get(one), pointers.get(one + 1)
        base = np.where(lo > 0, successors.get(np.maximum(lo - 1, 0)), 0)
        found = np.full(len(pair), -1)
        some = np.flatnonzero((lo < hi)[back])
        if len(some):
            back = back[some]
            found[some] = successors.find(base[back] + wanted[some], lo[back], hi[back])
        out[ok] = found[place]
        return out


def quantise(log: np.ndarray) -> np.ndarray:
    """log10 values in (LEAST, 0] as two bytes."""
    return np.clip(np.round(log / LEAST * 65535), 0, 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * (LEAST / 65535)


def contexts(trie: Trie, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For every token, the place in level n - 1 of the n - 1 tokens before it (an end token before each row), -1 where there is none."""
    before = np.full(len(ids), -1)
    before[1:] = ids[:-1]
    end = int(trie.word_ids(np.array([END]))[0])
    before[at[:-1]] = end
    if n == 2:
        return before
    longer = contexts(trie, ids, at, n - 1)
    shifted = np.full(len(ids), -1)
    shifted[1:] = longer[:-1]
    shifted[at[:-1]] = -1
    return trie.successor(n - 3, shifted, before)


def before(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every token, the hash of the token before it, the end token before each row."""
    out = np.full(len(hashes), END, U64)
    out[1:] = hashes[:-1]
    out[at[:-1]] = END
    return out


def outside(hashes: np.ndarray, at: np.ndarray, ids: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose pair isn't within the vocabulary; the pair's context (its number, else its hash) and word hash."""
    rare = np.flatnonzero((ids < 0) | (context < 0))
    c = context[rare]
    return rare, np.where(c >= 0, c.astype(U64), before(hashes, at)[rare]), hashes[rare]


def _ngrams(trie_of, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(trie_of.value)

        def keys():
            for batch in batches:
                for _, _, raw, offs in pieces(batch.column("text")):
                    hashes, at = tokens(raw, offs)
                    ids = trie.word_ids(hashes)
                    context = contexts(trie, ids, at, n)
                    ok = (context >= 0) & (ids >= 0)
                    none = np.zeros(0, U64)
                    first, second = outside(hashes, at, ids, context)[1:] if n == 2 else (none, none)
                    yield (context[ok].astype(U64) << U64(24)) | ids[ok].astype(U64), first, second

        yield from _counted(keys())

    return run


def _level(n: int, key: np.ndarray, count: np.ndarray, contexts_n: int, context_count: np.ndarray, lower: np.ndarray, left: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """Arrays of level n; the context's back-off codes for the level above; key = context << 24 | word, sorted."""
    context, word = (key >> U64(24)).astype(np.int64), (key & U64((1 << 24) - 1)).astype(np.int64)
    pointers = np.searchsorted(context, np.arange(contexts_n + 1))
    last = np.zeros(contexts_n + 1, np.int64)  # a context's base: the last value before its successors
    filled = np.diff(pointers) > 0
    top = np.zeros(contexts_n, np.int64)
    top[filled] = word[pointers[1:][filled] - 1]
    last[1:] = np.cumsum(top)
    kept = np.maximum(count - DISCOUNT, 0) / np.maximum(context_count[context], 1)
    if left is None:  # what the kept successors leave over
        left = np.clip(1 - np.bincount(context, kept, contexts_n), 1e-12, 1)
    probability = kept + left[context] * 10.0 ** lower[word]
    parts = {f"pointers.{n}.{k}": v for k, v in EliasFano.encode(pointers).items()}
    parts |= {f"successors.{n}.{k}": v for k, v in EliasFano.encode(last[context] + word).items()}
    parts[f"codes.{n}"] = quantise(np.log10(np.minimum(probability, 1.0)))
    return parts, quantise(np.log10(left))


def _threshold(counted: DataFrame, rows: int) -> int:
    """The least count that at most ``rows`` keys reach. Only the distinct counts above the answer are read."""
    above, answer = 0, None
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("n")).toLocalIterator():
        above += r.keys
        if above > rows:
            break
        answer = r.n
    return answer if answer is not None else (1 << 62)


def _rest(counted: DataFrame, pairs: DataFrame, total: float) -> DataFrame:
    """(key, word, amount) of words and contexts outside the trie's vocabulary, and of pairs with such a word.

    A word's amount is its count and, as a fraction of LEAST, the logarithm of its back-off weight as a context; a pair's is (n - D)
    times what is known here of its factor; the scoring side knows the part of vocabulary words.
    """
    outer = pairs.where(F.col("word") != PAIR)
    number = F.col("key").between(0, NUMBERS - 1)
    word = counted.select(F.col("key").alias("word"), (F.lit(1.0) / (F.col("n") + 1)).alias("share"))
    context = outer.where(~number).groupBy("key").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("c"))
    weight, over = F.lit(DISCOUNT) * F.col("types"), F.col("n") - DISCOUNT
    known = outer.where(number).join(word, "word").select("key", "word", (over * F.col("share")).alias("amount"))
    unknown = outer.where(~number).join(word, "word").join(context, "key").select("key", "word", (over * F.lit(total) / weight * F.col("share")).alias("amount"))
    # Words and contexts are the same tokens, each as often: one row has the count and, as a fraction, the logarithm.
    of_word = context.select("key", F.lit(WORD).cast("long").alias("word"), (F.col("c") + F.log10(weight / F.col("c")) / LEAST).alias("amount"))
    whole = known.unionByName(unknown).unionByName(of_word)
    return materialise(whole, "op8-rest")


def _release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; shuffles that ended go with the driver's next collection."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def train(docs: DataFrame, head: int = HEAD, ngrams: int = NGRAMS, order: int = ORDER) -> tuple[bytes, DataFrame, dict]:
    """The packed trie, the table of what its vocabulary lacks, and {total, types}."""
    spark = docs.sparkSession
    text = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text"))
    counted = materialise(text.mapInArrow(_unigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "op8-words")
    total, types = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _threshold(counted, head)
    top = counted.where(F.col("n") >= least).toArrow()
    key, count = top["key"].to_numpy().view(U64), top["n"].to_numpy()
    by = np.argsort(key)
    key, count = key[by], count[by]
    floor = total + types + 1
    lower = np.log10(count + 1) - np.log10(floor)
    parts = {f"words.{k}": v for k, v in EliasFano.encode(key).items()}
    parts |= {"count": count, "successors": np.zeros(len(key), np.int64), "totals": np.array([total, types]), "backoff.1": np.zeros(len(key), np.uint16)}
    context_n, context_count = len(key), count
    for n in range(2, order + 1):
        trie_of = spark.sparkContext.broadcast(pack(parts))
        found = materialise(text.mapInArrow(_ngrams(trie_of, n), "key long, word long, n long").groupBy("key", "word").agg(F.sum("n").alias("n")), "op8-ngrams")
        inner = found.where(F.col("word") == PAIR)
        bound = _threshold(inner, ngrams)
        kept = inner.where(F.col("n") >= bound).toArrow()
        k, c = kept["key"].to_numpy().view(U64), kept["n"].to_numpy()
        by = np.argsort(k)
        left = None
        if n == 2:
            rest = _rest(counted, found, float(floor))
            # A vocabulary word's successors, those outside the vocabulary included: at most one row for each.
            number = F.when(F.col("word") == PAIR, F.shiftright("key", 24)).otherwise(F.col("key"))
            after = found.select(number.alias("id")).where(F.col("id").between(0, NUMBERS - 1)).groupBy("id").agg(F.count(F.lit(1)).alias("types")).toArrow()
            parts["successors"][after["id"].to_numpy()] = after["types"].to_numpy()
            left = np.clip(DISCOUNT * parts["successors"] / np.maximum(count, 1), 1e-12, 1)
        level, codes = _level(n, k[by], c[by], context_n, context_count, lower, left)
        parts |= level
        parts[f"backoff.{n - 1}"] = codes
        parts[f"backoff.{n}"] = np.zeros(len(k), np.uint16)
        context_n, context_count = len(k), c[by]
        trie_of.unpersist()
        _release(spark, found)
    _release(spark, counted)
    return pack(parts), rest, {"total": int(total), "types": int(types)}


def score_tokens(trie: Trie, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: log10 of its probability as far as the trie knows it, log10(c + 1) of vocabulary words, and 1 where no n-gram was found, 0 where the pair alone isn't in the trie, else -1."""
    known = ids >= 0
    plus = np.zeros(len(ids))
    plus[known] = np.log10(trie.count[ids[known]] + 1.0)
    unigram = plus - np.log10(trie.total + trie.types + 1)
    value, todo, order = unigram.copy(), np.ones(len(ids), bool), len(trie.levels) + 1
    spent = np.zeros(len(ids))
    for n in range(order, 1, -1):
        context = contexts(trie, ids, at, n)
        place = np.full(len(ids), -1)
        place[todo] = trie.successor(n - 2, context[todo], ids[todo])
        hit = place >= 0
        value[hit] = spent[hit] + restore(trie.levels[n - 2][2][place[hit]])
        todo &= ~hit
        miss = todo & (context >= 0)
        spent[miss] += restore(trie.backoff[n - 2][context[miss]])
    value[todo] = spent[todo] + unigram[todo]
    absent = todo if order == 2 else trie.successor(0, contexts(trie, ids, at, 2), ids) < 0
    return value, plus, np.where(todo, 1, np.where(absent, 0, -1))


def _score(trie_of):
    """(row, key, word, amount): four sums per document, and a row for whatever a token needs of the rest.

    Amounts of vocabulary pairs are negative in held-out documents, whose tokens aren't counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(trie_of.value)
        floor = float(trie.total + trie.types + 1)
        for batch in batches:
            row_id = batch.column("row").to_numpy()
            sign = np.where(batch.column("held_out").to_numpy(zero_copy_only=False), -1.0, 1.0)
            for i, j, raw, offs in pieces(batch.column("text")):
                hashes, at = tokens(raw, offs)
                ids = trie.word_ids(hashes)
                mine = row_id[i:j]
                row = mine[np.repeat(np.arange(j - i), np.diff(at))]
                of = np.repeat(np.arange(j - i), np.diff(at))
                value, plus, miss = score_tokens(trie, ids, at)
                sums = (np.bincount(of, value, j - i), np.bincount(of, plus, j - i), np.bincount(of, ids >= 0, j - i), np.diff(at).astype(float))
                parts = [(mine, mine, np.full(j - i, kind), x) for kind, x in zip((VALUE, PLUS, KNOWN, TOKENS), sums, strict=True)]

                def need(which, key, word, amount):
                    parts.append((row[which], key.astype(U64).view(np.int64), word, amount))  # noqa: B023

                context = contexts(trie, ids, at, 2)
                share = np.ones(len(ids))
                share[context >= 0] = floor / (DISCOUNT * np.maximum(trie.successors[context[context >= 0]], 1))
                inner = np.flatnonzero((miss >= 0) & (ids >= 0) & (context >= 0))
                # A pair that is only counted here, as a longer n-gram was found, gains next to nothing.
                amount = np.where(miss[inner] > 0, share[inner] / (trie.count[ids[inner]] + 1), 1e-30)
                amount = (amount * sign[i:j][of[inner]]).astype(np.float32).astype(float)
                need(inner, (context[inner] << 24) | ids[inner], np.full(len(inner), PAIR), amount)
                rare, first, second = outside(hashes, at, ids, context)
                need(rare, first, second.view(np.int64), share[rare].astype(np.float32).astype(float))
                # A document's contexts are its tokens, each as often, so an unknown word asks for its count and its back-off weight at once.
                unknown = np.flatnonzero(ids < 0)
                need(unknown, hashes[unknown], np.full(len(unknown), WORD), np.ones(len(unknown)))
                whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["row", "key", "word", "amount"])
                yield from (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE))

    return run


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of eight bytes, each as all of its first bytes, then all of its second ones, and so on."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(x.T).reshape(-1).view(np.int64) for x in planes]


def _part(key: np.ndarray, width: int) -> np.ndarray:
    return ((mix64(key) >> U64(32)) * U64(width) >> U64(32)).astype(np.int64)


def _deal(width: int, source=None):
    """(part, kind, data): what meets is dealt to one of ``width`` parts, many records in one row. Takes the rows of ``source``, or else those of the rest."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        row, key, word, amount = (np.concatenate(x) for x in zip(*held, strict=True))
        kind = np.full(len(key), REST)
        if source is not None:
            kind = np.where((word >= PAIR) & (word <= TOKENS), word, OUTER)
            pair, only = word == PAIR, np.abs(amount) <= NOTHING
            kind[pair & (amount < 0)] = HELD
            kind[pair & only] = SEEN
            some = np.flatnonzero(~(pair & only & (amount < 0)))
            row, key, word, amount, kind = row[some], key[some], word[some], amount[some], kind[some]
        met = np.where((kind == HELD) | (kind == SEEN), PAIR, word).astype(U64)
        part = _part(key.view(U64) + mix64(met + U64(1)), width)
        by = np.lexsort((key, part << 4 | kind))
        row, key, word, amount, kind, part = (x[by] for x in (row, key, word, amount, kind, part))
        at = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(key) else np.zeros(1, np.int64)
        rows, size = ([], [], []), 0
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            k = int(kind[i])
            columns = {OUTER: (key, word, row), REST: (key, word, amount)}.get(k, (row, amount) if VALUE <= k <= TOKENS else (key, row))
            data = _packed(*(c[i:j] for c in columns))
            for x, y in zip(rows, (int(part[i]), k, data), strict=True):
                x.append(y)
            size += len(data)
            if size >= (4 << 20) or j == at[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], names=["part", "kind", "data"])
                rows, size = ([], [], []), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches if source is None else source(batches):
            held.append([batch.column(c).to_numpy() for c in ("row", "key", "word", "amount")])
            size += batch.num_rows
            if size >= max(DEAL, 256 * width):
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _by_row(row: np.ndarray, sums: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows once, in order, and the sums of each; ``which`` names the one of four sums that an amount belongs to, else amounts are fours."""
    one, back = np.unique(row, return_inverse=True)
    if which is not None:
        return one, np.bincount(back + len(one) * which, sums, 4 * len(one)).reshape(4, -1)
    return one, np.stack([np.bincount(back, x, len(one)) for x in sums])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, value, plus, known, tokens) of the documents of one part."""
    held, size = [], 0

    def summed():
        row, sums = _by_row(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1))
        return [(row, sums)]

    for batch in batches:
        for data in batch.column("data"):
            row, *sums = _unpacked(data.as_buffer(), 5)
            held.append((row, np.stack(sums).view(np.float64)))
            size += len(row)
            if size >= CHUNK:
                held = summed()
                size = len(held[0][0]) // 2
    for row, sums in summed() if held else []:
        whole = pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, sums)], names=["row", "value", "plus", "known", "tokens"])
        yield from (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE))


def _meet(trie_of, width: int):
    """(part, data): what the tokens of one part gain where they meet, summed by document; the sums of many documents in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: [] for kind in FIELDS}
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                held[kind].append(_unpacked(data.as_buffer(), FIELDS[kind]))
        if not any(held.values()):
            return

        def taken(kind: int) -> list[np.ndarray]:
            got = held.pop(kind)
            return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * FIELDS[kind]

        trie = Trie(trie_of.value)
        floor = float(trie.total + trie.types + 1)
        out = []  # (row, column, amount)
        # Pairs of vocabulary words: training tokens are counted, those of both kinds ask.
        (key, row), (held_key, held_row), (seen, _) = taken(PAIR), taken(HELD), taken(SEEN)
        one, back = np.unique(np.concatenate([key, seen, held_key]), return_inverse=True)
        own = np.bincount(back[: len(key) + len(seen)], minlength=len(one)) - DISCOUNT
        amount = floor / (DISCOUNT * np.maximum(trie.successors[one >> 24], 1)) / (trie.count[one & (NUMBERS - 1)] + 1)
        gain = np.log1p(np.maximum(own, 0) * amount) / np.log(10)
        out.append((np.concatenate([row, held_row]), 0, gain[np.concatenate([back[: len(key)], back[len(key) + len(seen) :]])]))
        del key, row, held_key, held_row, seen, one, back, own, amount, gain
        # Other pairs, and words, meet their row of the rest, which stands first.
        (key, word, amount), (outer, second, row), (unknown, word_row) = taken(REST), taken(OUTER), taken(WORD)
        rest, pairs = len(key), len(outer)
        keys, second = np.concatenate([key, outer, unknown]), np.concatenate([word, second, np.full(len(unknown), WORD)])
        by = np.lexsort((second, keys))
        x, y = keys[by], second[by]
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(by)]) - 1
        known = np.full(len(by), np.nan)
        known[group[:rest]] = amount.view(np.float64)
        found = known[group[rest:]]
        ok = np.flatnonzero(~np.isnan(found[:pairs]))
        context = outer[ok]
        number = (context >= 0) & (context < NUMBERS)
        share = np.ones(len(ok))
        share[number] = floor / (DISCOUNT * np.maximum(trie.successors[context[number]], 1))
        out.append((row[ok], 0, np.log1p(found[:pairs][ok] * share) / np.log(10)))
        ok = np.flatnonzero(~np.isnan(found[pairs:]))
        found = found[pairs:][ok]
        count = np.floor(found)
        plus = np.log10(count + 1)
        out += [(word_row[ok], 0, plus + (found - count) * LEAST), (word_row[ok], 1, plus), (word_row[ok], 2, np.ones(len(ok)))]
        for place, kind in enumerate((VALUE, PLUS, KNOWN, TOKENS)):
            row, amount = taken(kind)
            out.append((row, place, amount.view(np.float64)))
        which = np.repeat([x[1] for x in out], [len(x[0]) for x in out])
        row, sums = _by_row(np.concatenate([x[0] for x in out]), np.concatenate([x[2] for x in out]), which)
        part = _part(row.view(U64), width)
        by = np.argsort(part, kind="stable")
        row, sums, part = row[by], np.ascontiguousarray(sums[:, by]), part[by]
        # The last three bytes of a score's part are beyond what quantised values mean; as zeros they cost nothing.
        sums[0] = ((sums[0].view(U64) + U64(1 << 23)) & ~U64((1 << 24) - 1)).view(np.float64)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
        data = [_packed(row[i:j], *sums[:, i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])

    return run


def score(docs: DataFrame, head: int = HEAD, ngrams: int = NGRAMS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    ship(spark)
    trie, rest, facts = train(docs, head, ngrams, order)
    trie_of = spark.sparkContext.broadcast(trie)
    narrow = docs.select("doc_id", "text")
    repeats = narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count()
    placed = numbered(narrow) if repeats else narrow.withColumn("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    given = placed.select("row", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    width = shuffle_width(narrow, 8 << 20)
    dealt = "part int, kind int, data binary"
    needed = given.select("row", "held_out", "text").mapInArrow(_deal(width, _score(trie_of)), dealt)
    answers = rest.select(F.lit(0).cast("long").alias("row"), "key", "word", "amount").mapInArrow(_deal(width), dealt)
    met = needed.unionByName(answers).repartitionById(width, F.col("part"))
    met = met.mapInArrow(_meet(trie_of, width), "part int, data binary").repartitionById(width, F.col("part"))
    sums = met.mapInArrow(_sum_up, "row long, value double, plus double, known double, tokens double")
    floor = F.lit(float(np.log10(facts["total"] + facts["types"] + 1)))
    return (
        given.select("row", "doc_id", "held_out")
        .join(sums, "row")
        .select("doc_id", "held_out", F.round("tokens").cast("long").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(facts["total"]).cast("long").alias("train_tokens"), (F.col("plus") - F.col("tokens") * floor).alias("base_score"), F.col("value").alias("score"))
    )
