r"""Personal data: pattern spans, and terms that give protected entities away, in DataFrame functions only.

Base spans (email, ip, card, phone) come from linear-time forms of the patterns:
possessive groups, and look-behinds that start a match only where a leftmost match can
start, so that a long run of pattern characters isn't retried from each of its
positions. Positions come from the lengths of the pieces between matches, in code points.

On top of them stands information-theoretic sanitisation. A protected entity is a base
span's kind and value. A term (three letters or more) co-occurs with an entity where it
stands within ``WINDOW`` characters of it. Over the whole corpus

    disclosure(t, c) = PMI(t; c) / IC(c) = log(n_tc * N / (n_t * n_c)) / log(N / n_c),

by documents, is how much of the entity's information the term gives away: 1 if every
document with the term holds the entity, 0 if they are independent. An estimate from few
observations is shrunk by k / (k + 1) for k *different contexts* that hold both (copies of
one document are no evidence), and by m / (m + 1) for the lesser m of n_t and n_c: always
together in 1, 2, 3, 8 contexts give 0.25, 0.44, 0.56, 0.79. Every pair is scored, whatever its
support; terms at or above the threshold are disclosing, and every occurrence, in whichever
document, becomes a span of kind ``term`` and is generalised to its kind or removed.

Scale: base spans, one scan. Context pairs are bounded by base spans times the window.
Term frequencies are pre-aggregated map-side, so what moves is vocabulary per task, not
words. Joins are left to Spark's own size rules; hot terms combine before the shuffle.

Defined cases: null text counts as empty and has no spans; equal spans of repeated rows
are reported per row; a match that fails its check is dropped without retry; if nothing
is disclosing the result is the base spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Linear forms of the base patterns. A leftmost match starts at the head of a run or where the last match ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TRIGGER = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
WINDOW = 60
THRESHOLD = 0.4
TERM = r"\p{L}{3,}"


def matches(text: Column, pattern: Column, rank: int) -> Column:
    """Spans (start, rank, end, value) of a pattern's matches; code points, end exclusive."""
    walked = F.aggregate(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), a["out"])
            .otherwise(
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["p"])).alias("start"),
                            F.lit(rank).alias("rank"),
                            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                            x["m"].alias("value"),
                        )
                    ),
                )
            )
            .cast(SPAN)
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    return walked


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda span: valid(kind, span["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, the array of its valid spans."""
    out = {}
    for rank, kind in enumerate(KINDS):
        found = F.filter(matches(text, F.lit(PATTERNS[kind]), rank), _checker(kind))
        gate = text.contains(TRIGGER[kind]) if TRIGGER[kind] else text.rlike("[0-9](?:[\\x20-]?[0-9]){11}")
        out[kind] = F.when(gate, found).otherwise(F.array().cast(SPAN))
    return out


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def contexts(found: DataFrame) -> DataFrame:
    """(row, entity, term, context) for terms that stand near a base span; rows count, whatever their ids."""
    one = found.where(F.size("spans") > 0).select("row", "near")
    one = one.select("row", F.explode("near").alias("n"))
    return one.select(
        "row",
        F.col("n.entity").alias("entity"),
        F.xxhash64("n.around").alias("context"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("n.around"), F.lit(TERM), F.lit(0)))).alias("term"),
    )


def disclosing_terms(found: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(entity, term, disclosure) at or above the threshold, from counts over every document."""
    near = contexts(found)
    pairs = near.groupBy("entity", "term", "context").agg(F.count_distinct("row").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_tc"), F.count(F.lit(1)).alias("k"))
    # PMI is at most IC, so a pair whose shrinkage alone is below the threshold can't reach it.
    pairs = materialise(pairs.where(F.col("k") >= F.lit(threshold) * (F.col("k") + 1)), "op2-pairs")
    held = found.where(F.size("spans") > 0).select("doc_id", F.explode(F.array_distinct(F.transform("near", lambda n: n["entity"]))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    wanted = pairs.select("term").distinct()
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = F.lit(docs.count())
    scored = pairs.join(held, "entity").join(terms, "term")
    ic = F.log(total / F.col("n_c"))
    pmi = F.log(F.col("n_tc") * total / (F.col("n_t") * F.col("n_c")))
    fewest = F.least("n_t", "n_c")
    shrunk = pmi / ic * F.col("k") / (F.col("k") + 1) * fewest / (fewest + 1)
    return scored.withColumn("disclosure", F.when(ic > 0, shrunk).otherwise(0.0)).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def sanitise(text: Column, spans: Column, remove: bool = False) -> Column:
    """The text with each span generalised to its kind in brackets, or removed; overlaps are merged first-come."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    walked = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("") if remove else F.concat(F.lit("["), F.element_at(names, s["rank"] + 1), F.lit("]"))).alias("out"),
            )
        ),
        lambda a: F.struct(a["at"].alias("at"), a["out"].alias("out")),
    )
    return F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term (and ``sanitised`` if asked for)."""
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = base_spans(F.col("text"))
    found = docs.withColumns({f"s_{k}": c for k, c in kinds.items()}).withColumn("spans", F.concat(*[F.col(f"s_{k}") for k in KINDS]))
    around = F.transform(
        "spans",
        lambda s: F.struct(
            F.concat_ws(":", s["rank"].cast("string"), s["value"]).alias("entity"),
            F.concat_ws(" ", F.substring(F.col("text"), F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW))), F.substring(F.col("text"), s["end"] + 1, F.lit(WINDOW))).alias("around"),
        ),
    )
    found = found.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), "spans", around.alias("near"), *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), *(["text"] if keep_text else [])
    )
    found = materialise(found, "op2-spans")
    terms = materialise(disclosing_terms(found, docs, threshold).select("term").distinct(), "op2-terms")
    if terms.isEmpty():
        marked = found.withColumn("extra", F.array().cast(SPAN))
    else:
        keyed = docs.withColumn("h", F.xxhash64("text"))
        words = keyed.select("doc_id", "h", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).join(terms, "term")
        per_doc = words.groupBy("doc_id", "h").agg(F.concat_ws("|", F.array_sort(F.collect_set("term"))).alias("either")).select(F.col("doc_id").alias("in_doc"), F.col("h").alias("in_h"), "either")
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("either"), F.lit(r")(?!\p{L})"))
        hit = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("h") == F.col("in_h")))
        extra = hit.select("doc_id", "h", matches(F.col("text"), pattern, len(KINDS)).alias("extra")).dropDuplicates(["doc_id", "h"])
        extra = extra.select(F.col("doc_id").alias("of"), F.col("h").alias("h_of"), "extra")
        marked = found.join(extra, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("h_of")), "left").withColumn("extra", F.coalesce("extra", F.array().cast(SPAN)))
    whole = F.concat("spans", "extra")
    return marked.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", listed(whole).alias("spans"), F.size("extra").cast("long").alias("n_term"), *([sanitise(F.col("text"), whole).alias("sanitised")] if keep_text else [])
    )
