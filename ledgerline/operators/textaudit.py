"""Audits of source text: duplicates, dead names, ratchets, symbols, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z_][A-Za-z0-9_]*"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, outer ones dropped."""
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def duplicate_groups(files: DataFrame, minimum_chars: int = 20) -> DataFrame:
    """(digest, members, first_path): equal squeezed texts under two paths or more."""
    given = files.select("path", squeezed(F.col("text")).alias("s")).where(F.length("s") >= minimum_chars).select("path", F.substring(F.sha1("s"), 1, 12).alias("digest"))
    return given.groupBy("digest").agg(F.count_distinct("path").alias("members"), F.min("path").alias("first_path")).where("members > 1")


def token_counts(files: DataFrame, pattern: str = TOKEN) -> DataFrame:
    return files.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def dead_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, definitions, uses): names seen no more often than they are defined."""
    defined = names.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"))
    counts = token_counts(files).join(defined.select(F.col("name").alias("token")), "token", "left_semi")
    both = defined.join(counts, defined.name == counts.token, "left").select("name", "definitions", F.coalesce("n", F.lit(0)).cast("long").alias("uses"))
    return both.where("uses <= definitions")


def ratchet(files: DataFrame, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """(rule, found, maximum, status) for (id, pattern, count of 'matches' or 'files', maximum); all rules in one scan."""
    sums = []
    for name, pattern, count, _ in rules:
        hits = F.regexp_count("text", F.lit(pattern))
        sums.append(F.sum(hits if count == "matches" else (hits > 0).cast("int")).cast("long").alias(name))
    total = files.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("found"), F.lit(m).cast("long").alias("maximum")) for n, _, _, m in rules]))
    one = total.select(rows.alias("r")).select("r.*")
    return one.withColumn("status", F.when(F.col("found") > F.col("maximum"), "above").when(F.col("found") < F.col("maximum"), "below").otherwise("at"))


def symbol_census(files: DataFrame, pattern: str, comment: str) -> DataFrame:
    """(path, raw, code): matches in the whole text and outside comments (a regular expression), where there are any."""
    raw, code = F.regexp_count("text", F.lit(pattern)), F.regexp_count(F.regexp_replace("text", comment, " "), F.lit(pattern))
    return files.select("path", raw.cast("long").alias("raw"), code.cast("long").alias("code")).where("raw > 0 or code > 0")


def strip_nested(files: DataFrame, opening: str = "/-", closing: str = "-/", line: str = "--") -> DataFrame:
    """Files with nested block comments and line comments blanked; newlines and offsets stay. One file per row, vectorised by batch."""
    import re

    marks = re.compile("|".join(re.escape(m) for m in (opening, closing, line, "\n")))
    blank = re.compile(r"[^\n]")

    def clean(text: str) -> str:
        out, depth, at, in_line = [], 0, 0, False
        for m in marks.finditer(text):
            piece = text[at : m.start()]
            hidden = depth > 0 or in_line
            out.append(blank.sub(" ", piece) if hidden else piece)
            mark, at = m.group(), m.end()
            if mark == "\n":
                in_line = False
                out.append(mark)
            elif mark == opening and not in_line:
                depth += 1
                out.append(" " * len(mark))
            elif mark == closing and depth and not in_line:
                depth -= 1
                out.append(" " * len(mark))
            elif mark == line and not depth and not in_line:
                in_line = True
                out.append(" " * len(mark))
            else:
                out.append(" " * len(mark) if hidden else mark)
        piece = text[at:]
        out.append(blank.sub(" ", piece) if depth or in_line else piece)
        return "".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t) if t is not None else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, text string")


def profiles(files: DataFrame) -> DataFrame:
    """(path, lines, chars, longest_line, blank_lines) of every file."""
    lines = F.split("text", "\n", -1)
    return files.select(
        "path", F.size(lines).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest_line"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("blank_lines")
    )


def marked_lines(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, text): every line that matches."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(pattern)).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def excerpts(quotes: DataFrame, files: DataFrame, gram: int = 5, whole: bool = False) -> DataFrame:
    """(quote_id, path): files whose squeezed text holds the squeezed quote, with ``whole`` as whole words. They meet on hashes of the word n-grams after the quote's first word, then the text decides.

    A quote's outer words may be parts of a file's words, so only those between them make
    its n-gram, ``gram`` words at most; files give n-grams of each length that quotes ask
    for. What is shuffled is a hash and a path for each n-gram; texts are fetched for the
    pairs that met. Quotes of one or two words have no inner word: as whole words they meet
    on themselves, else they are held against every file. Null ids and texts are left out.
    """
    def words(column: str) -> Column:
        return F.split(squeezed(F.lower(column)), " ")

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size("words") - n + 1)
        return F.when(F.size("words") >= n, F.transform(at, lambda i: F.xxhash64(F.slice("words", i, n)))).otherwise(F.array().cast("array<long>"))

    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" ")) if whole else c
    asked = quotes.where("quote_id is not null and text is not null").select("quote_id", pad(squeezed(F.col("text"))).alias("quote"), words("text").alias("words"))
    outer = F.size("words") - 2
    asked = asked.withColumn("n", F.when(outer > 0, F.least(outer, F.lit(gram))).otherwise(F.size("words") if whole else 0)).withColumn("at", F.when(outer > 0, 2).otherwise(1))
    keyed = asked.where("n > 0").select("quote_id", F.xxhash64(F.slice("words", F.col("at"), F.col("n"))).alias("gram"))
    sizes = sorted(r.n for r in asked.where("n > 0").select("n").distinct().collect())
    given = files.where("path is not null and text is not null")
    every = F.array_distinct(F.concat(F.array().cast("array<long>"), *[grams(n) for n in sizes]))
    held = given.select("path", words("text").alias("words")).select("path", F.explode(every).alias("gram"))
    met = held.join(keyed, "gram").select("path", "quote_id").distinct().join(asked.select("quote_id", "quote"), "quote_id")
    body = given.select("path", pad(squeezed(F.col("text"))).alias("body"))
    long = met.join(body, "path").where(F.col("body").contains(F.col("quote"))).select("quote_id", "path")
    short = body.join(asked.where("n = 0").select("quote_id", "quote"), F.col("body").contains(F.col("quote"))).select("quote_id", "path")
    return long.unionByName(short).distinct()
