"""Source documents: passages that locators point at, and the blocks and spans that a passage consists of.

Sources are (document, format, prefix, text): format is tex, markdown or text; with a prefix, lines that hold
``<prefix>-CLAIM-BEGIN name`` and ``-CLAIM-END name``, and between them ``-SOURCE-BEGIN`` and ``-SOURCE-END``, mark passages.
Locators are (id, document, marker, first, last): a marker's name, else a range of lines.

A text is cut into numbered lines once; markers are found by windows over the few lines that hold one. Locators meet the
lines of their range in an interval join: both sides carry the number of a run of ``RUN`` lines, so a passage reads its own
lines only, however many passages a document has.

A passage is parsed by expressions alone into an array of blocks (display, heading, anchor, item, paragraph) with their spans
(text, math, emph, strong, code).

Defined cases: a marker that isn't there, a range that ends behind the last line, and a locator with neither are unresolved (no
row); a range that ends before it begins is an empty passage; null texts are no documents; a null format is markdown; marks within marks are not told apart; the characters U+0001 and U+0002 are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise

RUN = 64
#: White space as it is taken off the ends of lines and texts.
BLANK = r"[\h\x0b\x0c\r\x1c-\x1f\x85\u2028\u2029]"
#: Environments that display mathematics.
DISPLAYS = ("equation", "align", "gather", "multline")
SPAN = "struct<kind:string,text:string>"
BLOCK = f"struct<kind:string,spans:array<{SPAN}>,text:string,tag:string>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A(?:{BLANK}|\n)+|(?:{BLANK}|\n)+\z", "")


def content_sha256(text: Column) -> Column:
    """A hash that the ends of lines and of the text don't move."""
    unified = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), rf"{BLANK}+(?=\n|\z)", "")
    return F.sha2(strip(unified), 256)


def lines_of(sources: DataFrame) -> DataFrame:
    """(document, prefix, n, line), lines counted from 1."""
    listed = F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    return sources.where("text is not null").select("document", "prefix", listed).select("document", "prefix", (F.col("at") + 1).alias("n"), "line")


def markers(lines: DataFrame) -> DataFrame:
    """(document, marker, first, last): the lines between a marker's source marks; where it has none, all between its begin and end."""
    after = lambda word: F.regexp_extract(F.when(F.instr("line", F.concat("prefix", F.lit(word))) > 0, F.expr(f"substring(line, instr(line, concat(prefix, '{word}')) + length(concat(prefix, '{word}')))")), r"\A\s+(\S+)", 1)
    holds = lambda word: F.col("line").contains(F.concat("prefix", F.lit(word)))
    begin, end = F.nullif(after("-CLAIM-BEGIN"), F.lit("")), F.nullif(after("-CLAIM-END"), F.lit(""))
    event = F.when(begin.isNotNull(), "begin").when(holds("-SOURCE-BEGIN"), "from").when(holds("-SOURCE-END"), "to").when(end.isNotNull(), "end")
    seen = lines.where("prefix <> ''").where(F.col("line").contains(F.col("prefix"))).select("document", "n", event.alias("event"), begin.alias("name")).where("event is not null")
    before = Window.partitionBy("document").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x: F.last(x, ignorenulls=True).over(before)
    state = F.when(F.col("event") == "begin", F.struct("name", "n")).when(F.col("event") == "end", F.struct(F.lit(None).cast("string").alias("name"), "n"))
    seen = seen.withColumn("open", last(state)).where("event = 'begin' or open.name is not null")
    inner = F.when(F.col("event") == "from", F.col("n")).when(F.col("event").isin("begin", "to"), F.lit(0))
    seen = seen.withColumn("inner", F.coalesce(last(inner), F.lit(0)))
    closed = (
        seen.where("event = 'end' or (event = 'to' and inner > 0)")
        .withColumn("marker", F.col("open.name"))
        .withColumn("first", F.when(F.col("event") == "to", F.col("inner")).otherwise(F.col("open.n")) + 1)
    )
    # The last marked source counts, whatever the blocks; without any, the first block.
    found = closed.groupBy("document", "marker").agg(F.max(F.when(F.col("event") == "to", F.struct("n", "first"))).alias("source"), F.min(F.when(F.col("event") == "end", F.struct("n", "first"))).alias("block"))
    at = F.coalesce("source", "block")
    return found.select("document", "marker", at["first"].alias("first"), (at["n"] - 1).alias("last"))


def resolve(locators: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, document, marker, first, last, format, text, sha256) of the locators that lead to a passage."""
    lines = materialise(lines_of(sources), "lines")
    size = lines.groupBy("document").agg(F.max("n").alias("size"))
    index = markers(lines).withColumnsRenamed({"first": "m_first", "last": "m_last"})
    named = F.coalesce(F.col("marker"), F.lit("")) != ""
    ranged = locators.join(index, ["document", "marker"], "left").join(size, "document")
    ranged = ranged.where(F.when(named, F.col("m_first").isNotNull()).otherwise(F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("last") <= F.col("size"))))
    ranged = ranged.select("id", "document", "marker", F.when(named, F.col("m_first")).otherwise(F.col("first")).cast("int").alias("first"), F.when(named, F.col("m_last")).otherwise(F.col("last")).cast("int").alias("last"))
    ranged = materialise(ranged.withColumn("row", F.monotonically_increasing_id()), "locators")
    run = lambda n: F.floor(n / RUN).cast("int")
    low = F.greatest("first", F.lit(1))
    spans = ranged.where(F.col("last") >= low).select("row", "document", "first", "last", F.explode(F.sequence(run(low), run(F.col("last")))).alias("run"))
    met = spans.join(lines.withColumn("run", run(F.col("n"))), ["document", "run"]).where("n between first and last")
    texts = met.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = ranged.join(texts, "row", "left").join(sources.select("document", F.coalesce("format", F.lit("markdown")).alias("format")), "document").withColumn("text", F.coalesce("text", F.lit("")))
    return whole.select("id", "document", "marker", "first", "last", "format", "text", content_sha256(F.col("text")).alias("sha256"))


def _prose(text: Column) -> Column:
    """Dashes, quotes and spaces as a reader sees them."""
    text = F.regexp_replace(text, r"(?s)\\href\{[^}]*\}\{(.*?)\}", "$1")
    for given, shown in (("~", " "), ("---", "—"), ("--", "–"), ("``", "“"), ("''", "”")):
        text = F.replace(text, F.lit(given), F.lit(shown))
    text = F.regexp_replace(text, r"\\(?:(?:par|noindent|smallskip|medskip|bigskip)\b|[,;!](?=\w))", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\\([%&#_$])", "$1"), rf"(?:{BLANK}|\n)+", " ")


def _spans(body: Column) -> Column:
    """Spans of a paragraph: mathematics first, marked words in what is left, then plain text."""
    kinds = {"M": "math", "E": "emph", "S": "strong", "C": "code", "T": "text"}
    kind = lambda x: F.coalesce(*[F.when(F.left(x, F.lit(1)) == k, v) for k, v in kinds.items()])
    rest = lambda x: F.substring(x, 2, F.length(x))

    def marked(x: Column) -> Column:
        for macro, k in ((r"emph", "E"), (r"textbf", "S"), (r"(?:code|texttt)", "C")):
            x = F.regexp_replace(x, rf"(?s)\\{macro}\{{(.*?)\}}", f"\u0002{k}$1\u0002T")
        return F.transform(F.split(F.concat(F.lit("T"), x), "\u0002"), lambda y: F.struct(kind(y).alias("kind"), F.when(kind(y) == "text", _prose(rest(y))).otherwise(strip(_prose(rest(y)))).alias("text")))

    cut = F.split(F.concat(F.lit("T"), F.regexp_replace(body, r"(?s)(?<!\\)\$(.+?)(?<!\\)\$", "\u0001M$1\u0001T")), "\u0001")
    parts = F.flatten(F.transform(cut, lambda x: F.when(F.left(x, F.lit(1)) == "M", F.array(F.struct(F.lit("math").alias("kind"), strip(rest(x)).alias("text")))).otherwise(marked(rest(x)))))
    parts = F.filter(parts, lambda s: (s["kind"] != "text") | (s["text"] != ""))
    solid = F.transform(parts, lambda s: (s["kind"] != "text") | (F.trim(s["text"]) != ""))
    first, last = F.array_position(solid, True), F.size(parts) - F.array_position(F.reverse(solid), True) + 1
    inner = F.when(first > 0, F.slice(parts, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.array().cast(f"array<{SPAN}>"))

    def trimmed(s: Column, i: Column) -> Column:
        text = F.when((i == 0) & (s["kind"] == "text"), F.ltrim(s["text"])).otherwise(s["text"])
        return F.struct(s["kind"].alias("kind"), F.when((i == last - first) & (s["kind"] == "text"), F.rtrim(text)).otherwise(text).alias("text"))

    return F.transform(inner, trimmed)


def _block(kind: str, spans: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), spans.alias("spans"), F.lit("").alias("text"), F.lit("").alias("tag")).cast(BLOCK)


def _display(body: Column) -> Column:
    tag = r"\\tag\{([^}]*)\}"
    none = F.array().cast(f"array<{SPAN}>")
    return F.struct(F.lit("display").alias("kind"), none.alias("spans"), strip(F.regexp_replace(body, tag, "")).alias("text"), strip(F.regexp_extract(body, tag, 1)).alias("tag")).cast(BLOCK)


def _markdown(para: Column) -> Column:
    shown = lambda x: _spans(F.regexp_replace(F.regexp_replace(x, r"(?s)\*\*(.+?)\*\*", r"\\textbf{$1}"), r"`([^`]+)`", r"\\code{$1}"))
    heading = r"\A#{1,6}\s+(.*)\z"
    bullets = F.filter(F.transform(F.split(para, "\n"), lambda x: F.regexp_replace(x, r"\A\s*[-*+]\s+", "")), lambda x: strip(x) != "")
    listed = F.transform(bullets, lambda x: _block("item", shown(x)))
    return F.when(para.rlike(heading), F.array(_block("heading", shown(F.regexp_extract(para, heading, 1))))).when(para.rlike(r"\A[-*+] "), listed).otherwise(F.array(_block("paragraph", shown(para))))


def _tex(para: Column) -> Column:
    heading, anchor, item = r"(?s)\A\\(?:sub)*section\*?\{(.*)\}\z", r"(?s)\\sourceanchor\{(.*?)\}", r"(?s)\A\\item(?:\[(.*?)\])?\s*"
    empty = F.array().cast(f"array<{BLOCK}>")
    anchored = para.rlike(anchor)
    left = F.when(anchored, strip(F.regexp_replace(para, anchor, ""))).otherwise(para)
    left = F.when(left.rlike(r"\A\\(?:begin|end)\{"), strip(F.regexp_replace(left, r"\\(?:begin|end)\{[^}]*\}", ""))).otherwise(left)
    label = F.regexp_extract(left, item, 1)
    strong = F.when(label != "", F.array(F.struct(F.lit("strong").alias("kind"), _prose(label).alias("text")))).otherwise(F.array().cast(f"array<{SPAN}>"))
    body = F.when(left == "", empty).when(left.rlike(item), F.array(_block("item", F.concat(strong, _spans(F.regexp_replace(left, item, "")))))).otherwise(F.array(_block("paragraph", _spans(left))))
    said = F.when(anchored, F.array(_block("anchor", _spans(F.regexp_extract(para, anchor, 1))))).otherwise(empty)
    return F.when(para.rlike(heading), F.array(_block("heading", _spans(F.regexp_extract(para, heading, 1))))).otherwise(F.concat(said, body))


def blocks(text: Column, format: Column) -> Column:
    """The blocks of a passage, an array in order."""
    given = F.translate(text, "\u0001\u0002", "")
    envs = "|".join(rf"{e}\*?" for e in DISPLAYS)

    def parsed(body: Column, display: str, shown: str, paragraph) -> Column:
        cut = F.split(F.concat(F.lit("P"), F.regexp_replace(body, display, f"\u0001D{shown}\u0001P")), "\u0001")
        rest = lambda x: F.substring(x, 2, F.length(x))
        paras = lambda x: F.filter(F.transform(F.split(x, r"\n\s*\n"), strip), lambda p: p != "")
        return F.flatten(F.transform(cut, lambda x: F.when(F.left(x, F.lit(1)) == "D", F.array(_display(rest(x)))).otherwise(F.flatten(F.transform(paras(rest(x)), paragraph)))))

    tex = parsed(F.regexp_replace(given, r"(?<!\\)%.*", ""), rf"(?s)\\\[(.+?)\\\]|\\begin\{{({envs})\}}(.+?)\\end\{{\2\}}", "$1$3", _tex)
    return F.when(format == "tex", tex).otherwise(parsed(given, r"(?s)\$\$(.+?)\$\$|\\\[(.+?)\\\]", "$1$2", _markdown))


def plain(parsed: Column) -> Column:
    """What a reader sees of a passage's blocks, mathematics as written; quotes are held against this."""
    return F.array_join(F.transform(parsed, lambda b: F.when(b["kind"] == "display", b["text"]).otherwise(F.array_join(F.transform(b["spans"], lambda s: s["text"]), ""))), "\n")
