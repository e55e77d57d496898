"""Queries over source documents laid over conversations: a document per conversation, a marked passage per turn, a review of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.operators import correspondence, fragments
from ledgerline.plans.catalogue import long, query
from ledgerline.sources.tables import table

PREFIX = "% CERT"


def _turns(s: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    held = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return held.withColumn("document", F.col("conv_id").cast("string"))


def documents(s: SparkSession, d: str) -> DataFrame:
    """(document, format, prefix, text): the turns of a conversation, each between its marks."""
    mark = lambda word, x=None: F.concat(F.lit(f"{PREFIX}{word}"), *([F.lit(" turn-"), x["turn"].cast("string")] if x is not None else []))
    shown = F.transform("turns", lambda x: F.concat_ws("\n", mark("-CLAIM-BEGIN", x), F.concat(F.lit("# "), x["role"]), mark("-SOURCE-BEGIN"), x["text"], mark("-SOURCE-END"), mark("-CLAIM-END", x)))
    return _turns(s, d).select("document", F.lit("markdown").alias("format"), F.lit(PREFIX).alias("prefix"), F.array_join(shown, "\n").alias("text"))


def passages(s: SparkSession, d: str) -> DataFrame:
    """Every turn by its marker, the first turn's heading by its line, and a range behind the end."""
    none = F.lit(None).cast("int")
    turns = F.transform(F.array_distinct(F.transform("turns", lambda x: x["turn"])), lambda t: F.struct(F.concat(F.lit("turn-"), t.cast("string")).alias("id"), F.concat(F.lit("turn-"), t.cast("string")).alias("marker"), none.alias("first"), none.alias("last")))
    lines = [F.struct(F.lit(i).alias("id"), F.lit(None).cast("string").alias("marker"), F.lit(a).alias("first"), F.lit(b).alias("last")) for i, a, b in (("heading", 2, 2), ("beyond", 1, 1 << 30))]
    listed = F.inline(F.concat(turns, F.array(*lines)))
    return fragments.resolve(_turns(s, d).select("document", listed), documents(s, d))


PLACED = r"""WITH t AS (SELECT CAST(conv_id AS STRING) AS document, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS k FROM conversations),
sized AS (SELECT *, len(string_split(text, chr(10))) AS n FROM t),
placed AS (SELECT *, coalesce(sum(n + 5) OVER (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4 AS first FROM sized),
found AS (SELECT document, 'turn-' || CAST(turn AS STRING) AS id, first, first + n - 1 AS last, text FROM placed QUALIFY row_number() OVER (PARTITION BY document, turn ORDER BY k DESC) = 1
  UNION ALL SELECT document, 'heading', 2, 2, '# ' || role FROM placed WHERE k = 1)"""
TRIMMED = r"regexp_replace(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"{PLACED} SELECT document, id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, sha256({TRIMMED}) AS sha256 FROM found")
def source_passages(s, d):
    return long(passages(s, d).select("document", "id", "first", "last", "sha256"), "first", "last")


@query(
    rf"""{PLACED}, cut AS (SELECT document, id, text, string_split(regexp_replace(text, '(?s)\$\$(.+?)\$\$', chr(1), 'g'), chr(1)) AS pieces FROM found),
paras AS (SELECT document, id, len(pieces) - 1 AS displays, list_filter(list_transform(flatten(list_transform(pieces, lambda p: regexp_split_to_array(p, '\n\s*\n'))), lambda p: trim(p, ' ' || chr(10) || chr(9) || chr(13))), lambda p: p <> '') AS p FROM cut)
SELECT document, id, CAST(displays AS BIGINT) AS displays, CAST(len(list_filter(p, lambda x: regexp_full_match(x, '#{{1,6}}\s+[^\n]*'))) AS BIGINT) AS headings,
CAST(coalesce(list_sum(list_transform(list_filter(p, lambda x: regexp_matches(x, '^[-*+] ')), lambda x: len(list_filter(string_split(x, chr(10)), lambda l: trim(regexp_replace(l, '^\s*[-*+]\s+', '')) <> '')))), 0) AS BIGINT) AS items,
CAST(len(list_filter(p, lambda x: NOT regexp_full_match(x, '#{{1,6}}\s+[^\n]*') AND NOT regexp_matches(x, '^[-*+] '))) AS BIGINT) AS paragraphs FROM paras"""
)
def source_blocks(s, d):
    parsed = passages(s, d).withColumn("blocks", fragments.blocks(F.col("text"), F.col("format")))
    count = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind)).cast("long")
    return parsed.select("document", "id", count("display").alias("displays"), count("heading").alias("headings"), count("item").alias("items"), count("paragraph").alias("paragraphs"))


#: What the review of a conversation says, by the number of the turn and of the conversation.
RELATION = "CASE turn % 4 WHEN 0 THEN 'literal' WHEN 1 THEN 'via_theorem' WHEN 2 THEN 'inherited_standing_assumption' ELSE 'made_up' END"
STATUS = "CASE WHEN turn % 5 = 4 THEN 'open' ELSE 'claimed_exact' END"
EXCERPT = "CASE turn % 3 WHEN 0 THEN trim(substr(text, 1, 40)) WHEN 1 THEN 'nowhere in turn ' || CAST(turn AS STRING) ELSE '' END"


@query(
    f"""{PLACED}, c AS (SELECT document, CAST(document AS BIGINT) AS conv, turn, k - 1 AS i, {RELATION} AS relation, {STATUS} AS status, {EXCERPT} AS excerpt,
  'conv/' || document AS whole, 'conv/' || document || '.clause_map[' || CAST(k - 1 AS STRING) || ']' AS loc FROM placed),
r AS (SELECT document, conv, whole, count(*) FILTER (turn = 0) AS primaries, bool_or(relation = 'inherited_standing_assumption') AS inherits FROM c GROUP BY document, conv, whole)
SELECT document AS review, 'error' AS level, 'clause-relation' AS code, loc AS location FROM c WHERE relation = 'made_up'
UNION ALL SELECT document, 'error', 'clause-excerpt-required', loc FROM c WHERE (relation IN ('via_theorem', 'inherited_standing_assumption') OR status = 'open') AND excerpt = ''
UNION ALL SELECT document, 'error', 'clause-evidence', loc FROM c WHERE relation = 'via_theorem' AND turn % 3 <> 0
UNION ALL SELECT document, 'error', 'clause-declaration', loc FROM c WHERE conv % 2 = 1
UNION ALL SELECT document, 'warning', 'clause-evidence-unregistered', loc FROM c WHERE turn % 3 = 0
UNION ALL SELECT document, 'error', 'clause-excerpt', loc FROM c WHERE turn % 3 = 1
UNION ALL SELECT document, 'error', 'source-fragment-primary', whole FROM r WHERE primaries <> 1
UNION ALL SELECT document, 'error', 'source-interpretation', whole FROM r WHERE conv % 4 = 3
UNION ALL SELECT document, 'error', 'source-interpretation-local', whole FROM r WHERE inherits AND conv % 4 = 1
UNION ALL SELECT document, 'warning', 'source-interpretation-missing', whole FROM r WHERE inherits AND conv % 4 = 0
UNION ALL SELECT document, 'warning', 'source-interpretation-rationale', whole FROM r WHERE inherits AND conv % 4 >= 2
UNION ALL SELECT document, 'warning', 'source-interpretation-nonlocal', whole FROM r WHERE NOT inherits AND conv % 4 = 2"""
)
def correspondence_findings(s, d):
    name = F.concat(F.lit("turn-"), F.col("t.turn").cast("string"))
    turn = _turns(s, d).select("conv_id", "document", F.posexplode("turns").alias("k", "t")).selectExpr("conv_id", "document", "k", "t", "t.turn AS turn", "t.text AS text")
    turn = turn.withColumns({"relation": F.expr(RELATION), "status": F.expr(STATUS), "excerpt": F.expr(EXCERPT)})
    conv = F.col("conv_id")
    own = F.concat(F.lit("conv."), "document")
    fragment = F.struct(name.alias("id"), F.struct(name.alias("marker")).alias("locator"), F.when(F.col("turn") == 0, "primary").otherwise("context").alias("role"))
    clause = F.struct(F.col("relation"), F.col("status"), name.alias("source_fragment"), F.col("excerpt").alias("source_excerpt"), F.array(own).alias("lean_declarations"), F.when(F.col("turn") % 3 == 0, F.array(F.concat(F.lit("thm."), F.col("turn").cast("string")))).alias("correspondence_declarations"))
    review = turn.groupBy("conv_id", "document").agg(F.array_sort(F.collect_list(F.struct("k", fragment.alias("f"), clause.alias("c")))).alias("rows"))
    reading = F.when(conv % 4 == 1, "local").when(conv % 4 == 2, "nonlocal").when(conv % 4 == 3, "odd")
    body = F.to_json(F.struct(F.transform("rows", lambda x: x["f"]).alias("source_fragments"), F.transform("rows", lambda x: x["c"]).alias("clause_map"), reading.alias("source_interpretation")))
    registered = F.array(F.when(conv % 2 == 0, own).otherwise("other.x"))
    reviews = materialise(review.select(F.col("document").alias("review"), F.concat(F.lit("conv/"), "document").alias("location"), body.alias("body"), registered.alias("declarations")), "reviews")
    texts = passages(s, d).where("id like 'turn-%'").select(F.col("document").alias("review"), F.col("id").alias("fragment"), "text")
    return correspondence.validate(reviews, texts)
