"""Rules of a review's correspondence: its source fragments, its clauses, and how it reads its passage.

Reviews are (review, location, body, declarations): a JSON body and the names registered with the row. Every rule is an
expression over the clause that it concerns, so that a review costs one pass over its exploded clauses; what clauses need of their review
(fragments and their roles, the vocabulary of relations) is carried in arrays and maps. Quoted excerpts are held against the fragments' plain
texts by a join; without such texts that rule is skipped.

Defined cases: bodies that are no JSON object have no findings here; fragments and clauses that are no objects are passed over (clauses keep their places,
fragments are counted without them); blank texts count as absent; of fragments with one id the last one's role counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import folded
from ledgerline.operators.documents import FINDING, _rules, type_of

#: States of a clause.
STATUSES = ("claimed_exact", "derived", "scope_companion", "open")
#: Relations of a clause to its source; those that must name a theorem, and those that must quote the source.
RELATIONS = (
    "literal", "definitional", "via_theorem", "representation_change", "specialization", "generalization",
    "stronger_than_source", "weaker_than_source", "inherited_standing_assumption", "object_representation", "refutation",
)
NEED_EVIDENCE = ("via_theorem", "representation_change", "refutation")
NEED_EXCERPT = ("via_theorem", "representation_change", "inherited_standing_assumption", "refutation")
#: Kinds of clauses, of pointers into a statement and into a source, roles of fragments, readings.
KINDS = ("setup", "hypothesis", "conclusion", "scope", "object", "note")
LEAN_KINDS = ("binder", "binder_type_dep", "result", "declaration", "text")
SOURCE_KINDS = ("math", "excerpt", "fragment")
ROLES = ("primary", "standing_assumption", "definition", "convention", "context")
INHERITED_ROLES = ("standing_assumption", "convention")
READINGS = ("local", "nonlocal")


def _text(value: Column, field: str) -> Column:
    got = F.try_variant_get(value, f"$.{field}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(got) == "STRING", F.trim(F.try_variant_get(got, "$", "string"))), F.lit(""))


def _list(value: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _names(value: Column, field: str) -> Column:
    """One name, or the names of a list."""
    whole = _text(value, field)
    texts = F.transform(_list(value, field), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.when(whole != "", F.array(whole)).otherwise(F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != "")))


def _finding(level: str, code: str, where: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), where.alias("location"))


def _per(items: Column, where, *rules) -> Column:
    """Findings of each item of an array: rules are (level, code, condition of the item); ``where`` gives an item's place by its number."""
    found = F.transform(items, lambda x, i: F.filter(F.array(*[F.when(cond(x), _finding(level, code, where(i))) for level, code, cond in rules]), lambda f: f.isNotNull()))
    return F.flatten(found).cast(FINDING)


def _in(word: Column, words: Column) -> Column:
    return F.coalesce(F.array_contains(words, word), F.lit(False))


def of_rows(docs: DataFrame) -> DataFrame:
    """The findings on the rows of review documents (document, body): (document, level, code, location).

    A row is judged under its id, with the names it declares; a document's own relations add to the vocabulary. States of clauses are not judged here.
    """
    from ledgerline.operators.documents import items, names, vocabulary

    row = F.col("row")
    rows = items(docs.withColumn("vocabulary", vocabulary(F.col("body"), "relation_definitions")), "rows", keep=("vocabulary",)).where(_is_object(row))
    rid = F.nullif(_text(row, "id"), F.lit(""))
    reviews = rows.where(rid.isNotNull()).select(F.concat_ws("\u0001", "document", F.col("pos").cast("string")).alias("review"), rid.alias("location"), F.to_json(row).alias("body"), names(row, "lean_declarations").alias("declarations"), "vocabulary")
    found = validate(reviews, check_status=False)
    return found.select(F.substring_index("review", "\u0001", 1).alias("document"), "level", "code", "location")


def validate(reviews: DataFrame, fragments: DataFrame | None = None, relations: dict[str, tuple[bool, bool]] | None = None, check_status: bool = True) -> DataFrame:
    """(review, level, code, location); fragments are (review, fragment, text); relations add to the vocabulary: name to (needs evidence, needs an excerpt), and so do the names in a column ``vocabulary``."""
    more = relations or {}
    vocabulary = F.concat(F.array(*[F.lit(x) for x in (*RELATIONS, *more)]), F.col("vocabulary"))
    if "vocabulary" not in reviews.columns:
        reviews = reviews.withColumn("vocabulary", F.array().cast("array<string>"))
    evidence = F.array(*[F.lit(x) for x in (*NEED_EVIDENCE, *(k for k, v in more.items() if v[0] and k not in RELATIONS))])
    quoting = F.array(*[F.lit(x) for x in (*NEED_EXCERPT, *(k for k, v in more.items() if v[1] and k not in RELATIONS))])
    words = lambda x: F.array(*[F.lit(w) for w in x])

    v = F.col("v")
    parsed = F.filter(_list(v, "source_fragments"), _is_object)
    clauses = F.when(F.size(_list(v, "clause_map")) > 0, _list(v, "clause_map")).otherwise(_list(v, "clauses"))
    role = lambda f: F.coalesce(F.nullif(_text(f, "role"), F.lit("")), F.lit("primary"))
    rows = reviews.select("review", "location", "vocabulary", F.coalesce("declarations", F.array().cast("array<string>")).alias("registered"), F.try_parse_json("body").alias("v"))
    rows = rows.where(_is_object(v)).withColumns({"fragments": parsed, "clauses": clauses, "reading": _text(v, "source_interpretation"), "rationale": _text(v, "nonlocal_rationale")}).drop("v")
    declared = F.transform("fragments", lambda f: F.struct(_text(f, "id").alias("id"), role(f).alias("role")))
    rows = rows.withColumn("declared", F.filter(declared, lambda f: f["id"] != ""))

    # Fragments.
    locator = lambda f: F.coalesce(F.try_variant_get(f, "$.locator", "string"), F.lit(""))
    at = lambda i: F.concat("location", F.lit(".source_fragments["), i.cast("string"), F.lit("]"))
    of_fragments = _per(
        F.col("fragments"),
        at,
        ("error", "source-fragment-id", lambda f: _text(f, "id") == ""),
        ("error", "source-fragment-locator", lambda f: locator(f).isin("", "{}", "[]", "false", "0")),
        ("error", "source-fragment-role", lambda f: ~role(f).isin(*ROLES)),
    )
    primaries = F.size(F.filter("fragments", lambda f: role(f) == "primary"))
    reading = F.col("reading")
    whole = rows.select(
        "review",
        F.concat(
            of_fragments,
            _rules(
                ("error", "source-fragment-primary", (F.size("fragments") > 0) & (primaries != 1), F.col("location")),
                ("error", "source-interpretation", (reading != "") & ~reading.isin(*READINGS), F.col("location")),
            ),
        ).alias("found"),
    )

    # Clauses.
    c = F.col("clause")
    each = rows.select("review", "location", "vocabulary", "registered", "declared", "reading", "rationale", F.posexplode("clauses").alias("at", "clause")).where(_is_object(c))
    each = each.select(
        "review", "location", "vocabulary", "registered", "declared", "reading", "rationale", "at",
        F.coalesce(F.nullif(_text(c, "status"), F.lit("")), F.lit("claimed_exact")).alias("status"),
        *[_text(c, f).alias(f) for f in ("relation", "kind", "source_fragment", "source_excerpt", "lean_binder")],
        _list(c, "source_targets").alias("source_targets"), _list(c, "lean_targets").alias("lean_targets"),
        _names(c, "lean_declarations").alias("names"), _names(c, "correspondence_declarations").alias("evidence"),
    )
    fragment, excerpt, relation = F.col("source_fragment"), F.col("source_excerpt"), F.col("relation")
    ids = F.transform("declared", lambda f: f["id"])
    each = each.withColumns({
        "loc": F.concat("location", F.lit(".clause_map["), F.col("at").cast("string"), F.lit("]")),
        "ids": ids,
        "inherited": (relation == "inherited_standing_assumption") | F.coalesce(F.try_element_at(F.filter("declared", lambda f: f["id"] == F.col("source_fragment")), F.lit(-1))["role"].isin(*INHERITED_ROLES), F.lit(False)),
    })
    occurs = lambda x: F.when(type_of(x, "occurrence").isNull(), 0).otherwise(F.coalesce(F.try_variant_get(x, "$.occurrence", "int"), F.lit(-1)))
    source = F.transform("source_targets", lambda x: F.struct(_text(x, "kind").alias("kind"), _text(x, "fragment").alias("fragment"), F.coalesce(F.nullif(_text(x, "text"), F.lit("")), _text(x, "excerpt")).alias("text"), occurs(x).alias("occurrence")))
    quoted = F.array(F.struct(F.lit("excerpt").alias("kind"), fragment.alias("fragment"), excerpt.alias("text"), F.lit(0).alias("occurrence")))
    plain = lambda x: F.schema_of_variant(x) == "STRING"
    lean = F.transform("lean_targets", lambda x: F.struct(F.when(plain(x), "binder").otherwise(_text(x, "kind")).alias("kind"), _text(x, "declaration").alias("declaration"), F.when(plain(x), F.trim(F.try_variant_get(x, "$", "string"))).otherwise(_text(x, "name")).alias("name"), _text(x, "constant").alias("constant"), _text(x, "excerpt").alias("excerpt")))
    none = F.lit("")
    bound = F.array(F.struct(F.lit("binder").alias("kind"), none.alias("declaration"), F.col("lean_binder").alias("name"), none.alias("constant"), none.alias("excerpt")))
    empty_s, empty_l = F.array().cast("array<struct<kind:string,fragment:string,text:string,occurrence:int>>"), F.array().cast("array<struct<kind:string,declaration:string,name:string,constant:string,excerpt:string>>")
    each = each.withColumns({"source": F.when(F.size("source_targets") > 0, source).when(excerpt != "", quoted).otherwise(empty_s), "lean": F.when(F.size("lean_targets") > 0, lean).when(F.col("lean_binder") != "", bound).otherwise(empty_l)})
    registered, loc = F.col("registered"), F.col("loc")
    some = F.size(registered) > 0
    place = lambda field: lambda i: F.concat("loc", F.lit(f".{field}["), i.cast("string"), F.lit("]"))
    cites = lambda x: F.coalesce(F.nullif(x["fragment"], F.lit("")), F.nullif(F.col("source_fragment"), F.lit("")))
    known_s, known_l = lambda x: x["kind"].isin(*SOURCE_KINDS), lambda x: x["kind"].isin(*LEAN_KINDS)
    on_clause = _rules(
        ("error", "semantic-clause-status", F.lit(check_status) & ~F.col("status").isin(*STATUSES), loc),
        ("error", "clause-relation", (relation != "") & ~_in(relation, vocabulary), loc),
        ("error", "clause-kind", (F.col("kind") != "") & ~_in(F.col("kind"), words(KINDS)), loc),
        ("error", "clause-fragment", (fragment != "") & ~_in(fragment, F.col("ids")), loc),
        ("error", "clause-excerpt-required", (_in(relation, quoting) | (F.col("status") == "open")) & (excerpt == ""), loc),
        ("warning", "clause-excerpt-fragment", (excerpt != "") & (fragment == "") & (F.size("ids") > 0), loc),
        ("error", "clause-evidence", _in(relation, evidence) & (F.size("evidence") == 0), loc),
    )
    on_source = _per(
        F.col("source"),
        place("source_targets"),
        ("error", "source-target-kind", lambda x: ~known_s(x)),
        ("error", "source-target-fragment", lambda x: known_s(x) & (cites(x).isNull() | ((F.size("ids") > 0) & ~_in(cites(x), F.col("ids"))))),
        ("error", "source-target-text", lambda x: x["kind"].isin("math", "excerpt") & (x["text"] == "")),
        ("error", "source-target-occurrence", lambda x: known_s(x) & (x["occurrence"] < 0)),
    )
    on_lean = _per(
        F.col("lean"),
        place("lean_targets"),
        ("error", "lean-target-kind", lambda x: ~known_l(x)),
        ("error", "lean-target-name", lambda x: (x["kind"] == "binder") & (x["name"] == "")),
        ("error", "lean-target-constant", lambda x: (x["kind"] == "binder_type_dep") & (x["constant"] == "")),
        ("error", "lean-target-excerpt", lambda x: (x["kind"] == "text") & (x["excerpt"] == "")),
        ("error", "lean-target-declaration", lambda x: known_l(x) & (x["declaration"] != "") & some & ~_in(x["declaration"], registered)),
    )
    here = lambda i: F.col("loc")
    on_names = F.concat(
        _per(F.col("names"), here, ("error", "clause-declaration", lambda x: some & ~_in(x, registered))),
        _per(F.col("evidence"), here, ("warning", "clause-evidence-unregistered", lambda x: some & ~_in(x, registered))),
    )
    found = whole.unionByName(each.select("review", F.concat(on_clause, on_source, on_lean, on_names).alias("found")))
    if fragments is not None:
        quotes = each.where((excerpt != "") & (fragment != "")).select("review", fragment.alias("fragment"), excerpt.alias("quote"), loc.alias("loc"))
        missed = quotes.join(fragments.select("review", "fragment", "text"), ["review", "fragment"]).where(~folded(F.col("text")).contains(folded(F.col("quote"))))
        found = found.unionByName(missed.select("review", F.array(_finding("error", "clause-excerpt", F.col("loc"))).cast(FINDING).alias("found")))

    # The reading of the passage, against what the clauses inherit.
    inherits = each.groupBy("review").agg(F.bool_or("inherited").alias("inherits"))
    read = rows.join(inherits, "review", "left").withColumn("inherits", F.coalesce("inherits", F.lit(False)))
    held = F.col("inherits")
    known_reading = reading.isin(*READINGS) | (reading == "")
    on_reading = _rules(
        ("error", "source-interpretation-local", held & (reading == "local"), F.col("location")),
        ("warning", "source-interpretation-missing", held & (reading == ""), F.col("location")),
        ("warning", "source-interpretation-rationale", held & ((reading == "nonlocal") | ~known_reading) & (F.col("rationale") == ""), F.col("location")),
        ("warning", "source-interpretation-nonlocal", ~held & (reading == "nonlocal"), F.col("location")),
    )
    found = found.unionByName(read.select("review", on_reading.alias("found")))
    return found.select("review", F.explode("found").alias("f")).select("review", "f.*")
