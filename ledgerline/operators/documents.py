"""Ledger documents: JSON bodies with their own vocabularies, validated by rules as findings.

A table of documents is (document, body). Rows are kept as variants, so that a field of the
wrong type is a finding and not a parse error. Every validator gives (document, level, code,
location), in one pass over the exploded rows; checks between rows are window functions,
references are anti-joins.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of importance, most important first.
IMPORTANCE = ("headline", "major", "supporting", "technical")
FINDING = "array<struct<level:string,code:string,location:string>>"


def value(row: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(row, f"$.{path}", kind)


def type_of(row: Column, path: str = "") -> Column:
    """The variant type of a field in words; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(row, f"$.{path}" if path else "$", "variant"))


def is_names(row: Column, path: str) -> Column:
    """A list of non-empty strings, or absent."""
    kind = type_of(row, path)
    names = value(row, path, "array<string>")
    return kind.isNull() | kind.isin("ARRAY<VOID>", "ARRAY<>") | ((kind == "ARRAY<STRING>") & ~F.exists(names, lambda x: x.isNull() | (x == "")))


def names(row: Column, *paths: str) -> Column:
    """The list of names in the first of some fields that is present and well-formed; empty otherwise."""
    return F.coalesce(*[F.when(is_names(row, p), value(row, p, "array<string>")) for p in paths], F.array().cast("array<string>"))


def vocabulary(body: Column, field: str) -> Column:
    """The words that a document defines in a mapping; empty where it has none."""
    return F.coalesce(F.json_object_keys(F.get_json_object(body, f"$.{field}")), F.array().cast("array<string>"))


def items(docs: DataFrame, *containers: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(document, pos, row, and the kept columns): the rows of the first container that is a list."""
    listed = F.coalesce(*[F.try_variant_get(F.try_parse_json("body"), f"$.{c}", "array<variant>") for c in containers])
    return docs.select("document", *keep, F.posexplode(listed).alias("pos", "row"))


def _rules(*rules: tuple[str, str, Column, Column]) -> Column:
    """An array of the findings whose condition holds: (level, code, condition, location)."""
    return F.filter(F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), where.alias("location"))) for level, code, cond, where in rules]).cast(FINDING), lambda f: f.isNotNull())


def _each(references: Column, known: Column, code: str, where: Column) -> Column:
    """A finding for every reference that isn't known."""
    return F.transform(F.filter(references, lambda r: ~F.array_contains(known, r)), lambda r: F.struct(F.lit("error").alias("level"), F.lit(code).alias("code"), where.alias("location"))).cast(FINDING)


def _out(rows: DataFrame, *findings: Column) -> DataFrame:
    return rows.select("document", F.explode(F.concat(*findings)).alias("f")).select("document", "f.*")


def _containers(docs: DataFrame, code: str, *containers: str) -> DataFrame:
    """A finding for a document without rows: an error, or a warning where an empty one is a draft."""
    body = F.try_parse_json("body")
    size = F.size(F.coalesce(*[F.try_variant_get(body, f"$.{c}", "array<variant>") for c in containers]))
    draft = F.coalesce(F.try_variant_get(body, "$.draft", "boolean"), F.lit(False))
    level = F.when((size == 0) & draft, "warning").otherwise("error")
    return docs.withColumn("n", size).where(F.col("n").isNull() | (F.col("n") <= 0)).select("document", level.alias("level"), F.lit(code).alias("code"), F.lit("").alias("location"))


def _located(rows: DataFrame, container: str, unnamed: str | None = None) -> DataFrame:
    """Adds id (null unless a non-empty string), spot, nth (the how-manyth row of its id), and loc: the id, else ``unnamed`` and the row's number, else the spot."""
    rid = F.when((type_of(F.col("row"), "id") == "STRING") & (F.trim(value(F.col("row"), "id")) != ""), value(F.col("row"), "id"))
    rows = rows.withColumn("id", rid).withColumn("spot", F.concat(F.lit(f"{container}["), F.col("pos").cast("string"), F.lit("]"))).withColumn("loc", F.coalesce("id", F.concat(F.lit(unnamed), F.col("pos").cast("string")) if unnamed else "spot"))
    return rows.withColumn("nth", F.when(F.col("id").isNotNull(), F.row_number().over(Window.partitionBy("document", "id").orderBy("pos"))))


def validate_census(docs: DataFrame) -> DataFrame:
    """Rules of a census: shape, ids, vocabularies, contradictions, references, and gaps or blockers that nothing refers to."""
    fields = ("status_definitions", "verification_definitions", "importance_definitions", "semantic_alignment_definitions", "completion_certification_definitions", "gaps", "blockers")
    docs = docs.withColumns({f: vocabulary(F.col("body"), f) for f in fields})
    rows = _located(items(docs, "items", keep=fields), "items", "#")
    row, loc = F.col("row"), F.col("loc")
    is_object = type_of(row).startswith("OBJECT")
    status, verification, importance = (value(row, x) for x in ("status", "verification", "importance"))
    known = F.when(F.size("importance_definitions") > 0, F.col("importance_definitions")).otherwise(F.array(*[F.lit(x) for x in IMPORTANCE]))
    cited = F.size(names(row, "lean_declarations"))
    alignment, cls = type_of(row, "semantic_alignment"), value(row, "semantic_alignment.classification")
    unknown = lambda x, field: (F.size(field) > 0) & ~F.coalesce(F.array_contains(field, x), F.lit(False))
    absent = F.coalesce(verification == "absent", F.lit(False))
    checks = _rules(
        ("error", "id", F.col("id").isNull(), F.col("spot")),
        ("error", "duplicate-id", F.col("nth") > 1, F.col("spot")),
        ("error", "title", type_of(row, "title").isNotNull() & ((type_of(row, "title") != "STRING") | (F.trim(value(row, "title")) == "")), loc),
        ("error", "status", unknown(status, "status_definitions"), loc),
        ("error", "verification", unknown(verification, "verification_definitions"), loc),
        ("error", "importance", importance.isNotNull() & ~F.array_contains(known, importance), loc),
        ("error", "lean-declarations", ~is_names(row, "lean_declarations"), loc),
        ("error", "planned-declarations", ~is_names(row, "planned_declarations") & (type_of(row, "planned_declarations") != "VOID"), loc),
        ("error", "verification-citations", absent & (cited > 0), loc),
        ("error", "verification-citations", (verification == "proved_in_build") & (cited == 0), loc),
        ("error", "compiled-absent", status.startswith("compiled") & absent, loc),
        ("error", "semantic-alignment", alignment.isNotNull() & (alignment != "VOID") & ~alignment.startswith("OBJECT"), loc),
        ("error", "semantic-classification", alignment.startswith("OBJECT") & unknown(cls, "semantic_alignment_definitions"), loc),
        ("error", "semantic-detail", alignment.startswith("OBJECT") & (cls != "") & (F.trim(F.coalesce(value(row, "semantic_alignment.detail"), F.lit(""))) == ""), loc),
        ("error", "completion-certification", value(row, "completion_certification").isNotNull() & unknown(value(row, "completion_certification"), "completion_certification_definitions"), loc),
    )
    gaps, blockers = names(row, "gap_refs"), names(row, "blocked_by")
    wrong = F.array(F.struct(F.lit("error").alias("level"), F.lit("row-type").alias("code"), F.col("spot").alias("location"))).cast(FINDING)
    found = _out(rows, F.when(is_object, F.concat(checks, _each(gaps, F.col("gaps"), "gap-ref", loc), _each(blockers, F.col("blockers"), "blocker-ref", loc))).otherwise(wrong))
    out = _containers(docs, "items", "items").unionByName(found)
    filled = docs.join(rows.select("document").distinct(), "document", "left_semi")
    for field, refs, code in (("gaps", gaps, "orphan-gap"), ("blockers", blockers, "orphan-blocker")):
        used = rows.select("document", F.explode(refs).alias("word")).distinct()
        orphan = filled.select("document", F.explode(field).alias("word")).join(used, ["document", "word"], "left_anti")
        out = out.unionByName(orphan.select("document", F.lit("warning").alias("level"), F.lit(code).alias("code"), F.col("word").alias("location")))
    return out


def validate_atoms(docs: DataFrame) -> DataFrame:
    """Rules of an atom inventory: ids, source order, references."""
    rows = _located(items(docs, "atoms"), "atoms")
    row, loc = F.col("row"), F.col("loc")
    order, kind = value(row, "order", "bigint"), type_of(row, "order")
    rows = rows.withColumn("order", F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & (order >= 1), order))
    before = Window.partitionBy("document").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"previous": F.last("order", ignorenulls=True).over(before), "same": F.when(F.col("order").isNotNull(), F.row_number().over(Window.partitionBy("document", "order").orderBy("pos")))})
    refs = names(row, "formalization_result_ids")
    support = type_of(row, "interpretation_support")
    checks = _rules(
        ("error", "atom-id", F.col("id").isNull(), F.col("spot")),
        ("error", "duplicate-atom-id", F.col("nth") > 1, F.col("spot")),
        ("error", "atom-order", kind.isNotNull() & (kind != "VOID") & F.col("order").isNull(), loc),
        ("error", "duplicate-atom-order", F.col("same") > 1, loc),
        ("warning", "atom-order-list", F.col("order") < F.col("previous"), loc),
        ("error", "atom-result-refs", ~is_names(row, "formalization_result_ids"), loc),
        ("error", "atom-result-refs", F.size(refs) != F.size(F.array_distinct(refs)), loc),
        ("error", "interpretation-support", support.isNotNull() & (support != "VOID") & ~support.startswith("OBJECT"), loc),
        ("error", "interpretation-support", support.startswith("OBJECT") & ~is_names(row, "interpretation_support.result_ids"), loc),
    )
    wrong = F.array(F.struct(F.lit("error").alias("level"), F.lit("atom-type").alias("code"), F.col("spot").alias("location"))).cast(FINDING)
    return _containers(docs, "atoms", "atoms").withColumn("level", F.lit("error")).unionByName(_out(rows, F.when(type_of(row).startswith("OBJECT"), checks).otherwise(wrong)))


def validate_results(docs: DataFrame) -> DataFrame:
    """Rules of a result inventory: declared count, ids, atoms, declarations, and what a completion obligation needs."""
    rows = _located(items(docs, "results", "items"), "results")
    row, loc = F.col("row"), F.col("loc")
    has = lambda *fs: F.max(F.coalesce(*[type_of(row, f) for f in fs]).isNotNull()).over(Window.partitionBy("document"))
    rows = rows.withColumns({"some_disposition": has("disposition", "status"), "some_verification": has("verification"), "some_semantic": has("semantic_certification")})
    atoms = names(row, "source_atom_ids", "source_fidelity_atom_ids")
    listed = F.when(type_of(row, "source_atom_ids").isNotNull(), is_names(row, "source_atom_ids")).otherwise(is_names(row, "source_fidelity_atom_ids"))
    cited = F.when(type_of(row, "lean_declarations").isNotNull(), is_names(row, "lean_declarations")).otherwise(is_names(row, "review_declarations"))
    owed = F.coalesce(value(row, "completion_obligation", "boolean"), F.lit(True))
    blank = lambda *fs: F.trim(F.coalesce(*[value(row, f) for f in fs], F.lit(""))) == ""
    checks = _rules(
        ("error", "result-id", F.col("id").isNull(), F.col("spot")),
        ("error", "duplicate-result-id", F.col("nth") > 1, F.col("spot")),
        ("error", "source-atom-ids", ~listed | (F.size(atoms) == 0), loc),
        ("error", "source-atom-ids", F.size(atoms) != F.size(F.array_distinct(atoms)), loc),
        ("error", "result-declarations", ~cited, loc),
        ("error", "result-disposition", owed & F.col("some_disposition") & blank("disposition", "status"), loc),
        ("error", "result-verification", owed & F.col("some_verification") & blank("verification"), loc),
        ("error", "result-semantic", owed & F.col("some_semantic") & blank("semantic_certification"), loc),
    )
    wrong = F.array(F.struct(F.lit("error").alias("level"), F.lit("result-type").alias("code"), F.col("spot").alias("location"))).cast(FINDING)
    told = docs.select("document", F.try_variant_get(F.try_parse_json("body"), "$.result_count", "bigint").alias("told"))
    counted = rows.groupBy("document").agg(F.count(F.lit(1)).alias("n")).join(told, "document").where("told <> n")
    count = counted.select("document", F.lit("error").alias("level"), F.lit("result-count").alias("code"), F.lit("").alias("location"))
    return _containers(docs, "results", "results", "items").withColumn("level", F.lit("error")).unionByName(count).unionByName(_out(rows, F.when(type_of(row).startswith("OBJECT"), checks).otherwise(wrong)))


def validate_coverage(results: DataFrame, atoms: DataFrame, link: DataFrame) -> DataFrame:
    """Both inventories' rules, and references either way between linked ones (link: document, atoms)."""
    r = _located(items(results, "results", "items"), "results").join(link, "document")
    a = _located(items(atoms, "atoms"), "atoms").withColumnRenamed("document", "atoms").join(link, "atoms")
    row = F.col("row")
    wanted = r.select("document", "loc", F.explode(names(row, "source_atom_ids", "source_fidelity_atom_ids")).alias("id"))
    no_atom = wanted.join(a.select("document", "id").where("id is not null").distinct(), ["document", "id"], "left_anti")
    backs = F.concat(names(row, "formalization_result_ids"), names(row, "interpretation_support.result_ids"))
    no_result = a.select("document", "loc", F.explode(backs).alias("id")).join(r.select("document", "id").where("id is not null").distinct(), ["document", "id"], "left_anti")
    finding = lambda d, code: d.select("document", F.lit("error").alias("level"), F.lit(code).alias("code"), F.col("loc").alias("location"))
    return validate_results(results).unionByName(validate_atoms(atoms)).unionByName(finding(no_atom, "result-atom-missing")).unionByName(finding(no_result, "atom-result-missing"))


def validate_review(docs: DataFrame) -> DataFrame:
    """Rules of a semantic review: ids, declarations, clauses and their relations. A clause keeps its place in the list, whatever stands before it."""
    docs = docs.withColumn("relation_definitions", vocabulary(F.col("body"), "relation_definitions"))
    rows = _located(items(docs, "rows", keep=("relation_definitions",)), "rows")
    row, loc = F.col("row"), F.col("loc")
    is_object = type_of(row).startswith("OBJECT")
    empty = lambda f: type_of(row, f).isNotNull() & (F.trim(F.coalesce(value(row, f), F.lit(""))) == "")
    clauses = F.coalesce(F.try_variant_get(row, "$.clauses", "array<variant>"), F.array().cast("array<variant>"))
    checks = _rules(
        ("error", "id", F.col("id").isNull(), F.col("spot")),
        ("error", "duplicate-id", F.col("nth") > 1, loc),
        ("error", "source_anchor", F.col("id").isNotNull() & empty("source_anchor"), loc),
        ("error", "title", F.col("id").isNotNull() & empty("title"), loc),
        ("error", "lean-declarations", F.col("id").isNotNull() & ~is_names(row, "lean_declarations"), loc),
        ("error", "clauses", F.col("id").isNotNull() & type_of(row, "clauses").isNotNull() & ~type_of(row, "clauses").startswith("ARRAY"), loc),
    )
    wrong = F.array(F.struct(F.lit("error").alias("level"), F.lit("row-type").alias("code"), F.col("spot").alias("location"))).cast(FINDING)
    found = _out(rows, F.when(is_object, checks).otherwise(wrong))
    each = rows.where(is_object & F.col("id").isNotNull()).select("document", "id", "relation_definitions", F.posexplode(clauses).alias("at", "clause"))
    clause, spot = F.col("clause"), F.concat("id", F.lit(".clauses["), F.col("at").cast("string"), F.lit("]"))
    missing = lambda f: ~F.coalesce((type_of(clause, f) == "STRING") & (F.trim(value(clause, f)) != ""), F.lit(False))
    stray = (F.size("relation_definitions") > 0) & ~F.coalesce(F.array_contains("relation_definitions", value(clause, "relation")), F.lit(False))
    of_clause = _rules(*[("error", f"clause-{f}", missing(f), spot) for f in ("source_clause", "lean_clause", "relation")], ("error", "relation", stray, spot))
    bad = F.array(F.struct(F.lit("error").alias("level"), F.lit("clause-type").alias("code"), spot.alias("location"))).cast(FINDING)
    return _containers(docs, "rows", "rows").unionByName(found).unionByName(_out(each, F.when(type_of(clause).startswith("OBJECT"), of_clause).otherwise(bad)))


def against_companion(review: DataFrame, census: DataFrame, link: DataFrame) -> DataFrame:
    """Findings between a review and the census it stands beside (link: document, census): rows on one side only, other locators, other declarations.

    A review row that doesn't speak of a locator or of declarations isn't compared in it; lists are compared as they stand, in
    order. A census that is not there, is no JSON, or has no list of items is a finding of its own.
    """
    row = F.col("row")
    told = lambda f: F.nullif(F.to_json(F.try_variant_get(row, f"$.{f}", "variant")), F.lit("null"))
    side = lambda d, c, p: _located(items(d, c), c).where("id is not null").select("document", "id", F.lit(True).alias(f"{p}_row"), *[x for f in ("source_locator", "lean_declarations") for x in (told(f).alias(f"{p}_{f}"), type_of(row, f).isNotNull().alias(f"{p}_has_{f}"))])
    there = link.join(census.select(F.col("document").alias("census"), "body", F.lit(True).alias("found")), "census", "left")
    parsed = F.try_parse_json("body")
    listed = F.try_variant_get(parsed, "$.items", "array<variant>").isNotNull()
    fault = F.when(F.col("found").isNull(), "companion-missing").when(parsed.isNull(), "companion-unreadable").when(~listed, "companion-items")
    there = there.select("document", "census", fault.alias("fault"))
    faults = there.where("fault is not null").select("document", F.lit("error").alias("level"), F.col("fault").alias("code"), F.lit("").alias("location"))
    sound = there.where("fault is null").select("document", "census")
    r = side(review, "rows", "r").join(sound.select("document"), "document", "left_semi")
    c = side(census, "items", "c").withColumnRenamed("document", "census").join(sound, "census").drop("census").dropDuplicates(["document", "id"])
    both = r.join(c, ["document", "id"], "full_outer")
    differs = lambda f: F.col("c_row") & F.col(f"r_has_{f}") & ~F.col(f"r_{f}").eqNullSafe(F.col(f"c_{f}"))
    checks = _rules(
        ("error", "companion-row", F.col("c_row").isNull(), F.col("id")),
        ("error", "companion-unreviewed", F.col("r_row").isNull(), F.col("id")),
        ("error", "companion-locator", differs("source_locator"), F.col("id")),
        ("error", "companion-declarations", differs("lean_declarations"), F.col("id")),
    )
    return faults.unionByName(_out(both, checks))


def cited_findings(cited: DataFrame, decls: DataFrame, planned: DataFrame) -> DataFrame:
    """(level, code, row, name): cited names (row, name) that no source declares (missing), or that are another's short name (not exact); planned names that exist."""
    full = decls.select("name").distinct()
    short = decls.select(F.col("short_name").alias("last")).distinct()
    unmet = cited.join(full, "name", "left_anti").withColumn("last", F.element_at(F.split("name", r"\."), -1))
    loose = unmet.join(short, "last", "left_semi").select(F.lit("warning").alias("level"), F.lit("declaration-not-exact").alias("code"), "row", "name")
    gone = unmet.join(short, "last", "left_anti").select(F.lit("error").alias("level"), F.lit("declaration-missing").alias("code"), "row", "name")
    early = planned.join(full, "name", "left_semi").select(F.lit("error").alias("level"), F.lit("planned-now-exists").alias("code"), "row", "name")
    return loose.unionByName(gone).unionByName(early)


def census_summary(docs: DataFrame) -> DataFrame:
    """(document, field, value, n): histograms of status, verification, importance and alignment, counts of items and distinct cited names, names cited more than once."""
    rows = items(docs, "items")
    row = F.col("row")
    fields = {"status": "status", "verification": "verification", "importance": "importance", "semantic_alignment": "semantic_alignment.classification"}
    told = lambda field, value, n: F.struct(F.lit(field).alias("field"), value.alias("value"), n.alias("n"))
    pair = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    cites = F.transform(names(row, "lean_declarations"), lambda x: pair("cited", x))
    pairs = F.concat(F.array(*[pair(k, value(row, p)) for k, p in fields.items()], pair("items", F.lit(""))), cites)
    # One pass: documents are read, parsed and counted once, and what is cited is told apart among the counts.
    counts = rows.select("document", F.inline(pairs)).where("value is not null").groupBy("document", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    unique = told("unique_lean_declarations", F.lit(""), F.lit(1).cast("long"))
    of_name = F.when(F.col("n") > 1, F.array(told("reused", F.col("value"), F.col("n")), unique)).otherwise(F.array(unique))
    found = F.when(F.col("field") == "cited", of_name).otherwise(F.array(F.struct("field", "value", "n")))
    return counts.select("document", F.inline(found)).groupBy("document", "field", "value").agg(F.sum("n").alias("n"))


# -- one document on the driver: paths, scalars, edits ----------------------------------------------


class PathError(ValueError):
    """A field path that a document doesn't have, or can't take."""


def path_parts(path: str) -> list[str | int]:
    """``a.b[0].c`` and ``a.b.0.c`` alike: names and list places."""
    parts = [p for piece in path.replace("[", ".").replace("]", "").split(".") if (p := piece.strip())]
    if not parts:
        raise PathError(f"empty field path: {path!r}")
    return [int(p) if p.isdigit() else p for p in parts]


def dotted_get(data: Any, path: str) -> Any:
    for part in path_parts(path):
        try:
            data = data[part]
        except (KeyError, IndexError, TypeError) as error:
            raise PathError(f"no such field: {path}") from error
    return data


def _slot(holder: Any, part: str | int, path: str) -> None:
    """Makes sure that ``holder`` can take ``part``, lengthening a list with nulls."""
    if isinstance(part, int) != isinstance(holder, list) or not isinstance(holder, (list, dict)):
        raise PathError(f"can't go along field path {path!r}")
    if isinstance(part, int):
        holder.extend([None] * (part + 1 - len(holder)))


def dotted_set(data: Any, path: str, value: Any, create: bool = True) -> None:
    """Sets a field; containers on the way that are missing or null are made, lists for numbers and mappings for names."""
    *way, last = path_parts(path)
    for part, after in zip(way, [*way, last][1:], strict=True):
        if not create:
            dotted_get(data, str(part))
        _slot(data, part, path)
        if (data[part] if isinstance(part, int) else data.get(part)) is None:
            if not create:
                raise PathError(f"no such field: {path}")
            data[part] = [] if isinstance(after, int) else {}
        data = data[part]
    if isinstance(last, int) and not create and isinstance(data, list) and last >= len(data):
        raise PathError(f"no such field: {path}")
    _slot(data, last, path)
    data[last] = value


def dotted_delete(data: Any, path: str) -> None:
    *way, last = path_parts(path)
    holder = dotted_get(data, ".".join(str(p) for p in way)) if way else data
    try:
        del holder[last]
    except (KeyError, IndexError, TypeError) as error:
        raise PathError(f"no such field: {path}") from error


def parse_scalar(text: str, force_json: bool = False) -> Any:
    """true, false, null and what looks like a JSON list, mapping or string; anything else, numbers too, stays text."""
    if force_json:
        return json.loads(text)
    words = {"true": True, "false": False, "null": None}
    if text.lower() in words:
        return words[text.lower()]
    if text[:1] in ("[", "{", '"'):
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return text
    return text


def patch_item(document: dict, row_id: str, sets: list[tuple[str, Any]], deletes: tuple[str, ...] = ()) -> None:
    """Sets and deletes fields of the one row with an id."""
    rows = [r for r in document.get("items", []) if isinstance(r, dict) and r.get("id") == row_id]
    if not rows:
        raise PathError(f"no row {row_id!r}")
    for path, new in sets:
        dotted_set(rows[0], path, new)
    for path in deletes:
        dotted_delete(rows[0], path)


def append_item(document: dict, row: dict) -> None:
    """Adds a row with an id of its own; the document is a draft no longer."""
    rid = row.get("id")
    if not isinstance(rid, str) or not rid:
        raise PathError("a new row needs an id")
    if any(r.get("id") == rid for r in document.setdefault("items", [])):
        raise PathError(f"row {rid!r} is there already")
    document["items"].append(dict(row))
    if document.get("draft") is True:
        document["draft"] = False
