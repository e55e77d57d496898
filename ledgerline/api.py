"""One function per command: the operators put together as a user calls them.

A ``Project`` holds the tables that a command reads: declarations, statement records,
scanned sources, ledgers (document, body), commits, journal. Every function returns a
DataFrame, ordered where the order is part of the answer; ``edits`` change one document.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.functions.text import prose, without_control
from ledgerline.operators import correspondence, documents, graph, headlines, ledgers, logs, modules, names, policies, sources, statements, textaudit
from ledgerline.sources import loaders

ITEMS = {"census": ("items",), "review": ("rows",), "results": ("results", "items"), "atoms": ("atoms",), "literature": ("works",)}


@dataclass
class Project:
    """The tables of a project; what a command doesn't need may stay None."""

    spark: SparkSession
    decls: DataFrame | None = None
    records: DataFrame | None = None
    files: DataFrame | None = None
    censuses: DataFrame | None = None
    reviews: DataFrame | None = None
    results: DataFrame | None = None
    atoms: DataFrame | None = None
    literature: DataFrame | None = None
    commits: DataFrame | None = None
    journal: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, **paths: str) -> Project:
        """Tables from files: decls and records as JSON lines, sources as a folder, ledgers as JSON documents, log and journal."""
        read = {"decls": loaders.declarations, "records": loaders.statements, "files": lambda s, p: source_files(s, p), "commits": loaders.history, "journal": loaders.journal}
        ledger = lambda s, p: s.read.text(p, wholetext=True).select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("body"))
        return cls(spark, **{k: read.get(k, ledger)(spark, p) for k, p in paths.items()})

    @cached_property
    def scanned(self) -> DataFrame:
        """All sources, scanned once."""
        return materialise(sources.scan_files(self.files), "scanned")

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(edges, unresolved) of the declarations."""
        return environment_graph(self.decls)

    def ledger(self, kind: str) -> DataFrame:
        return {"census": self.censuses, "review": self.reviews, "results": self.results, "atoms": self.atoms, "literature": self.literature}[kind]


def source_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = (".lake", ".git", "build")) -> DataFrame:
    """(path, module, text) of the source files below a folder; folders of the excluded names are left out at any depth."""
    raw = loaders.text_files(spark, root, "*.lean")
    base = F.regexp_replace("path", "^[a-z]+:/*", "/")
    inner = F.expr(f"substring({'`base`'}, length('{root.rstrip('/')}') + 2)")
    rows = raw.withColumn("base", base).withColumn("path", inner).where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))
    return rows.select("path", F.replace(F.regexp_replace("path", r"\.lean$", ""), F.lit("/"), F.lit(".")).alias("module"), "text")


# -- declarations and graphs ----------------------------------------------------------------------


def environment_graph(decls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) from dependency to consumer, self loops dropped, and what doesn't resolve (consumer, dependency)."""
    refs = decls.select(F.col("name").alias("consumer"), F.explode(F.array_distinct("deps")).alias("reference"))
    found = materialise(names.resolve(refs, decls), "resolved")
    edges = found.where("resolved is not null and resolved <> consumer").select(F.col("resolved").alias("src"), F.col("consumer").alias("dst")).distinct()
    return materialise(edges, "edges"), found.where("resolved is null").select("consumer", F.col("reference").alias("dependency"))


def query(p: Project, kind=None, sorried=None, prop_valued=None, is_prop=None, module=None, name=None, axiom=None, uses=None) -> DataFrame:
    """Declarations that meet all conditions: kind and flags equal (null never is), module and name hold a text, some axiom holds a text, some dependency is a name or ends with it."""
    rows = p.decls
    for field, wanted in (("kind", kind), ("sorried", sorried), ("prop_valued", prop_valued), ("is_prop", is_prop)):
        if wanted is not None:
            rows = rows.where(F.col(field) == wanted)
    for field, part in (("module", module), ("name", name)):
        if part is not None:
            rows = rows.where(F.col(field).contains(part))
    if axiom is not None:
        rows = rows.where(F.exists("axioms", lambda a: a.contains(axiom)))
    if uses is not None:
        rows = rows.where(F.exists("deps", lambda d: (d == uses) | (names.short_name(d) == uses)))
    return rows.orderBy("module", "name")


def stubs(p: Project, **conditions) -> DataFrame:
    return query(p, sorried=True, **conditions)


def stats(p: Project, depth: int = 2) -> DataFrame:
    """Per module prefix: definitions, theorems, stubs, stubs of propositions; prefixes with neither kind are listed as well."""
    open_ = F.coalesce("sorried", F.lit(False))
    return p.decls.groupBy(names.module_prefix(F.col("module"), depth).alias("prefix")).agg(F.count_if(F.col("kind") == "def").alias("defs"), F.count_if(F.col("kind") == "theorem").alias("theorems"), F.count_if(open_).alias("stubs"), F.count_if(open_ & F.coalesce("is_prop", F.lit(False))).alias("prop_stubs")).orderBy("prefix")


def deps(p: Project, name: str, library: str = "", depth: int | None = None) -> DataFrame:
    """(name, module, distance): what a declaration depends on; every hop is resolved by full, else by first short name; ``library`` is a raw prefix of modules."""
    known = p.decls.withColumn("pos", F.monotonically_increasing_id())
    loose = materialise(sources.by_name(known.select("name", "pos")), "by-name")
    step = p.decls.select(F.col("name").alias("src"), F.explode("deps").alias("key")).join(loose, "key").select("src", F.col("name").alias("dst"))
    kept = p.decls.where(F.col("module").startswith(library)).select(F.col("name").alias("dst"))
    start = loose.where(F.col("key") == name).select(F.col("name").alias("node"))
    reached = graph.walk(step.join(kept, "dst", "left_semi").select("src", "dst"), start, depth).where("distance > 0")
    return reached.join(p.decls.select(F.col("name").alias("node"), "module"), "node").select(F.col("node").alias("name"), "module", "distance").orderBy("module", "name")


def rdeps(p: Project, name: str) -> DataFrame:
    return query(p, uses=name)


def axioms(p: Project, name: str) -> DataFrame:
    """(declaration, axiom): the axioms of the declarations of that name, or of that short name; null where they weren't indexed."""
    rows = p.decls.where((F.col("name") == name) | (names.short_name(F.col("name")) == name))
    return rows.select(F.col("name").alias("declaration"), F.explode_outer("axioms").alias("axiom")).orderBy("declaration", "axiom")


def libs(p: Project) -> DataFrame:
    return p.decls.groupBy("library").agg(F.count(F.lit(1)).alias("declarations"), F.count_distinct("module").alias("modules")).orderBy("library")


def promotions(p: Project, tags: list[str], consumer_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(node, role, consumers) by exact names only: tagged declarations that untagged ones use, and what stands below them."""
    exact = p.decls.select(F.col("name").alias("dst"), F.explode("deps").alias("src")).join(p.decls.select(F.col("name").alias("src")), "src", "left_semi").where("src <> dst").distinct()
    return headlines.promotion(exact, p.decls.where(names.tagged(F.col("module"), tags)).select(F.col("name").alias("node")), consumer_prefixes)


def promotion_counts(p: Project, tags: list[str], consumer_prefixes: tuple[str, ...] = ()) -> DataFrame:
    kinds = p.decls.select(F.col("name").alias("node"), "kind")
    return promotions(p, tags, consumer_prefixes).join(kinds, "node").groupBy("kind", "role").agg(F.count(F.lit(1)).alias("n"))


def graph_index(p: Project) -> dict[str, DataFrame]:
    """The whole graph as a bundle of tables: ordered nodes and edges, unresolved names, their first components' histogram, components of two nodes or more."""
    edges, unresolved = p.graph
    prefix = unresolved.groupBy(F.substring_index("dependency", ".", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy("prefix")
    return {"nodes": p.decls.orderBy("module", "name"), "edges": edges.orderBy("src", "dst"), "unresolved": unresolved, "unresolved_prefixes": prefix, "components": graph.components(edges)}


def graph_slice(p: Project, targets: list[str], reduce: bool = False) -> dict[str, DataFrame]:
    """The ancestors of some declarations, all edges into them, and what of theirs doesn't resolve; with ``reduce`` the transitive reduction too."""
    edges, unresolved = p.graph
    chosen = p.spark.createDataFrame([(names.resolve_one(p.decls, t),) for t in targets], "node string")
    kept = materialise(graph.closure(edges, chosen), "slice")
    inner = materialise(graph.induced(edges, kept), "slice-edges")
    out = {"nodes": kept.orderBy("node"), "edges": inner.orderBy("src", "dst"), "unresolved": unresolved.join(kept.select(F.col("node").alias("consumer")), "consumer", "left_semi")}
    return out | ({"reduced": graph.transitive_reduction(inner).orderBy("src", "dst")} if reduce else {})


def graph_headlines(p: Project, claims: DataFrame) -> dict[str, DataFrame]:
    """Dependency analysis of claims (id, declaration): coverage, frontier, per-claim figures, nearest common dependencies, layers, libraries, leaves."""
    edges, _ = p.graph
    walked = headlines.dependency_walk(edges, claims)
    covered = materialise(headlines.coverage(walked), "covered")
    inner = materialise(graph.induced(edges, covered), "headline-edges")
    component = graph.components(inner)
    depth = graph.layers(graph.condense(inner, component))
    member = covered.select("node").join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    layer = member.join(depth.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))
    return {
        "nodes": covered.join(layer, "node"), "edges": inner, "frontier": headlines.shared_frontier(edges, covered), "claims": headlines.headline_stats(walked, covered), "pairs": headlines.headline_pairs(walked),
        "libraries": headlines.library_counts(walked, p.decls), "leaves": covered.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti"),
    }


def explorer(p: Project, foundations: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole graph annotated: degrees and foundation labels by node, cluster figures by library and module, external dependencies with their consumers."""
    edges, unresolved = p.graph
    ends = edges.select(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    degree = ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    nodes = p.decls.select("name", "module", "library", "kind").join(degree, "name", "left").na.fill(0, ["in_degree", "out_degree"])
    if foundations is not None:
        nodes = nodes.join(foundation_labels(p.decls.select("module").distinct(), foundations), "module", "left")
    known = headlines.cluster_stats(edges, p.decls, "library"), headlines.cluster_stats(edges, p.decls, "module")
    return {"nodes": nodes, "libraries": known[0], "modules": known[1], "boundary": unresolved.groupBy(F.col("dependency").alias("name")).agg(F.count_distinct("consumer").alias("consumers"))}


def foundation_labels(modules_: DataFrame, foundations: DataFrame) -> DataFrame:
    """(module, theory_id): the label of the longest dotted prefix that has one."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.concat_ws(".", F.slice(parts, 1, d)).alias("prefix")))
    return modules_.select("module", F.explode(prefixes).alias("x")).select("module", "x.*").join(foundations.withColumnRenamed("module", "prefix"), "prefix").groupBy("module").agg(F.max_by("theory_id", "depth").alias("theory_id"))


def presentation(p: Project, wanted: list[str], strict: bool = False) -> dict[str, DataFrame]:
    """A curated view: the wanted declarations, and the reduced reachability among them with its distances; unknown ones are listed, or an error."""
    asked = p.spark.createDataFrame([(w,) for w in wanted], "query string")
    found = materialise(names.resolve_cited(asked, p.decls), "presentation")
    missing = found.where("resolved is null").select("query")
    if strict and not missing.isEmpty():
        raise names.UnresolvedError(f"unknown: {', '.join(sorted(r.query for r in missing.collect()))}")
    keep = found.where("resolved is not null").select(F.col("resolved").alias("node")).distinct()
    return {"nodes": keep, "edges": graph.projected_reduction(p.graph[0], keep), "missing": missing}


def statement(p: Project, seeds: list[str]) -> dict[str, DataFrame]:
    """Closure payload of some statements: their records, typed edges, and what each seed reaches, by part."""
    edges, parts = None, None
    for seed in seeds:
        e = statements.closure_edges(p.records, seed).withColumn("seed", F.lit(seed))
        s = statements.closure_summary(p.records, seed).withColumn("seed", F.lit(seed))
        edges, parts = (e, s) if edges is None else (edges.unionByName(e), parts.unionByName(s))
    edges = materialise(edges, "payload")
    reached = edges.select(F.col("dst").alias("name")).unionByName(edges.select("seed").withColumnRenamed("seed", "name")).distinct()
    return {"records": p.records.join(reached, "name", "left_semi").orderBy("name"), "edges": edges.select("src", "dst", "role").distinct().orderBy("src", "dst", "role"), "summaries": parts.orderBy("seed", "part", "name")}


def proof(p: Project, name: str) -> dict[str, DataFrame]:
    """What a proof rests on: its closure by library and by module, direct dependencies with their role, how many don't resolve."""
    edges, unresolved = p.graph
    one = p.spark.createDataFrame([(name,)], "node string")
    closed = materialise(graph.closure(edges, one).where("distance > 0").join(p.decls.select(F.col("name").alias("node"), "library", "module"), "node"), "proof")
    own = p.decls.where(F.col("name") == name)
    direct = own.select(F.explode("deps").alias("dependency"), "type_deps").select("dependency", statements.dependency_role(F.col("dependency")).alias("role"))
    return {"libraries": closed.groupBy("library").count(), "modules": closed.groupBy("module").count(), "direct": direct, "unresolved": unresolved.where(F.col("consumer") == name)}


def coverage_of(spans: DataFrame, by: str) -> DataFrame:
    return spans.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by)


# -- sources --------------------------------------------------------------------------------------


def source_scan(p: Project) -> DataFrame:
    return sources.audit_summary(p.scanned)


def source_duplicates(p: Project, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), baseline: DataFrame | None = None) -> DataFrame:
    """Names that several modules of the scope declare; against a baseline (key) as new, accepted and stale."""
    decls = sources.declarations(p.scanned).where(sources.in_scope(F.col("module"), include, exclude))
    found = sources.duplicate_public_names(decls)
    return found.orderBy("name") if baseline is None else ledgers.baseline(found.select(F.col("name").alias("key")), baseline)


def source_admissions(p: Project) -> DataFrame:
    return sources.admission_report(p.scanned).orderBy("module")


def source_docstrings(p: Project, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    return sources.undocumented_public(sources.declarations(p.scanned), include, exclude).select("module", "name", "kind", "line").orderBy("module", "line")


def source_snapshot(p: Project) -> DataFrame:
    return sources.snapshot(sources.declarations(p.scanned)).orderBy("name", "module", "line")


def source_drift(p: Project, old: DataFrame) -> dict[str, DataFrame]:
    new = source_snapshot(p)
    return {"changes": ledgers.drift(old, new.select("name", "module")).orderBy("name"), "rename_hints": sources.rename_hints(old, new).orderBy("was", "now")}


def source_conflicts(p: Project) -> DataFrame:
    """Lines that are merge markers: seven equal signs, or seven angle brackets or bars and a blank."""
    return textaudit.marked_lines(p.files, r"^(?:<{7} |>{7} |\|{7} |={7}$)").orderBy("path", "line_no")


def source_declaration(p: Project, name: str) -> DataFrame:
    """The statements of the declarations of a qualified name, or of a short one where there is none."""
    decls = sources.declarations(p.scanned)
    asked = p.spark.createDataFrame([(name,)], "query string")
    hit = sources.resolve(decls, asked).select("name", "module").distinct()
    return decls.join(hit, ["name", "module"], "left_semi").select("path", "line", "name", "kind", prose(F.col("statement")).alias("statement")).orderBy("path", "line")


def source_private_shadows(p: Project) -> DataFrame:
    return sources.private_shadows(sources.declarations(p.scanned), sources.module_imports(p.scanned)).orderBy("module", "name")


def source_similar(p: Project, definitions: bool = False, minimum: int = 60, forwarders: bool = False) -> DataFrame:
    return sources.duplicate_statements(sources.blocks(p.scanned), definitions, minimum, forwarders).orderBy(F.desc("declarations"), "digest")


def source_large(p: Project, k: int = 20) -> DataFrame:
    return sources.largest(sources.blocks(p.scanned), k)


def source_dead(p: Project) -> DataFrame:
    return sources.dead_definitions(p.scanned).orderBy("path", "line")


def source_names(p: Project, pattern: str = sources.PROVISIONAL) -> DataFrame:
    return sources.provisional_names(sources.blocks(p.scanned), pattern).orderBy("path", "line")


def source_definitional_escapes(p: Project) -> DataFrame:
    return sources.definitional_escapes(sources.blocks(p.scanned)).orderBy("path", "line")


def source_profile(p: Project) -> DataFrame:
    """Per file: lines, declarations by kind, and how many of them each audit lists; longest files first."""
    found = sources.blocks(p.scanned)
    kinds = found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    lines = p.files.select("path", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("lines"))
    out = lines.join(kinds, "path", "left")
    for name, rows in (("dead", source_dead(p)), ("provisional", source_names(p)), ("escapes", source_definitional_escapes(p))):
        out = out.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias(name)), "path", "left").na.fill(0, [name])
    return out.orderBy(F.desc("lines"), "path")


def source_symbol_census(p: Project, pattern: str) -> DataFrame:
    """(path, raw, code): matches in the text and in the code without comments, files with any, most code first."""
    both = p.files.select("path", "text").join(p.scanned.select("path", "code"), "path")
    counts = both.select("path", F.regexp_count("text", F.lit(pattern)).alias("raw"), F.regexp_count("code", F.lit(pattern)).alias("code"))
    return counts.where("raw > 0 or code > 0").orderBy(F.desc("code"), F.desc("raw"), "path")


def source_import_closure(p: Project, roots: list[str]) -> dict[str, DataFrame]:
    """What each root reaches through imports of known modules, and what pairs of roots share."""
    imports = sources.module_imports(p.scanned).join(p.scanned.select(F.col("module").alias("dep")), "dep", "left_semi").select("module", "dep")
    closed = materialise(modules.import_closure(imports, p.spark.createDataFrame([(r,) for r in roots], "node string")), "closures")
    return {"closures": closed.orderBy("seed", "node"), "overlap": modules.closure_overlap(closed)}


def source_module_coverage(p: Project, scope: tuple[str, ...], roots: list[str], excluded: list[str]) -> DataFrame:
    imports = sources.module_imports(p.scanned)
    closed = modules.import_closure(imports, p.spark.createDataFrame([(r,) for r in roots], "node string")).select(F.col("node").alias("module"))
    wanted = p.scanned.where(sources.in_scope(F.col("module"), scope)).select("module")
    return modules.coverage_partition(wanted, closed, p.spark.createDataFrame([(m,) for m in excluded], "module string"), imports).orderBy("module")


def source_grounding(p: Project, required_files: list[str], required: dict[str, list[str]], include: list[str], forbid: dict) -> DataFrame:
    return policies.grounding(p.scanned, sources.declarations(p.scanned), required_files, required, include, forbid)


def source_staging(p: Project, records: DataFrame, statuses: list[str]) -> DataFrame:
    return policies.staging(records, p.scanned, statuses)


def source_provenance(p: Project, markers: list[str]) -> DataFrame:
    """(marker, files, mentions): case-insensitive counts of markers in the texts."""
    hits = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.regexp_count(F.lower("text"), F.lit(m.lower())).alias("n")) for m in markers]))
    return p.files.select(hits.alias("h")).groupBy("h.marker").agg(F.count_if(F.col("h.n") > 0).alias("files"), F.sum("h.n").alias("mentions")).orderBy("marker")


def source_module_plan(p: Project, rungs: DataFrame) -> DataFrame:
    return modules.rungs(sources.module_imports(p.scanned), rungs)


def ratchet_check(p: Project, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """Ratchets over the code without comments."""
    return textaudit.ratchet(p.scanned.select("path", F.col("code").alias("text")), rules)


def imports_check(p: Project, groups: dict[str, list[str]], rules: list[dict]) -> DataFrame:
    return policies.import_violations(sources.module_imports(p.scanned), p.scanned.select("module"), groups, rules).orderBy("rule", "module", "imported")


def namespace_check(p: Project, rules: list[dict]) -> DataFrame:
    """Namespaces that a module's files open, with or without declarations in them, against the rules."""
    spaces = p.scanned.select("module", F.explode("namespaces").alias("namespace")).distinct()
    return policies.namespace_violations(spaces, rules).orderBy("rule", "module", "namespace")


def foundations_validate(p: Project, nodes: DataFrame, dependencies: DataFrame, campaigns: DataFrame) -> DataFrame:
    return policies.foundations(nodes, dependencies, campaigns, p.scanned, sources.declarations(p.scanned))


# -- ledgers --------------------------------------------------------------------------------------


def validate(p: Project, kind: str) -> DataFrame:
    """Findings on all documents of a kind: census, review, results or atoms."""
    rules = {"census": documents.validate_census, "review": lambda x: documents.validate_review(x).unionByName(correspondence.of_rows(x)), "results": documents.validate_results, "atoms": documents.validate_atoms}
    return rules[kind](p.ledger(kind)).orderBy("document", "location", "code")


def coverage_validate(p: Project, link: DataFrame) -> DataFrame:
    return documents.validate_coverage(p.results, p.atoms, link).orderBy("document", "location", "code")


def workspace_validate(p: Project) -> DataFrame:
    """The findings on every ledger of the project, with its kind."""
    out = None
    for kind in ("census", "review", "results", "atoms"):
        if p.ledger(kind) is not None:
            found = validate(p, kind).withColumn("kind", F.lit(kind))
            out = found if out is None else out.unionByName(found)
    return out


def summary(p: Project, kind: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(document, field, value, n): histograms of a kind's rows, by default of the fields that such rows are reviewed by."""
    if kind == "census" and fields is None:
        return documents.census_summary(p.censuses).orderBy("document", "field", "value")
    usual = {"review": {"relation": "relation", "verdict": "verdict", "importance": "importance"}, "results": {x: x for x in ("result_kind", "disposition", "verification", "semantic_certification", "semantic_alignment")}, "atoms": {x: x for x in ("kind", "source_role", "formalization_role")}, "literature": {x: x for x in ("kind", "group", "priority", "role", "status", "bibliographic_status")}}
    fields = fields or usual[kind]
    rows = documents.items(p.ledger(kind), *ITEMS[kind])
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), documents.value(F.col("row"), path).alias("value")) for k, path in fields.items()])
    return rows.select("document", F.explode(pairs).alias("x")).where("x.value is not null").groupBy("document", "x.field", "x.value").agg(F.count(F.lit(1)).alias("n")).orderBy("document", "field", "value")


def workspace_status(p: Project) -> DataFrame:
    """(kind, documents, rows, findings) of every ledger of the project."""
    out = None
    for kind in ("census", "review", "results", "atoms", "literature"):
        docs = p.ledger(kind)
        if docs is None:
            continue
        bad = validate(p, kind).count() if kind != "literature" else 0
        one = docs.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("documents")).withColumns({"rows": F.lit(documents.items(docs, *ITEMS[kind]).count()), "findings": F.lit(bad)})
        out = one if out is None else out.unionByName(one)
    return out


def show(p: Project, kind: str, row_id: str) -> DataFrame:
    """(document, pos, row): the rows of an id, as JSON."""
    rows = documents.items(p.ledger(kind), *ITEMS[kind])
    return rows.where(documents.value(F.col("row"), "id") == row_id).select("document", "pos", F.to_json("row").alias("row")).orderBy("document", "pos")


def citations(p: Project) -> DataFrame:
    """(document, row, declaration) of every census row's citations."""
    row = F.col("row")
    return documents.items(p.censuses, "items").select("document", documents.value(row, "id").alias("row"), F.explode(documents.names(row, "lean_declarations")).alias("declaration"))


def census_probe(p: Project, probe: DataFrame) -> DataFrame:
    """(document, row, verification): the state that a probe (declaration, resolved) gives each row, where its document defines that state."""
    defined = p.censuses.select("document", documents.vocabulary(F.col("body"), "verification_definitions").alias("defined"))
    row = F.col("row")
    rows = documents.items(p.censuses, "items").select("document", documents.value(row, "id").alias("row"), documents.value(row, "verification").alias("was"))
    seen = citations(p).join(probe, "declaration").groupBy("document", "row").agg(F.count_if("resolved").alias("ok"), F.count(F.lit(1)).alias("n"))
    has = lambda s: F.array_contains("defined", s)
    state = F.when(F.col("n").isNull() | (F.col("was") == "not_applicable"), F.col("was")).when((F.col("ok") == F.col("n")) & has("proved_in_build"), "proved_in_build").when((F.col("ok") > 0) & has("partially_in_build"), "partially_in_build").when((F.col("ok") == 0) & has("absent"), "absent").otherwise(F.col("was"))
    return rows.join(defined, "document").join(seen, ["document", "row"], "left").select("document", "row", state.alias("verification"))


def census_static(p: Project) -> DataFrame:
    """Findings on cited and planned names against the scanned sources."""
    row = F.col("row")
    rows = documents.items(p.censuses, "items").select(documents.value(row, "id").alias("row"), documents.names(row, "lean_declarations").alias("cited"), documents.names(row, "planned_declarations").alias("planned"))
    named = lambda c: rows.select("row", F.explode(c).alias("name"))
    return documents.cited_findings(named("cited"), sources.declarations(p.scanned).where("not anonymous"), named("planned"))


def alignment_check(p: Project, pins: DataFrame) -> DataFrame:
    """(declaration, status) of pins against the statement records; what censuses cite without a pin is unpinned."""
    return statements.pin_states(pins, p.records, citations(p).select("declaration"))


def alignment_pin(p: Project, declared: list[str]) -> DataFrame:
    """Fresh pins of some declarations: structural hash and hash of the printed type."""
    return p.records.where(F.col("name").isin(declared) & ~F.col("missing")).select(F.col("name").alias("declaration"), "type_expr_hash", F.sha2("type", 256).alias("type_text_sha256"))


def xref(p: Project, minimum: int = 2) -> DataFrame:
    """Declarations that several documents cite; most documents first."""
    return ledgers.reuse(citations(p), minimum).orderBy(F.desc("documents"), F.desc("occurrences"), "declaration")


def xref_of(p: Project, name: str) -> DataFrame:
    return citations(p).where(F.col("declaration") == name).orderBy("document", "row")


def xref_stats(p: Project) -> DataFrame:
    return citations(p).agg(F.count_distinct("declaration").alias("names"), F.count(F.lit(1)).alias("occurrences"), F.count_distinct("document").alias("documents"))


def search(p: Project, needle: str, limit: int = 50) -> DataFrame:
    """Cited names that hold a text: those that begin with it first, then the shorter, then by name."""
    low = F.lower("declaration")
    found = citations(p).select("declaration").distinct().where(low.contains(needle.lower()))
    return found.orderBy(~low.startswith(needle.lower()), F.length("declaration"), "declaration").limit(limit)


def context(p: Project, name: str) -> DataFrame:
    """(document, row, role): every census row that names a declaration, in the first of the roles canonical, supporting, listed."""
    row = F.col("row")
    rows = documents.items(p.censuses, "items").select("document", documents.value(row, "id").alias("row"), documents.names(row, "semantic_review.canonical_declarations").alias("c"), documents.names(row, "semantic_review.supporting_declarations").alias("s"), documents.names(row, "lean_declarations").alias("l"))
    role = F.when(F.array_contains("c", name), "canonical").when(F.array_contains("s", name), "supporting").when(F.array_contains("l", name), "listed")
    return rows.select("document", "row", role.alias("role")).where("role is not null").orderBy("document", "row")


def symbol(p: Project, name: str, module: str, limit: int = 8) -> DataFrame:
    """(rank, name): a name as written, else relative to the prefixes of a module (longest first), else what ends with it (fewest dots first)."""
    parts = module.split(".")
    exact = [(0, name)] + [(len(parts) - i + 1, ".".join([*parts[:i], name])) for i in range(len(parts), 0, -1)]
    asked = p.spark.createDataFrame(exact, "rank int, name string")
    known = p.decls.select("name").distinct()
    near = asked.join(known, "name").select("rank", "name")
    loose = known.where(F.col("name").endswith("." + name)).select((F.lit(1000) + F.size(F.split("name", r"\."))).alias("rank"), "name")
    return near.unionByName(loose).groupBy("name").agg(F.min("rank").alias("rank")).orderBy("rank", "name").select("rank", "name").limit(limit)


def journal(p: Project, limit: int = 100) -> DataFrame:
    return p.journal.orderBy(F.desc("at"), "document", "pointer").limit(limit)


# -- one document ---------------------------------------------------------------------------------


def patch(body: str, row_id: str, sets: list[tuple[str, str]], deletes: tuple[str, ...] = ()) -> str:
    """A document's JSON with fields of one row set (values as typed on a command line) and deleted."""
    document = json.loads(body)
    documents.patch_item(document, row_id, [(path, documents.parse_scalar(value)) for path, value in sets], deletes)
    return json.dumps(document, ensure_ascii=False, indent=2)


def add(body: str, row: dict) -> str:
    document = json.loads(body)
    documents.append_item(document, row)
    return json.dumps(document, ensure_ascii=False, indent=2)


# -- history and logs -----------------------------------------------------------------------------


def history_commits(p: Project) -> DataFrame:
    return p.commits.orderBy(F.desc("ts"), "commit")


def history_summary(p: Project, k: int = 20) -> dict[str, DataFrame]:
    """Totals of the commits, and the files that most of them touch; equal counts by name."""
    touched = p.commits.select("commit", F.explode(F.array_distinct("files")).alias("file"))
    total = p.commits.agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("author_email").alias("authors"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum("binary_files").alias("binary_files"))
    return {"total": total, "top": logs.top(touched, "file", k), "coauthors": loaders.coauthors(p.commits).groupBy("email").agg(F.count(F.lit(1)).alias("commits"))}


def build_report(lines: DataFrame, gap: int = 5) -> dict[str, DataFrame]:
    """Diagnostics of build logs (run, n, line), equal ones once, and clusters of near lines in a file; progress and counts by severity."""
    plain = lines.withColumn("line", without_control(F.col("line")))
    found, roles = logs.parse_output(plain)
    found = materialise(found, "diagnostics")
    return {"diagnostics": logs.deduplicate_diagnostics(found).orderBy("n"), "clusters": logs.gap_clusters(found.where("file is not null"), "file", "line_no", gap), "counts": found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "synthetic": roles.where("role = 'synthetic'"), "progress": logs.progress(plain)}
