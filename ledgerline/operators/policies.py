"""Policies as rule tables: imports, namespaces, grounding, staging, foundations.

Groups, rules and patterns are small tables that a policy file brings; modules and imports
may be many. Whether a name is in a group is a matter of its patterns (globs or dotted
prefixes) alone, so that rules on imports are filters of the edges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.functions.text import matches
from ledgerline.operators import graph

FINDING = ("level", "code", "message", "location")


def any_match(name: Column, patterns: list[str]) -> Column:
    """Whether a name matches any of some globs or dotted prefixes."""
    return reduce(lambda a, b: a | b, [matches(name, p) for p in patterns], F.lit(False))


def classify(modules: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(module, groups): the names of the groups a module is in, none for most."""
    member = F.array_compact(F.array(*[F.when(any_match(F.col("module"), ps), F.lit(g)) for g, ps in groups.items()])) if groups else F.array().cast("array<string>")
    return modules.select("module").distinct().withColumn("groups", member)


def import_violations(imports: DataFrame, modules: DataFrame, groups: dict[str, list[str]], rules: list[dict]) -> DataFrame:
    """(rule, module, imported, path) of imports that a rule forbids.

    A rule has id, source_groups, deny_groups, allow_groups, exceptions (patterns of modules
    that it lets off) and transitive. A dependency is forbidden if it is in a denied group,
    or if groups are allowed and it is in none of them: one in no group at all breaks an
    allow rule. A transitive rule gives one shortest path, the least, per module; modules
    outside the index can be hit, but not gone through.
    """
    edges = imports.select("module", "dep").distinct()
    known = modules.select("module").distinct()
    within = lambda name, wanted: any_match(name, [p for g in wanted for p in groups.get(g, [])])

    def covers(rule: dict, name: Column) -> Column:
        return within(name, rule["source_groups"]) & ~any_match(name, rule.get("exceptions", []))

    def wrong(rule: dict, name: Column) -> Column:
        denied = within(name, rule.get("deny_groups", []))
        return denied | ~within(name, rule["allow_groups"]) if rule.get("allow_groups") else denied

    direct, out = [r for r in rules if not r.get("transitive")], []
    module, dep = F.col("module"), F.col("dep")
    if direct:
        hits = F.filter(F.array(*[F.when(covers(r, module) & wrong(r, dep), F.lit(r["id"])) for r in direct]), lambda x: x.isNotNull())
        told = edges.where(reduce(lambda a, b: a | b, [covers(r, module) & wrong(r, dep) for r in direct]))
        told = told.join(known.where(reduce(lambda a, b: a | b, [covers(r, module) for r in direct])), "module", "left_semi")
        out.append(told.select(F.explode(hits).alias("rule"), "module", F.col("dep").alias("imported"), F.array("module", "dep").alias("path")))
    for rule in rules:
        if rule.get("transitive"):
            hit = first_forbidden(edges, known, lambda x, rule=rule: covers(rule, x), lambda x, rule=rule: wrong(rule, x))
            out.append(hit.select(F.lit(rule["id"]).alias("rule"), "module", "imported", "path"))
    if not out:
        return imports.sparkSession.createDataFrame([], "rule string, module string, imported string, path array<string>")
    return reduce(DataFrame.unionByName, out)


def first_forbidden(edges: DataFrame, known: DataFrame, covers: Callable[[Column], Column], wrong: Callable[[Column], Column]) -> DataFrame:
    """(module, imported, path): for every known module that a rule covers the least of the shortest paths to an import that is wrong.

    Searches stop at their first hit and go through known modules only. Modules that import a wrong one themselves are settled
    by a filter; the edges are written for the others' searches, if there are others.
    """
    source = known.where(covers(F.col("module")))
    own = edges.where((F.col("module") != F.col("dep")) & covers(F.col("module")) & wrong(F.col("dep"))).join(source, "module", "left_semi")
    found = materialise(own.groupBy("module").agg(F.min("dep").alias("imported")).select("module", "imported", F.array("module", "imported").alias("path")), "hits")
    front = materialise(source.join(found.select("module"), "module", "left_anti").select("module", F.col("module").alias("node"), F.array("module").alias("path")), "search")
    if front.isEmpty():
        return found
    step = materialise(edges.join(known, "module", "left_semi").select(F.col("module").alias("node"), "dep"), "steps")
    seen = front.select("module", "node")
    while not front.isEmpty():
        onward = front.join(step, "node").select("module", F.col("dep").alias("node"), F.concat("path", F.array("dep")).alias("path")).groupBy("module", "node").agg(F.min("path").alias("path"))
        onward = materialise(onward.join(seen, ["module", "node"], "left_anti"), "search")
        hit = onward.where(wrong(F.col("node"))).groupBy("module").agg(F.min("path").alias("path"))
        hit = materialise(hit.select("module", F.element_at("path", -1).alias("imported"), "path"), "hits")
        found = found.unionByName(hit)
        front = materialise(onward.join(hit.select("module"), "module", "left_anti"), "search")
        seen = materialise(seen.unionByName(onward.select("module", "node")), "seen")
    return found


def namespace_violations(opened: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, module, namespace, why) for opened namespaces (module, namespace): denied, or outside what a rule allows; a denied one is only that."""
    each = []
    for rule in rules:
        denied = any_match(F.col("namespace"), rule.get("deny", []))
        outside = ~any_match(F.col("namespace"), rule["allow"]) if rule.get("allow") else F.lit(False)
        why = F.when(denied, "denied").when(outside, "not-allowed")
        each.append(F.when(any_match(F.col("module"), rule["modules"]) & why.isNotNull(), F.struct(F.lit(rule["id"]).alias("rule"), why.alias("why"))))
    return opened.select("module", "namespace", F.explode(F.array_compact(F.array(*each))).alias("v")).select("v.rule", "module", "namespace", "v.why")


def grounding(scanned: DataFrame, decls: DataFrame, required_files: list[str], required: dict[str, list[str]], include: list[str], forbid: dict) -> DataFrame:
    """Findings on required files and declarations, and on admissions, axioms and patterns (first match) in the included files."""
    spark = scanned.sparkSession
    paths = scanned.select("path").distinct()
    asked = spark.createDataFrame([(f,) for f in required_files], "path string").join(paths, "path", "left_anti")
    out = [_finding(asked, "grounding-file", F.lit("required file is missing"), F.col("path"))]
    need = spark.createDataFrame([(f, n, n.rsplit(".", 1)[-1]) for f, names in required.items() for n in names], "path string, name string, short_name string")
    no_file = need.select("path").distinct().join(paths, "path", "left_anti")
    out.append(_finding(no_file, "grounding-declaration-file", F.lit("file of required declarations is missing"), F.col("path")))
    absent = need.join(paths, "path", "left_semi").join(decls, ["path", "name"], "left_anti").join(decls, ["path", "short_name"], "left_anti")
    out.append(_finding(absent, "grounding-declaration", F.concat(F.lit("required declaration is missing: "), "name"), F.col("path")))
    chosen = scanned.where(any_match(F.col("path"), include)) if include else scanned
    if forbid.get("admissions"):
        out.append(_finding(chosen.where("admitted"), "grounding-admission", F.lit("forbidden admission"), F.col("path")))
    if forbid.get("axioms"):
        axioms = decls.where("kind = 'axiom'").join(chosen.select("path"), "path", "left_semi")
        out.append(_finding(axioms, "grounding-axiom", F.concat(F.lit("forbidden axiom: "), "name"), F.concat_ws(":", "path", F.col("line").cast("string"))))
    for pattern in forbid.get("patterns", []):
        hit = chosen.where(F.col("code").rlike(pattern))
        before = F.element_at(F.split("code", pattern, 2), 1)
        line = F.size(F.split(before, "\n", -1))
        out.append(_finding(hit, "grounding-pattern", F.lit(f"forbidden pattern: {pattern}"), F.concat_ws(":", "path", line.cast("string"))))
    return reduce(DataFrame.unionByName, out)


def _finding(rows: DataFrame, code: str, message: Column, location: Column, level: str = "error") -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), location.alias("location"))


def staging(records: DataFrame, modules: DataFrame, statuses: list[str]) -> DataFrame:
    """Findings on a registry (pos, module, status): modules that aren't there, registered twice, of no allowed status."""
    there = records.join(modules.select("module").distinct(), "module", "left_semi")
    gone = records.join(modules.select("module").distinct(), "module", "left_anti")
    first = there.groupBy("module").agg(F.min("pos").alias("first"))
    twice = there.join(first, "module").where("pos > first")
    odd = there.where(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)))
    out = _finding(gone, "staging-module", F.lit("registered module is missing"), F.col("module"))
    out = out.unionByName(_finding(twice, "staging-duplicate", F.lit("module is registered twice"), F.col("module")))
    return out.unionByName(_finding(odd, "staging-status", F.concat(F.lit("status isn't allowed: "), F.coalesce("status", F.lit("none"))), F.col("module")))


def leftover(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """Nodes that no order by dependencies reaches: those on cycles and all that depend on them (deps: node, dep; unknown deps don't count)."""
    known = nodes.select("node").distinct()
    edges = deps.join(known, "node", "left_semi").join(known.select(F.col("node").alias("dep")), "dep", "left_semi").select(F.col("dep").alias("src"), F.col("node").alias("dst")).distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    core = graph.components(edges).select("node").unionByName(loops).distinct()
    return graph.walk(edges, core.withColumn("seed", F.lit("*"))).select("node").distinct()


def foundations(nodes: DataFrame, deps: DataFrame, campaigns: DataFrame, files: DataFrame, decls: DataFrame) -> DataFrame:
    """Findings on a foundation map: nodes (node, file, declaration), deps (node, dep), campaigns (pos, campaign, node)."""
    ids = nodes.select("node").distinct()
    twice = nodes.groupBy("node").count().where("count > 1")
    missing = deps.join(nodes, "node", "left_semi").select(F.col("dep").alias("node")).distinct().join(ids, "node", "left_anti")
    out = [_finding(twice, "foundation-duplicate-id", F.lit("node id stands twice"), F.col("node")), _finding(missing, "foundation-missing-dependency", F.lit("dependency isn't defined"), F.col("node"))]
    cyclic = leftover(nodes, deps).agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("all")).where("all <> ''")
    out.append(_finding(cyclic, "foundation-cycle", F.lit("dependencies hold a cycle"), F.col("all")))
    named = campaigns.select("pos", "campaign").distinct().groupBy("campaign").count().where("count > 1")
    out.append(_finding(named, "foundation-duplicate-campaign", F.lit("campaign id stands twice"), F.col("campaign")))
    stray = campaigns.join(ids, "node", "left_anti")
    out.append(_finding(stray, "foundation-campaign-node", F.concat(F.lit("campaign names an unknown node: "), "node"), F.col("campaign")))
    paths = files.select(F.col("path").alias("file")).distinct()
    out.append(_finding(nodes.join(paths, "file", "left_anti"), "foundation-file", F.lit("source file is missing"), F.col("file")))
    held = decls.select(F.col("path").alias("file"), F.explode(F.array("name", "short_name")).alias("declaration"), F.col("name").alias("full")).distinct()
    there = nodes.join(paths, "file", "left_semi")
    short = F.element_at(F.split("declaration", r"\."), -1)
    absent = there.join(held.select("file", "declaration"), ["file", "declaration"], "left_anti").withColumn("short", short).join(held.select("file", F.col("declaration").alias("short")), ["file", "short"], "left_anti")
    out.append(_finding(absent, "foundation-declaration", F.concat(F.lit("declaration isn't in its file: "), "declaration"), F.col("file")))
    return reduce(DataFrame.unionByName, out)
