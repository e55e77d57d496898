"""Consumption of claims: which of them a target depends on, and along which route.

Edges go from a dependency to its consumer. All searches stay within the target's closure (what it depends on), and there within what lies ahead of the names that claims list. Claims are
(census, family, id, title, nth, declarations, canonical, supporting): names as their authors wrote them, in lists; ``nth`` orders the claims.
A claim's representative is its canonical declaration nearest to the target, else its nearest supporting one, else the nearest of all it names.

Routes follow shortest paths, of equally short ones the least by its names from the start; the witness to the target is the least from
the target's side. Where a path ends at any of a set of nodes, one backward search gives every node's distance to
the set (``field``), and every node's next hop is the least consumer that is nearest: a
claim's path is then a chain of hops, so the work doesn't grow with the number of claims. Only a terminal
claim, which must not end at itself, searches on its own (``first_hits``).

Defined cases: a name is taken as it stands or by its last part where that is unique; ambiguous ones are warnings, unknown ones are left out; a claim of
which nothing is resolved has no representative and no route; an empty closure or no claims give empty tables; edges that several claims share are told once, by the first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.operators import graph

CLASSES = ("canonical", "supporting", "registered-support")


@dataclass
class Landmark:
    """A library through which routes are shown."""

    id: str
    library: str
    label: str = ""


def node_id(family: Column, claim: Column) -> Column:
    return F.concat(F.lit("claim:"), F.translate(family, " –—", "---"), F.lit(":"), claim)


def resolve(claims: DataFrame, decls: DataFrame) -> DataFrame:
    """(census, id, role, pos, raw, name, hits): each name that a claim lists; ``name`` is null where it is unknown or ambiguous."""
    roles = {"declared": "declarations", "canonical": "canonical", "supporting": "supporting"}
    listed = reduce(DataFrame.unionByName, [claims.select("census", "id", F.lit(role).alias("role"), F.posexplode(column).alias("pos", "raw")) for role, column in roles.items()])
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    listed = materialise(listed.withColumn("short", short("raw")), "listed")
    # only declarations that are named are moved: the lists are small beside them
    exact = decls.select(F.col("name").alias("raw"), F.col("name").alias("exact")).join(listed.select("raw").distinct(), "raw", "left_semi")
    by_short = decls.withColumn("short", short("name")).join(listed.select("short").distinct(), "short", "left_semi").groupBy("short").agg(F.count(F.lit(1)).alias("hits"), F.min("name").alias("only"))
    found = listed.join(exact, "raw", "left").join(by_short, "short", "left")
    name = F.coalesce("exact", F.when(F.col("hits") == 1, F.col("only")))
    return found.select("census", "id", "role", "pos", "raw", name.alias("name"), F.when(F.col("exact").isNull(), F.coalesce("hits", F.lit(0))).alias("hits"))


def field(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, distance, hop, left): distance to the nearest wanted node (0 at one), the least of the consumers that are nearest, and how far that one is.

    Nodes that reach no wanted node by an edge have no hop.
    """
    far = materialise(graph.closure(edges, wanted.select("node").distinct()), "field")
    ahead = edges.join(far.select(F.col("node").alias("dst"), F.col("distance").alias("left")), "dst")
    hop = ahead.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("left", F.col("dst").alias("hop"))).alias("m"))
    return materialise(far.join(hop, "node", "full_outer").select("node", "distance", "m.hop", "m.left"), "field")


def follow(starts: DataFrame, ways: DataFrame, at_start: Column) -> DataFrame:
    """(columns of starts, path) for the starts (column ``node``) from which a wanted node is reached; ``at_start`` says whether the start may be it."""
    there = ways.select("node", "distance", "hop", "left")
    begun = materialise(starts.join(there, "node").withColumn("path", F.array("node")).withColumn("done", at_start & (F.coalesce(F.col("distance"), F.lit(1)) == 0)), "follow")
    columns = [*starts.columns, "path"]
    done, open_ = begun.where("done").select(*columns), begun.where("not done and hop is not null").select(*columns, F.col("hop").alias("at"), "left")
    while not open_.isEmpty():
        moved = materialise(open_.withColumn("path", F.concat("path", F.array("at"))), "follow")
        done = done.unionByName(moved.where("left = 0").select(*columns))
        onward = there.select(F.col("node").alias("at"), "hop", F.col("left").alias("after"))
        open_ = moved.where("left > 0").drop("left").join(onward, "at").select(*columns, F.col("hop").alias("at"), F.col("after").alias("left"))
    return done


def first_hits(edges: DataFrame, starts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, path): for each seed the shortest and least path from its node (which may be the end) to a node wanted by another; (node, only): only = the seed that alone wants the node, or null."""
    step = edges.select(F.col("src").alias("node"), "dst")
    front = materialise(starts.select("seed", "node", F.array("node").alias("path")), "hits")
    known, found = front.select("seed", "node"), None
    while not front.isEmpty():
        other = front.join(wanted, "node").where(F.col("only").isNull() | (F.col("only") != F.col("seed")))
        hit = materialise(other.groupBy("seed").agg(F.min("path").alias("path")), "hits")
        found = hit if found is None else found.unionByName(hit)
        going = front.join(hit.select("seed"), "seed", "left_anti")
        reached = going.join(step, "node").groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = materialise(reached.join(known, ["seed", "node"], "left_anti"), "hits")
        known = known.unionByName(front.select("seed", "node"))
    return found if found is not None else front.select("seed", "path")


@dataclass
class Consumption:
    """Tables of an analysis."""

    #: census, id, node_id, family, title, consumed, class, representative, distance, first_consumer, witness, terminal
    claims: DataFrame
    #: census, id, landmark, place, declaration, witness: one row for every claim and landmark
    landmarks: DataFrame
    #: census, id, path, downstream: a claim's nearest claim of a terminal family
    downstream: DataFrame
    #: source, target, role, origin, witness, collapsed
    edges: DataFrame
    #: census, id, raw, hits: names with several declarations
    warnings: DataFrame

    def nodes(self, decls: DataFrame, target: str, landmarks: list[Landmark]) -> DataFrame:
        """(id, stage, claim): claims at stage 0, at the stage of their landmark's library or at the terminal one; landmark declarations; the target last."""
        of_library = F.coalesce(*[F.when(F.col("library") == x.library, F.lit(i + 1)) for i, x in enumerate(landmarks)], F.lit(0))
        library = decls.select(F.col("name").alias("representative"), "library")
        terminal = self.claims.agg(F.coalesce(F.bool_or("terminal"), F.lit(False)).alias("any"))
        last = len(landmarks) + 1
        claims = self.claims.join(library, "representative", "left").select(F.col("node_id").alias("id"), F.when(F.col("terminal"), F.lit(last)).otherwise(of_library).alias("stage"), F.lit(True).alias("claim"))
        hits = self.landmarks.where("declaration is not null and declaration <> " + repr(target)).select(F.col("declaration").alias("representative")).distinct().join(library, "representative")
        end = terminal.select(F.lit(target).alias("id"), (F.lit(last) + F.col("any").cast("int")).alias("stage"), F.lit(False).alias("claim"))
        return claims.unionByName(hits.select(F.col("representative").alias("id"), of_library.alias("stage"), F.lit(False).alias("claim"))).unionByName(end)

    def families(self) -> DataFrame:
        """(family, claims, consumed, canonical, supporting)."""
        kind = lambda c: F.count_if(F.col("class") == c)
        return self.claims.groupBy("family").agg(F.count(F.lit(1)).alias("claims"), F.count_if("consumed").alias("consumed"), kind("canonical").alias("canonical"), kind("supporting").alias("supporting"))


def analyse(edges: DataFrame, decls: DataFrame, claims: DataFrame, target: str, landmarks: list[Landmark] = (), terminal_families: list[str] = ()) -> Consumption:
    """The consumption of claims by one target; decls are (name, library, internal). Without terminal families those with a claim in the target's library are."""
    if len({x.id for x in landmarks}) != len(landmarks) or len({x.library for x in landmarks}) != len(landmarks):
        raise ValueError("landmarks need ids and libraries of their own")
    spark, key = edges.sparkSession, ["census", "id"]
    one = spark.range(1).select(F.lit(target).alias("node"))
    told = materialise(resolve(claims, decls), "resolved")
    # Every route begins at a name that a claim lists and goes forward, so the searches see only what lies ahead of those.
    edges = graph.ahead_of(edges, told.where("name is not null").select(F.col("name").alias("node")))
    near = materialise(graph.closure(edges, one), "closure")
    inside = materialise(graph.induced(edges, near).select("src", "dst").distinct(), "closure")
    known = told.where("name is not null").groupBy(*key, "role", "name").agg(F.min("pos").alias("pos"))
    placed = materialise(known.join(near.withColumnRenamed("node", "name"), "name", "left"), "resolved")

    # Representative: of the best class that the target consumes the nearest, ties as listed; else the first of the best class at all.
    rank = F.when(F.col("role") == "canonical", 0).when(F.col("role") == "supporting", 1).otherwise(2)
    first = placed.groupBy(*key, "name").agg(
        F.min(rank).alias("rank"),
        F.min(F.struct(rank.alias("rank"), "pos")).alias("place"),
        F.coalesce(F.min(F.when(F.col("role") == "declared", F.col("pos"))), F.lit(1 << 30) + F.min("pos")).alias("nth_name"),
        F.first("distance").alias("distance"),
    )
    best = first.groupBy(*key).agg(
        F.min(F.when(F.col("distance").isNotNull(), F.struct("rank", "distance", "nth_name", "name"))).alias("used"),
        F.min(F.struct("place", "name")).alias("held"),
    )
    families = claims.select("family").distinct()
    if terminal_families:
        lacking = set(terminal_families) - {r.family for r in families.where(F.col("family").isin(list(terminal_families))).collect()}
        if lacking:
            raise ValueError(f"terminal families without claims: {sorted(lacking)}")
        ends = families.where(F.col("family").isin(list(terminal_families)))
    else:
        of_target = decls.where(F.col("name") == target).select("library")
        there = told.where("role = 'declared' and name is not null").join(decls.select("name", "library").join(of_target, "library", "left_semi"), "name", "left_semi")
        ends = claims.join(there.select(*key).distinct(), key, "left_semi").select("family").distinct()
    whole = claims.join(best, key, "left").join(ends.withColumn("terminal", F.lit(True)), "family", "left")
    consumer = inside.groupBy(F.col("src").alias("representative")).agg(F.min("dst").alias("first_consumer"))
    witness = graph.witness_paths(graph.reverse(inside), one).select(F.col("node").alias("representative"), F.reverse("path").alias("witness"))
    rows = whole.select(
        *key, "nth", "family", "title", node_id(F.col("family"), F.col("id")).alias("node_id"), F.coalesce("terminal", F.lit(False)).alias("terminal"), F.col("used").isNotNull().alias("consumed"),
        F.coalesce(*[F.when(F.col("used.rank") == i, c) for i, c in enumerate(CLASSES)], F.lit("none")).alias("class"), F.coalesce("used.name", "held.name").alias("representative"), F.col("used.distance").alias("distance"),
    )
    rows = materialise(rows.join(consumer, "representative", "left").join(witness, "representative", "left"), "claims")

    # Nodes that terminal claims declare: with the claim's id where it is the only one.
    registered = told.where("role = 'declared' and name is not null").select(*key, "name").distinct().join(rows.where("terminal").select(*key, "node_id", "title"), key)
    owners = registered.groupBy(F.col("name").alias("node")).agg(F.when(F.count_distinct("node_id") == 1, F.min("node_id")).alias("only"))
    owners = materialise(owners.join(near.select("node"), "node", "left_semi"), "owners")
    choice = materialise(registered.select(F.col("name").alias("via"), F.col("node_id").alias("other"), "id", "title"), "owners")
    ways = field(inside, owners)

    def downstream(starts: DataFrame) -> DataFrame:
        """Starts (census, id, node_id, terminal, node) with path and downstream claim."""
        plain = follow(starts.where("not terminal"), ways, F.lit(True))
        own = first_hits(inside, starts.where("terminal").select(F.col("node_id").alias("seed"), "node"), owners)
        found = plain.unionByName(starts.where("terminal").join(own, F.col("node_id") == F.col("seed")).drop("seed"))
        met = found.withColumn("via", F.element_at("path", -1)).join(choice.withColumnsRenamed({"id": "other_id", "title": "other_title"}), "via").where("other <> node_id")
        least = met.groupBy(*key).agg(F.min(F.struct("other_id", "other_title", "other")).alias("m"), F.first("path").alias("path"))
        return least.select(*key, "path", F.col("m.other").alias("downstream"))

    used = rows.where("consumed").select(*key, "node_id", "terminal", F.col("representative").alias("node"))
    nearest = materialise(downstream(used), "downstream")

    # Landmarks, one after the other: each search starts where the last one that was met ended.
    at, hits = materialise(used, "landmark"), []
    for i, mark in enumerate(landmarks):
        seam = decls.where((F.col("library") == mark.library) & ~F.col("internal")).select(F.col("name").alias("node")).join(near.select("node"), "node", "left_semi")
        met = follow(at, field(inside, seam), F.lit(True))
        hit = materialise(at.join(met.select(*key, "path"), key, "left").withColumn("declaration", F.element_at("path", -1)), "landmark")
        hits.append(hit.select(*key, "node_id", "terminal", F.lit(mark.id).alias("landmark"), F.lit(i).alias("place"), "declaration", F.col("path").alias("witness")))
        at = hit.select(*key, "node_id", "terminal", F.coalesce("declaration", "node").alias("node"))
    none = rows.where(F.lit(False)).select(*key, "node_id", "terminal", F.lit("").alias("landmark"), F.lit(0).alias("place"), F.col("representative").alias("declaration"), "witness")
    seen = reduce(DataFrame.unionByName, hits, none)
    marks = F.array(*[F.struct(F.lit(x.id).alias("landmark"), F.lit(i).alias("place")) for i, x in enumerate(landmarks)]).cast("array<struct<landmark:string,place:int>>")
    nothing = F.lit(None).cast("string").alias("declaration"), F.lit(None).cast("array<string>").alias("witness")
    lacking = rows.where("not consumed").select(*key, "node_id", "terminal", F.inline(marks)).select(*key, "node_id", "terminal", "landmark", "place", *nothing)

    # Edges: claim to target; or claim, landmarks, and the next claim or the target.
    edge = lambda source, to, role, path: (source.alias("source"), to.alias("target"), role.alias("role"), F.col("node_id").alias("origin"), path.alias("witness"))
    order = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    moves = seen.where("not terminal and declaration is not null").join(used.select(*key, F.col("node").alias("began")), key)
    moves = moves.withColumn("before", F.coalesce(F.last("declaration", True).over(order), F.col("began"))).where("declaration <> before")
    moves = moves.withColumn("from", F.coalesce(F.last("declaration", True).over(order), F.col("node_id")))
    ended = at.where("not terminal").join(used.select(*key, F.col("node").alias("began")), key).withColumn("from", F.when(F.col("node") == F.col("began"), F.col("node_id")).otherwise(F.col("node")))
    onward = ended.join(downstream(at.where("not terminal")), key, "left").join(witness.withColumnRenamed("representative", "node"), "node", "left")
    drawn = rows.where("consumed and terminal").select(*edge(F.col("node_id"), F.lit(target), F.lit("claim-to-target"), F.col("witness")))
    drawn = drawn.unionByName(moves.select(*edge(F.col("from"), F.col("declaration"), F.concat(F.lit("landmark:"), "landmark"), F.col("witness"))))
    role = F.when(F.col("downstream").isNotNull(), "downstream-headline").otherwise("to-target")
    drawn = drawn.unionByName(onward.select(*edge(F.col("from"), F.coalesce("downstream", F.lit(target)), role, F.coalesce("path", "witness"))))
    drawn = drawn.where("source <> target and witness is not null").join(rows.select(F.col("node_id").alias("origin"), "nth"), "origin")
    told_once = drawn.groupBy("source", "target", "role").agg(F.min(F.struct("nth", "origin", "witness")).alias("m"))
    drawn = told_once.select("source", "target", "role", "m.origin", "m.witness", F.greatest(F.size("m.witness") - 2, F.lit(0)).alias("collapsed"))
    warnings = told.where("name is null and hits > 1 and role = 'declared'").select(*key, "raw", "hits")
    return Consumption(rows, seen.unionByName(lacking).select(*key, "landmark", "place", "declaration", "witness"), nearest, drawn, warnings)
