"""Headline analyses: what the dependencies of claims share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.operators import graph, pairs


def dependency_walk(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, node, distance): every dependency of every claim (columns id, declaration)."""
    seeds = claims.select(F.col("id").alias("seed"), F.col("declaration").alias("node"))
    return materialise(graph.walk(graph.reverse(edges), seeds).withColumnRenamed("seed", "claim"), "cover")


def coverage(walked: DataFrame) -> DataFrame:
    """(node, coverage, shared): how many claims depend on a node, two or more make it shared."""
    return walked.groupBy("node").agg(F.count_distinct("claim").alias("coverage")).withColumn("shared", F.col("coverage") >= 2)


def shared_frontier(edges: DataFrame, covered: DataFrame) -> DataFrame:
    """Shared nodes with a consumer in the union that is covered by fewer claims."""
    consumer = covered.select(F.col("node").alias("dst"), F.col("coverage").alias("above"))
    own = covered.where("shared").select(F.col("node").alias("src"), "coverage")
    return edges.join(own, "src").join(consumer, "dst").where("above < coverage").select(F.col("src").alias("node"), "coverage").distinct()


def headline_stats(walked: DataFrame, covered: DataFrame) -> DataFrame:
    """Per claim: dependencies, those of its own alone, shared ones, distance to the nearest shared one."""
    joined = walked.join(covered, "node")
    dep = F.col("distance") > 0
    return joined.groupBy("claim").agg(
        F.count_if(dep).alias("dependencies"),
        F.count_if(dep & ~F.col("shared")).alias("exclusive"),
        F.count_if(dep & F.col("shared")).alias("shared"),
        F.min(F.when(dep & F.col("shared"), F.col("distance"))).alias("nearest_shared"),
    )


def headline_pairs(walked: DataFrame) -> DataFrame:
    """(a, b, node, da, db, common): for two claims, the common dependency of least greater distance, then least sum, then least name, and how many they have.

    The claims' own declarations are no common dependencies of theirs.
    """
    below = walked.where("distance > 0").withColumnRenamed("claim", "owner")
    return pairs.common(below, nearest=True)


def library_counts(walked: DataFrame, decls: DataFrame) -> DataFrame:
    return walked.join(decls.select(F.col("name").alias("node"), "library"), "node").groupBy("claim", "library").agg(F.count(F.lit(1)).alias("nodes"))


def structural_keep(edges: DataFrame, decls: DataFrame, always: DataFrame) -> DataFrame:
    """Nodes that collapsing private chains keeps: those listed, those whose in- or out-degree isn't one, those at a library crossing."""
    library = decls.select(F.col("name").alias("node"), "library")
    one = edges.join(library.withColumnsRenamed({"node": "src", "library": "sl"}), "src", "left").join(library.withColumnsRenamed({"node": "dst", "library": "dl"}), "dst", "left")
    crosses = (~F.col("sl").eqNullSafe(F.col("dl"))).cast("int")
    ends = one.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), crosses.alias("x")).unionByName(one.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), crosses.alias("x")))
    found = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.max("x").alias("x"))
    return found.where("i <> 1 or o <> 1 or x = 1").select("node").unionByName(always.select("node")).distinct()


def collapse(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(src, dst, witness, collapsed): the edges among kept nodes once private chains are contracted, with the nodes between.

    Every node that isn't kept has one dependency and one consumer (``structural_keep``). Each points at its consumer;
    rounds of pointer doubling join a node's chain with its end's chain, so that a chain of n nodes takes log n rounds.
    Rings of private nodes never end and hang on nothing kept: they are left when a round settles no more. An edge that
    comes back to its source is left out.
    """
    kept = keep.select("node").distinct()
    edges = materialise(edges.select("src", "dst").distinct(), "collapse")
    marked = kept.select(F.col("node").alias("dst"), F.lit(True).alias("done"))
    onward = edges.join(kept.select(F.col("node").alias("src")), "src", "left_anti").join(marked, "dst", "left")
    chain = materialise(onward.select(F.col("src").alias("node"), F.col("dst").alias("end"), F.array("src").alias("path"), F.coalesce("done", F.lit(False)).alias("done")), "collapse")
    left = chain.where("not done").count()
    while left:
        ahead = chain.select(F.col("node").alias("end"), F.col("end").alias("then"), F.col("path").alias("more"), F.col("done").alias("settled"))
        moved = chain.where("not done").join(ahead, "end").select("node", F.col("then").alias("end"), F.concat("path", "more").alias("path"), F.col("settled").alias("done"))
        chain = materialise(chain.where("done").unionByName(moved), "collapse")
        now = chain.where("not done").count()
        if now == left:
            break
        left = now
    out = edges.join(kept.select(F.col("node").alias("src")), "src")
    direct = out.join(kept.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", F.array("src", "dst").alias("witness"))
    through = out.join(chain.where("done").withColumnRenamed("node", "dst"), "dst").select("src", F.col("end").alias("dst"), F.concat(F.array("src"), "path", F.array("end")).alias("witness"))
    return direct.unionByName(through).where("src <> dst").distinct().withColumn("collapsed", F.size("witness") - 2)


def cluster_stats(edges: DataFrame, decls: DataFrame, by: str) -> DataFrame:
    """Per library or module: nodes, edges inside, edges in from others, edges out to others."""
    group = decls.select(F.col("name").alias("node"), F.col(by).alias("cluster"))
    # Edges meet their consumers' clusters and are counted; what meets the dependencies' clusters are counts.
    used = edges.join(group.withColumnsRenamed({"node": "dst", "cluster": "dc"}), "dst").groupBy("src", "dc").agg(F.count(F.lit(1)).alias("n"))
    pair = used.join(group.withColumnsRenamed({"node": "src", "cluster": "sc"}), "src").groupBy("sc", "dc").agg(F.sum("n").alias("n"))
    n, none, apart = F.col("n"), F.lit(None).cast("long"), F.col("sc") != F.col("dc")
    ends = F.array(
        F.struct(F.col("sc").alias("cluster"), F.when(~apart, n).alias("internal"), none.alias("incoming"), F.when(apart, n).alias("outgoing")),
        F.struct(F.col("dc").alias("cluster"), none.alias("internal"), F.when(apart, n).alias("incoming"), none.alias("outgoing")),
    )
    met = pair.select(F.inline(ends)).groupBy("cluster").agg(*[F.sum(x).alias(x) for x in ("internal", "incoming", "outgoing")])
    nodes = group.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(met, "cluster", "left").na.fill(0)


def promotion(edges: DataFrame, tagged: DataFrame, consumer_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(node, role, consumers): tagged nodes that untagged ones use (boundary), and the tagged nodes below those (support).

    With ``consumer_prefixes`` only consumers whose names begin with one of them count; the
    prefixes are raw, not dotted.
    """
    inside = edges.join(tagged.select(F.col("node").alias("src")), "src", "left_semi")
    used = inside.join(tagged.select(F.col("node").alias("dst")), "dst", "left_anti")
    if consumer_prefixes:
        used = used.where(reduce(lambda a, b: a | b, [F.col("dst").startswith(p) for p in consumer_prefixes]))
    boundary = materialise(used.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("consumers")), "boundary")
    both = inside.join(tagged.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    below = graph.closure(both, boundary.select("node")).select("node").join(boundary, "node", "left_anti")
    return boundary.withColumn("role", F.lit("boundary")).select("node", "role", "consumers").unionByName(below.select("node", F.lit("support").alias("role"), F.lit(0).cast("long").alias("consumers")))
