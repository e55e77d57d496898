"""Graph operators as DataFrame fixpoints over an edge table (src, dst): dependency -> consumer.

Every round is one join with the edges and one anti-join with what is known; its state is
written to the shared scratch folder, so plans stay short and a lost executor re-reads
instead of re-running. Spark broadcasts a frontier only while its measured size allows it;
what is known takes part in every round, so a walk keeps it from the driver beyond a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise

#: Rows that a walk knows beyond which they are no longer broadcast round by round.
SENT = 1 << 16


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, distance) of everything reachable along edges from each seed (column ``node``, optional ``seed``), seeds at 0."""
    step = materialise(edges.select(F.col("src").alias("node"), "dst").distinct(), "steps")
    start = seeds if "seed" in seeds.columns else seeds.withColumn("seed", F.col("node"))
    front = materialise(start.select("seed", "node", F.lit(0).alias("distance")).distinct(), "walk")
    known, level, rows = front, 0, front.count()
    while depth is None or level < depth:
        level += 1
        reached = front.join(step, "node").select("seed", F.col("dst").alias("node")).distinct()
        past = known.select("seed", "node")
        front = materialise(reached.join(past if rows <= SENT else past.hint("merge"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(level)), "walk")
        new = front.count()
        if not new:
            break
        known, rows = known.unionByName(front), rows + new  # a scan of all levels' files
        if level % 12 == 0:
            known = materialise(known, "walk")
    return known


def closure(edges: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, distance): the ancestor closure of targets (column ``node``) with the least distance to any."""
    return walk(reverse(edges), targets.select("node", F.lit("*").alias("seed")), depth).select("node", "distance")


def ahead_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges on all ways that lead on from the starts (column ``node``).

    Every round keeps the edges of its frontier by a semi-join, so the edges themselves are neither moved nor written.
    """
    front = materialise(starts.select("node").distinct(), "ahead")
    known, found = front, materialise(edges.select("src", "dst").where(F.lit(False)), "ahead")
    while not front.isEmpty():
        out = materialise(edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct(), "ahead")
        found = found.unionByName(out)
        front = materialise(out.select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti"), "ahead")
        known = known.unionByName(front)
    return materialise(found, "ahead")


def leaves(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node): what targets (column ``node``) depend on, themselves included, that depends on nothing."""
    inside = ahead_of(reverse(edges), targets)
    held = targets.select("node").unionByName(inside.select(F.col("dst").alias("node"))).distinct()
    return held.join(inside.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose consumer is kept."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def witness_paths(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, path): the lexicographically least of the shortest paths from any seed; breadth first with sorted neighbours finds the same."""
    step = materialise(edges.select(F.col("src").alias("node"), "dst").distinct(), "steps")
    front = materialise(seeds.select("node", F.array("node").alias("path")), "paths")
    known, level = front, 0
    while depth is None or level < depth:
        level += 1
        found = front.join(step, "node").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        front = materialise(found.join(known.select("node"), "node", "left_anti"), "paths")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def nearest(edges: DataFrame, seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, node, distance): each seed's nearest node (least name on ties) among ``wanted``, the seed itself excluded.

    One search from all wanted nodes against the edges settles every node at once, each with the least name of those that
    reach it first, so the number of seeds doesn't matter. Only a wanted seed that a ring leads back to itself searches on its own.
    """
    step = materialise(edges.select(F.col("dst").alias("node"), F.col("src").alias("up")).distinct(), "steps")
    front = wanted.select("node", F.col("node").alias("target")).distinct()
    known, level = materialise(front.select("node", "target", F.lit(0).alias("distance")).where(F.lit(False)), "nearest"), 0
    while True:
        level += 1
        reached = front.join(step, "node").groupBy(F.col("up").alias("node")).agg(F.min("target").alias("target"))
        front = materialise(reached.join(known.select("node"), "node", "left_anti").withColumn("distance", F.lit(level)), "nearest")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    met = seeds.select("node").distinct().join(known, "node")
    found = met.where("node <> target").select(F.col("node").alias("seed"), F.col("target").alias("node"), "distance")
    rings = materialise(met.where("node = target").select("node"), "nearest")
    if rings.isEmpty():
        return found
    walked = walk(edges, rings).where("distance > 0").join(wanted.select("node"), "node", "left_semi")
    return found.unionByName(walked.groupBy("seed").agg(F.min(F.struct("distance", "node")).alias("m")).select("seed", "m.node", "m.distance"))


def peel(edges: DataFrame) -> DataFrame:
    """Edges that lie on or between cycles: nodes without a dependency or without a consumer are removed until none is left."""
    left = materialise(edges.select("src", "dst").where("src <> dst").distinct(), "peel")
    count = left.count()
    while count:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = materialise(inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "peel")
        now = inner.count()
        left = inner
        if now == count:
            break
        count = now
    return left


def _spread_least(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Fixpoint of label(dst) = min(label(dst), label(src))."""
    while True:
        offered = label.join(edges, label.node == edges.src).groupBy("dst").agg(F.min("label").alias("offer"))
        new = materialise(label.join(offered, label.node == offered.dst, "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("changed")), "spread")
        moved = not new.where("changed").isEmpty()
        label = new.select("node", "label")
        if not moved:
            return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their least node.

    Rounds of colouring: every node takes the least name that reaches it; those that also
    reach that name inside the colour are its component; they leave, the rest goes on.
    """
    left = peel(edges)
    done: DataFrame | None = None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = _spread_least(left, nodes.withColumn("label", F.col("node")))
        a, b = colour.alias("a"), colour.alias("b")
        inside = materialise(left.alias("e").join(a, F.col("e.src") == F.col("a.node")).join(b, F.col("e.dst") == F.col("b.node")).where("a.label = b.label").select("e.src", "e.dst"), "colour")
        roots = colour.where("node = label").select("node")
        back = walk(reverse(inside), roots).join(inside.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        found = materialise(back.select("node", F.col("seed").alias("component")).distinct(), "found")
        sized = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.join(sized.select("component"), "component", "left_semi").select("node", "component")
        done = found if done is None else done.unionByName(found)
        gone = back.select("node").unionByName(roots).distinct()
        rest = left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = peel(rest.select("src", "dst"))
    return done if done is not None else left.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def condense(edges: DataFrame, component: DataFrame) -> DataFrame:
    """Edges between components (a node outside any is its own)."""
    s, d = component.select(F.col("node").alias("src"), F.col("component").alias("sc")), component.select(F.col("node").alias("dst"), F.col("component").alias("dc"))
    both = edges.join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("sc", "src").alias("src"), F.coalesce("dc", "dst").alias("dst"))
    return both.where("src <> dst").distinct()


def layers(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest path to each node of an acyclic graph, sources at 0.

    Each round gives a depth to the nodes whose dependencies all have one, so that every edge
    is read once as long as its source is on the frontier.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "layers")
    front = materialise(edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)), "layers")
    open_ = materialise(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("left")), "layers")
    known, level = front, 0
    while not front.isEmpty():
        level += 1
        met = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        rest = materialise(open_.join(met, "node", "left").select("node", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "layers")
        front = rest.where("left = 0").select("node", F.lit(level).alias("depth"))
        open_ = rest.where("left > 0")
        known = known.unionByName(front)
    return known


def dag_reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph without those that a longer path implies."""
    edges = materialise(edges.select("src", "dst").distinct(), "reduce")
    via = edges.select(F.col("src").alias("u"), F.col("dst").alias("node"))
    # only nodes that start a detour: successors of a node with several
    forks = via.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    via = via.join(forks, "u", "left_semi")
    starts = via.select("node").distinct()
    reach = walk(edges, starts).where("distance > 0").select(F.col("seed").alias("node"), F.col("node").alias("v"))
    implied = via.join(reach, "node").select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    return edges.join(implied, ["src", "dst"], "left_anti")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """All edges inside components, and for each kept edge between components its least representative."""
    component = components(edges)
    s, d = component.select(F.col("node").alias("src"), F.col("component").alias("sc")), component.select(F.col("node").alias("dst"), F.col("component").alias("dc"))
    named = edges.join(s, "src", "left").join(d, "dst", "left").select("src", "dst", F.coalesce("sc", "src").alias("sc"), F.coalesce("dc", "dst").alias("dc"))
    inner = named.where("sc = dc and src <> dst").select("src", "dst")
    least = named.where("sc <> dc").groupBy("sc", "dc").agg(F.min(F.struct("src", "dst")).alias("e"))
    kept = dag_reduction(least.select(F.col("sc").alias("src"), F.col("dc").alias("dst")))
    outer = least.join(kept, (least.sc == kept.src) & (least.dc == kept.dst), "left_semi").select("e.src", "e.dst")
    return inner.unionByName(outer)


def projected_reduction(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(src, dst, distance): reachability among kept nodes, reduced, with the length of a shortest witness."""
    among = walk(edges, keep).where("distance > 0").join(keep.select("node"), "node", "left_semi").select(F.col("seed").alias("src"), F.col("node").alias("dst"), "distance")
    among = materialise(among, "project")
    kept = transitive_reduction(among.select("src", "dst"))
    return among.join(kept, ["src", "dst"], "left_semi")
