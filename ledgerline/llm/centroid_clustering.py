"""Centroid clustering with kd-tree filtering, in whole numbers.

Vectors become integers floor(SCALE * x). Each task cuts its partition into blocks and builds a
kd-tree over each: a node holds its count, the exact sums of its vectors' components and its
bounding box. The trees are written once, next to the vectors; every round only sends them the
centroids.

A round filters: a node keeps the centroids that may be nearest somewhere in its box. Of these, the
one nearest to the middle of the box strictly dominates another when every point of the box is
nearer to it, which the box's corner farthest in the other's direction decides; what is strictly dominated
is pruned, so ties survive. A node with one centroid left is assigned whole, by its count and
sums; leaves with more are resolved vector by vector, ties to the smaller number. New centroids are exact
floors of sums by counts.

Arithmetic is exact: in doubles while all products stay below 2^53, else in 64-bit integers.

Scale: one pass writes the trees (two bytes a component where values fit). A round reads them, moves at
most one row per task and centroid, and collects one row per centroid. The centroids are the
only thing broadcast: K * DIMENSIONS numbers. A lost executor costs a re-read of its blocks.

Defined cases: rows whose embedding is null, has another number of components, or a null, NaN or infinite
one are left out, and so are those with a component beyond LIMIT, as their distances would not fit a
long; a null vec_id stays null and starts a centroid only where fewer than K ids are there; repeated rows count each;
fewer than K vectors start as many centroids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship

DIMENSIONS, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Largest magnitude of an integer component.
LIMIT = 1 << 26
#: Factors up to here keep sums of 64 products exact in doubles.
EXACT = 1 << 23
BLOCK, LEAF = 4096, 48
TREE = "ids array<long>, width int, points binary, spans binary, low binary, high binary, sums binary"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    good = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    given = vectors.where(F.coalesce(good & F.forall("embedding", lambda x: F.abs(x.cast("double")) * SCALE < LIMIT), F.lit(False)))
    return given.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<long>").alias("v"))


def first_centroids(whole: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order; vectors settle ties."""
    rank = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    top = whole.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    return np.array([r.v for r in top], np.int64)


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the points, and the nodes of a kd-tree over them: spans (first, end, left child or -1; the right one follows it), boxes and sums."""
    order = np.arange(len(points))
    spans, low, high, sums = [[0, len(points), -1]], [], [], []
    at = 0
    while at < len(spans):
        first, end, _ = spans[at]
        mine = points[order[first:end]]
        low.append(mine.min(0))
        high.append(mine.max(0))
        sums.append(mine.sum(0))
        width = high[-1] - low[-1]
        if end - first > LEAF and width.max() > 0:
            middle = (end - first) // 2
            order[first:end] = order[first:end][np.argpartition(mine[:, int(width.argmax())], middle)]
            spans[at][2] = len(spans)
            spans += [[first, first + middle, -1], [first + middle, end, -1]]
        at += 1
    return order, {"spans": np.array(spans, np.int32), "low": np.array(low), "high": np.array(high), "sums": np.array(sums)}


def _narrow(points: np.ndarray) -> int:
    peak = int(np.abs(points).max()) if points.size else 0
    return 2 if peak < 1 << 15 else 4


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of a task's vectors."""

    def block(ids, points):
        order, nodes = build(points)
        width = _narrow(points)
        kind = f"<i{width}"
        row = {"ids": [pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], "width": [width], "points": [points[order].astype(kind).tobytes()], "spans": [nodes["spans"].tobytes()]}
        row |= {"low": [nodes["low"].astype(kind).tobytes()], "high": [nodes["high"].astype(kind).tobytes()], "sums": [nodes["sums"].astype("<i8").tobytes()]}
        return pa.RecordBatch.from_pydict(row, pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), *((n, pa.binary()) for n in ("points", "spans", "low", "high", "sums"))]))

    ids, points, held = [], [], 0
    for batch in batches:
        n = batch.num_rows
        values = batch.column("v").flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1), np.int64)
        at = 0
        while at < n:
            take = min(n - at, BLOCK - held)
            ids.append(batch.column("vec_id").slice(at, take))
            points.append(values[at : at + take])
            held, at = held + take, at + take
            if held == BLOCK:
                yield block(ids, np.concatenate(points))
                ids, points, held = [], [], 0
    if held:
        yield block(ids, np.concatenate(points))


class Tree:
    """A block as it was written."""

    def __init__(self, row: dict, dimensions: int):
        kind = f"<i{row['width']}"
        table = lambda name, k, width: np.frombuffer(row[name], k).reshape(-1, width)
        self.points, self.low, self.high = (table(n, kind, dimensions).astype(np.int64) for n in ("points", "low", "high"))
        self.sums, self.spans = table("sums", "<i8", dimensions), table("spans", "<i4", 3).astype(np.int64)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exact."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if peak <= EXACT and x.shape[1] <= 64:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


class Filter:
    """The filtering step for one set of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.square = (centroids * centroids).sum(1)
        self.apart = np.abs(centroids[:, None, :] - centroids[None, :, :])

    def prune(self, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of the candidates left at each box (boxes x centroids), those that aren't strictly dominated."""
        toward = _products(low + high, self.c)
        # The squared distance from the middle, less what all centroids share.
        best = np.where(left, self.square - toward, np.iinfo(np.int64).max).argmin(1)
        # |z-x|^2 - |b-x|^2 at the corner of the box where it is least, for candidate z and the best b.
        corner = np.empty_like(toward)
        for b in np.unique(best):
            at = best == b
            corner[at] = self.square - self.square[b] - (toward[at] - toward[at, b][:, None]) - _products((high - low)[at], self.apart[b])
        return left & (corner <= 0)

    def nearest(self, points: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest of the candidates left and its squared distance; ties to the smaller number."""
        far = self.square - 2 * _products(points, self.c)
        if left is not None:
            far = np.where(left, far, np.iinfo(np.int64).max)
        at = far.argmin(1)
        return at, far[np.arange(len(at)), at] + (points * points).sum(1)

    def settle(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes assigned whole, their centroids, leaves left to resolve, their candidates)."""
        node, left = np.zeros(1, np.int64), np.ones((1, len(self.c)), bool)
        whole, of, leaves, open_to = [], [], [], []
        while len(node):
            left = self.prune(tree.low[node], tree.high[node], left)
            one = left.sum(1) == 1
            whole.append(node[one])
            of.append(left[one].argmax(1))
            child = tree.spans[node, 2]
            end = ~one & (child < 0)
            leaves.append(node[end])
            open_to.append(left[end])
            on = ~one & (child >= 0)
            node, left = np.concatenate([child[on], child[on] + 1]), np.concatenate([left[on], left[on]])
        return tuple(np.concatenate(x) for x in (whole, of, leaves, open_to))

    def members(self, tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' vectors, and for each the place of its node in the list."""
        first, n = tree.spans[nodes, 0], tree.spans[nodes, 1] - tree.spans[nodes, 0]
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), np.repeat(np.arange(len(nodes)), n)


def _rows(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[dict, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
            yield row | {"ids": batch.column("ids")[i].values}, Tree(row, dimensions)


def _sums(filter_of, dimensions: int):
    """(cluster, n, sums), one row per task and centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Filter(filter_of.value)
        k = len(step.c)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, tree in _rows(batches, dimensions):
            whole, of, leaves, left = step.settle(tree)
            np.add.at(n, of, tree.spans[whole, 1] - tree.spans[whole, 0])
            np.add.at(sums, of, tree.sums[whole])
            at, place = step.members(tree, leaves)
            if len(at):
                points = tree.points[at]
                cluster, _ = step.nearest(points, left[place])
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, points)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(filter_of, dimensions: int):
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Filter(filter_of.value)
        for row, tree in _rows(batches, dimensions):
            whole, of, leaves, left = step.settle(tree)
            cluster, distance = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64)
            at, place = step.members(tree, whole)
            cluster[at] = of[place]
            apart = tree.points[at] - step.c[of[place]]
            distance[at] = (apart * apart).sum(1)
            at, place = step.members(tree, leaves)
            if len(at):
                cluster[at], distance[at] = step.nearest(tree.points[at], left[place])
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def move(spark: SparkSession, trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those without vectors stay."""
    dimensions = centroids.shape[1]
    of = spark.sparkContext.broadcast(centroids)
    parts = trees.select("width", "ids", "points", "spans", "low", "high", "sums").mapInArrow(_sums(of, dimensions), "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimensions)]).alias("sums")).collect()
    moved = centroids.copy()
    for r in totals:
        moved[r.cluster] = [s // r.n for s in r.sums]
    of.unpersist()
    return moved


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    ship(spark)
    whole = whole_vectors(vectors, dimensions)
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).where(F.lit(False))
    trees = materialise(whole.mapInArrow(_trees, TREE), "op12-trees")
    for _ in range(rounds):
        moved = move(spark, trees, centroids)
        if (moved == centroids).all():
            break  # the rounds left change nothing
        centroids = moved
    of = spark.sparkContext.broadcast(centroids)
    assigned = materialise(trees.mapInArrow(_assigned(of, dimensions), "vec_id long, cluster int, distance long"), "op12-assigned")
    # One row per centroid.
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds unrolled: every vector against every centroid."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    near = lambda c: f"SELECT vec_id, v, k, {apart} AS d FROM kept, {c}"
    least = lambda c: f"SELECT vec_id, v, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM ({near(c)}) GROUP BY vec_id, v"
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS k, v AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT 40)",
    ]
    for r in range(ROUNDS):
        sums = f"SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM ({least(f'c{r}')}), range(1, 65) AS t(i) GROUP BY k, i"
        floors = f"SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM ({sums}) GROUP BY k"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} AS o LEFT JOIN ({floors}) AS m USING (k))")
    steps.append(f"last AS MATERIALIZED ({least(f'c{ROUNDS}')})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(list_transform(c, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} USING (k)"""


ORACLE = _oracle()
