"""Clustering against plain rounds over every vector and centroid, in Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=cc.K, rounds=cc.ROUNDS, dimensions=cc.DIMENSIONS):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    rank = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    c = [list(v) for _, _, v in rank[:k]]
    apart = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z))
    nearest = lambda v: min(range(len(c)), key=lambda j: (apart(v, c[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, j, apart(v, c[j])) for i, v in kept for j in [nearest(v)]]
    total = sum(d for _, _, d in out)
    return sorted(((-1 if i is None else i), j, d, sum(e for _, o, e in out if o == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out)


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(n, seed=3, dimensions=cc.DIMENSIONS, spread=0.3):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dimensions)] for _ in range(12)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(middles)]) for i in range(n)]


def test_against_plain(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(300)
    rows += [(i, rows[5][1]) for i in range(300, 330)] + [(3, rows[3][1]), (None, rows[7][1]), (None, [0.0] * 64), (400, [nan] + [0.0] * 63), (401, [inf] * 64), (402, [0.0] * 63), (403, None), (404, [None] + [1.0] * 63), (405, [0.0] * 64), (406, [-1e-3] * 64)]
    assert found(cc.cluster(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = vectors(n) + [(90, None)]
    assert found(cc.cluster(spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")))) == plain(rows)


def test_ties_and_large_components(spark):
    """Points midway between centroids, and components whose products leave the doubles' exact range."""
    rows = [(i, [float((i * 7 + j) % 3) * 2 for j in range(64)]) for i in range(120)]
    assert found(cc.cluster(spark.createDataFrame(rows, SCHEMA), k=4)) == plain(rows, k=4)
    rows = [(i, [x * 60_000 for x in e]) for i, e in vectors(200)]
    assert found(cc.cluster(spark.createDataFrame(rows, SCHEMA), k=9)) == plain(rows, k=9)
    rows += [(999, [3e5] * 64)]  # beyond LIMIT: left out
    assert found(cc.cluster(spark.createDataFrame(rows, SCHEMA), k=9)) == plain(rows[:-1], k=9)


def test_whole_nodes_are_assigned_and_strictly_dominated_centroids_pruned():
    r = np.random.default_rng(1)
    middles = r.integers(-2000, 2000, (6, 64))
    points = np.concatenate([m + r.integers(-9, 10, (200, 64)) for m in middles])
    order, nodes = cc.build(points)
    tree = cc.Tree({"width": 4, "points": points[order].astype("<i4").tobytes(), "low": nodes["low"].astype("<i4").tobytes(), "high": nodes["high"].astype("<i4").tobytes(), "sums": nodes["sums"].tobytes(), "spans": nodes["spans"].tobytes()}, 64)
    assert (tree.sums[0] == points.sum(0)).all() and sorted(order) == list(range(len(points)))
    step = cc.Filter(middles)
    whole, of, leaves, left = step.settle(tree)
    at, place = step.members(tree, whole)
    assert len(whole) < 60 and len(at) > 0.8 * len(points) and (of[place] == step.nearest(tree.points[at])[0]).all()
    # Boxes that hold vectors of two groups go down to their leaves.
    at, place = step.members(tree, leaves)
    assert (step.nearest(tree.points[at], left[place])[0] == step.nearest(tree.points[at])[0]).all()
    # Two equal centroids never dominate each other: every vector is resolved, to the smaller number.
    step = cc.Filter(np.concatenate([middles[:1], middles[:1]]))
    whole, of, leaves, left = step.settle(tree)
    assert not len(whole) and left.all()
    ends = tree.spans[leaves]
    assert sorted(x for first, end, _ in ends for x in range(first, end)) == list(range(len(points)))


def test_sql_gives_the_same(spark, tmp_path):
    rows = vectors(150, seed=8)
    docs = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("given", docs.toArrow())
    con.sql("CREATE VIEW embeddings AS SELECT * FROM given")
    assert sorted(tuple(r) for r in con.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({cc.ORACLE})").fetchall()) == plain(rows)


def test_blocks(spark, monkeypatch):
    """A partition of several blocks, and boxes that hold equal vectors only."""
    rows = vectors(500, seed=4) + [(1000 + i, [1.0] * 64) for i in range(200)]
    given = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    batches = cc.whole_vectors(given).toArrow().to_batches(max_chunksize=37)
    monkeypatch.setattr(cc, "BLOCK", 100)
    blocks = list(cc._trees(iter(batches)))
    assert [len(b.column("ids")[0]) for b in blocks] == [100] * 7
    assert sorted(i for b in blocks for i in b.column("ids")[0].as_py()) == sorted(i for i, _ in rows)
