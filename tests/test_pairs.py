"""What two owners have in common, against plain sets."""

import random

import pytest

from ledgerline.operators import headlines, modules, pairs


def plain(rows):
    held = {}
    for owner, node, distance in rows:
        if owner is not None and node is not None:
            mine = held.setdefault(owner, {})
            mine[node] = min(distance, mine.get(node, distance))
    out = set()
    for a in held:
        for b in held:
            both = set(held[a]) & set(held[b])
            if a < b and both:
                node = min(both, key=lambda n: (max(held[a][n], held[b][n]), held[a][n] + held[b][n], n))
                out.add((a, b, node, held[a][node], held[b][node], len(both)))
    return out


@pytest.mark.parametrize(("owners", "fewest"), [(1, 64), (40, 3), (40, 64), (25, 2)])
def test_pairs_of_random_owners(spark, monkeypatch, owners, fewest):
    draw = random.Random(owners + fewest)
    rows = [(f"o{draw.randrange(owners)}{draw.choice(['', 'ä', 'Z'])}", f"n{int(draw.random() ** 3 * 60)}", draw.randrange(9)) for _ in range(400)] + [(None, "n1", 1), ("o1", None, 1)]
    monkeypatch.setattr(pairs, "FEWEST", fewest)
    got = pairs.common(spark.createDataFrame(rows, "owner string, node string, distance int"), nearest=True).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_dense_and_thin_nodes_count_alike(monkeypatch):
    import pyarrow as pa

    draw = random.Random(5)
    rows = sorted({(f"o{draw.randrange(30)}", f"n{int(draw.random() ** 2 * 40)}"): draw.randrange(5) for _ in range(500)}.items())
    table = pa.table({"owner": [k[0] for k, _ in rows], "node": [k[1] for k, _ in rows], "distance": pa.array([d for _, d in rows], pa.int32())})
    body = pairs._packed((pa.scalar(0),), table)["body"][0]
    found = []
    for dense, wide in ((1, 7), (1 << 12, 5), (50, 64), (1 << 12, 1 << 21)):
        monkeypatch.setattr(pairs, "DENSE", dense)
        monkeypatch.setattr(pairs, "WIDE", wide)
        batches = pairs._pairs(True)(iter([pa.RecordBatch.from_arrays([pa.array([body.as_py()]), pa.array([None], pa.binary())], names=["l", "r"])]))
        found.append(sorted(tuple(r.values()) for b in batches for r in b.to_pylist()))
    assert found[0] == sorted(plain([(*k, d) for k, d in rows])) and all(f == found[0] for f in found)


def test_no_row_for_a_pair_and_node_is_joined(spark):
    walked = spark.createDataFrame([(f"c{i}", f"n{j}", j + 1) for i in range(30) for j in range(10)], "claim string, node string, distance int")
    closed = walked.withColumnRenamed("claim", "seed")
    for found in (headlines.headline_pairs(walked), modules.closure_overlap(closed)):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.where("common = 10").count() == 435


def test_nothing_in_common(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "owner string, node string, distance int")
    assert pairs.common(rows).collect() == [] and pairs.common(rows.limit(0), nearest=True).collect() == []
