"""What every two owners of nodes have in common, without a row for each pair and node.

Owners are dealt over blocks of bounded size, and a block's rows are packed into one value. Every two blocks meet in one row, whose pairs are
counted in arrays of owners by owners and leave as results. What is shuffled is every block once for each block and no row per pair; the results themselves grow with the square of the owners.

Defined cases: rows without owner or node are left out, nodes of a single owner are no one's in common, a row that repeats counts once (its least distance).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise, ship

#: Owners and rows that a block holds on average, and the owners below which no further block is made for the sake of more tasks.
OWNERS, ROWS, FEWEST = 2048, 1 << 20, 64
#: Pairs that one array operation handles, and rows in a batch of results.
WIDE, BATCH = 1 << 21, 1 << 16
#: A node that fewer pairs share is handled together with others.
DENSE = 1 << 12
NONE = np.iinfo(np.int64).max


def _blocks(owners: int, rows: int, cores: int) -> int:
    spread = min(-(-owners // FEWEST), int(np.ceil(np.sqrt(6 * cores))))
    return max(1, -(-owners // OWNERS), -(-rows // ROWS), spread)


def _packed(block: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block: its rows as an Arrow stream, owners and nodes dictionary-encoded."""
    told = pa.table({"owner": rows["owner"].combine_chunks().dictionary_encode(), "node": rows["node"].combine_chunks().dictionary_encode(), "distance": rows["distance"]}).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, told.schema) as out:
        out.write_table(told)
    return pa.table({"block": pa.array([block[0].as_py()], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary())})


class _Side:
    """A block: names of owners and nodes, and per row the owner, the node and the distance."""

    def __init__(self, body: pa.Scalar):
        rows = pa.ipc.open_stream(body.as_buffer()).read_all()
        owner, node = rows["owner"].combine_chunks(), rows["node"].combine_chunks()
        owner, node = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (owner, node))
        self.names, self.nodes = owner.dictionary, node.dictionary
        self.owner, self.node = owner.indices.to_numpy().astype(np.int64), node.indices.to_numpy()
        self.distance = rows["distance"].to_numpy().astype(np.int64)

    def by(self, shared: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners and distances by place of the node among the shared ones; where each node begins."""
        place = pc.fill_null(pc.index_in(self.nodes, shared), -1).to_numpy(zero_copy_only=False)[self.node]
        order = np.argsort(place, kind="stable")[np.count_nonzero(place < 0) :]
        return self.owner[order], self.distance[order], np.searchsorted(place[order], np.arange(len(shared) + 1))


def _meet(left: _Side, right: _Side, nearest: bool) -> tuple[np.ndarray, np.ndarray | None, pa.Array, int, int]:
    """How many nodes each two owners share; the least key of these nodes, made of the greater distance, the lesser one, the node's place, and which is the greater."""
    shared = left.nodes.filter(pc.is_in(left.nodes, right.nodes))
    shared = shared.take(pc.sort_indices(shared))
    (lo, ld, la), (ro, rd, ra) = left.by(shared), right.by(shared)
    common = np.zeros((len(left.names), len(right.names)), np.int32)
    best = np.full(common.shape, NONE) if nearest else None
    far = int(max(ld.max(initial=0), rd.max(initial=0))).bit_length()
    place = len(shared).bit_length()
    if nearest and 2 * far + place + 1 > 63:
        raise ValueError("distances are too great to be compared")

    def key(a, b, n):
        return (((np.maximum(a, b) << far | np.minimum(a, b)) << place | n) << 1) | (a > b)

    ln, rn = np.diff(la), np.diff(ra)
    for n in np.flatnonzero(ln * rn >= DENSE):
        a, b = slice(la[n], la[n + 1]), slice(ra[n], ra[n + 1])
        step = max(1, WIDE // int(rn[n]))
        for k in range(a.start, a.stop, step):
            some = slice(k, min(k + step, a.stop))
            at = np.ix_(lo[some], ro[b])
            common[at] += 1
            if nearest:
                best[at] = np.minimum(best[at], key(ld[some, None], rd[None, b], n))
    thin = np.flatnonzero(ln * rn < DENSE)
    ends = np.cumsum(ln[thin] * rn[thin])
    cut = np.searchsorted(ends, np.arange(WIDE, int(ends[-1]) + WIDE, WIDE), side="left") + 1 if len(ends) else []
    for nodes in np.split(thin, cut):
        size = ln[nodes] * rn[nodes]
        n = np.repeat(nodes, size)
        k = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
        i, j = la[n] + k // rn[n], ra[n] + k % rn[n]
        at = lo[i] * common.shape[1] + ro[j]
        np.add.at(common.reshape(-1), at, 1)
        if nearest:
            np.minimum.at(best.reshape(-1), at, key(ld[i], rd[j], n))
    return common, best, shared, far, place


def _pairs(nearest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r in zip(batch["l"], batch["r"], strict=True):
                left = _Side(l)
                right = _Side(r) if r.is_valid else left
                common, best, shared, far, place = _meet(left, right, nearest)
                names = pa.concat_arrays([left.names, right.names])
                rank = np.empty(len(names), np.int64)
                rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                if right is left:
                    rank = rank[: len(left.names)]
                    common[rank[:, None] >= rank[None, :]] = 0
                    rank = np.concatenate([rank, rank])
                step = max(1, BATCH // max(1, common.shape[1]))
                for k in range(0, len(common), step):
                    x, y = np.nonzero(common[k : k + step])
                    x += k
                    if not len(x):
                        continue
                    first, second = x, y + len(left.names)
                    swap = rank[first] > rank[second]
                    a, b = np.where(swap, second, first), np.where(swap, first, second)
                    columns = {"a": names.take(pa.array(a)), "b": names.take(pa.array(b))}
                    if nearest:
                        least = best[x, y]
                        greater = least & 1 == 1
                        node, pair = (least >> 1) & ((1 << place) - 1), least >> (1 + place)
                        high, low = pair >> far, pair & ((1 << far) - 1)
                        columns["node"] = shared.take(pa.array(node))
                        columns["da"] = pa.array(np.where(greater ^ swap, high, low).astype(np.int32))
                        columns["db"] = pa.array(np.where(greater ^ swap, low, high).astype(np.int32))
                    columns["common"] = pa.array(common[x, y].astype(np.int64))
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def common(rows: DataFrame, nearest: bool = False) -> DataFrame:
    """(a, b, common) for every two owners a < b with a node in common (columns owner, node, distance), and how many they have.

    With ``nearest`` also node, da and db: the common node of least greater distance, then least sum, then least name.
    """
    spark = rows.sparkSession
    ship(spark)
    told = rows.where("owner is not null and node is not null").groupBy("owner", "node").agg(F.min("distance").cast("int").alias("distance"))
    met = told.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    told = materialise(told.join(met, "node", "left_semi").select("owner", "node", "distance"), "owned")
    owners, size = told.agg(F.count_distinct("owner"), F.count(F.lit(1))).first()
    blocks = _blocks(owners, size, spark.sparkContext.defaultParallelism)
    dealt = told.select(F.pmod(F.xxhash64("owner"), F.lit(blocks)).alias("block"), "owner", "node", "distance")
    packed = materialise(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_packed, "block long, body binary"), "blocks")
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    own, other = F.col("block"), F.col("other")
    sent = packed.select("block", "body", one).select(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own <= other, F.col("body")).alias("l"), F.when(own > other, F.col("body")).alias("r"))
    pairs = blocks * (blocks + 1) // 2
    both = sent.repartition(min(pairs, 1 << 13), "i", "j").groupBy("i", "j").agg(F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"))
    # A block that was dealt no owner meets none.
    both = both.where("l is not null and (i = j or r is not null)")
    return both.select("l", "r").mapInArrow(_pairs(nearest), "a string, b string, " + ("node string, da int, db int, " if nearest else "") + "common long")
