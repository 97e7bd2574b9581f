"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length 1; equal ones are one node.  Nodes are projected,
once for each curve, on a few random orthogonal directions; the projections,
shifted by a random offset, go through a Hilbert curve, whose key orders the
nodes.  Only keys are ranked.  Each order is laid out in blocks of about
``block_bytes`` of vectors, to which the margins of the blocks beside them
come; a node is compared with all nodes within ``reach`` places of it, the best
k of each curve are kept with their exact cosines, and the curves' lists merge
into one.

How far neighbours lie apart in the orders depends on the data and its size,
so it is measured: for a bounded sample of queries the true neighbours come
from an exact scan of all nodes, and their places in every order are compared
with the query's.  For 8, 16 and so on to ``curves`` curves that gives the
``reach`` that finds a share ``recall`` of them; the number of curves that costs
least in comparisons and copies is taken.

Defined cases: null vectors, vectors of length 0 or with null or non-finite
numbers, and rows with a null id are left out; rows with equal vectors are each
other's neighbours, at cosine 1; rows that share an id count once (the smallest
vector); of equal cosines (to six decimals) the smaller id comes first; k or
more rows give k neighbours each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, ensure_columns

BITS = 4
AXES = 12


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve (Skilling's transform) of rows of integers below 2**bits."""
    x = x.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), one << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def _frames(dims: int, curves: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    axes = min(AXES, dims)
    turns = [np.linalg.qr(rng.normal(size=(dims, axes)))[0].astype(np.float32) for _ in range(curves)]
    return turns, [rng.uniform(0, 1, axes).astype(np.float32) for _ in range(curves)]


def _keys(x: np.ndarray, dims: int, curves: int, seed: int) -> np.ndarray:
    """(rows x curves); unit vectors' projections have a spread of about dims ** -0.5, four of which the grid covers on each side, plus the shift."""
    turns, shifts = _frames(dims, curves, seed)
    half, out = 3.0 / np.sqrt(dims), np.zeros((len(x), curves), dtype=np.int64)
    for c in range(curves):
        y = (x @ turns[c] / half + 1) / 2  # about 0 .. 1
        z = np.clip((y + shifts[c] / 2) / 1.5 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
        out[:, c] = hilbert(z, BITS).view(np.int64)
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dims) if len(column) else np.zeros((0, dims), np.float32)


def _top(sim: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and cosine of each row's k best others; of equal cosines at the edge the smaller ids."""
    k = min(k + 1, sim.shape[1])  # one may be the row itself
    cols = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(sim, cols, axis=1).min(axis=1)
    for r in np.flatnonzero((sim >= edge[:, None]).sum(axis=1) > k):
        tied = np.flatnonzero(sim[r] >= edge[r])
        cols[r] = tied[np.lexsort((ids[tied], -sim[r, tied]))[:k]]
    rows = np.repeat(np.arange(len(sim)), k)
    cols = cols.ravel()
    ok = ids[cols] != own[rows]
    return rows[ok], ids[cols[ok]], sim[rows[ok], cols[ok]]


def _ranked(df: DataFrame) -> DataFrame:
    """curve, id, place: the node's number in the order of (key, id) of its curve, without sorting a curve on one task."""
    held = cut(df.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id").withColumn("part", F.spark_partition_id()), "curves")
    counts = held.groupBy("curve", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("curve").orderBy("part")) - F.col("count")).select("curve", "part", "before")
    place = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "id")) - 1
    return held.withColumn("place", place).join(F.broadcast(before), ["curve", "part"]).select("curve", "id", (F.col("place") + F.col("before")).alias("place"))  # a row a curve and partition


def _packed(own: np.ndarray, other: np.ndarray, cos: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Each node's list as two binaries; a node's rows follow each other."""
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    ends = np.append(first, len(own)).astype(np.int64)
    binary = lambda x, width: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends * width), pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
    return pa.array(own[first]), binary(other.astype(np.int64), 8), binary(cos.astype(np.float32), 4)


def _merged(k: int):
    """Lists (id, others, cos) in the order of id -> the k best of all of a node's lists."""

    def decide(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        lists = t.column("others").to_pylist()
        other, cos = np.frombuffer(b"".join(lists), np.int64), np.round(np.frombuffer(b"".join(t.column("cos").to_pylist()), np.float32).astype(float), 6)
        own = np.repeat(np.asarray(t.column("id").combine_chunks()), [len(x) // 8 for x in lists])
        order = np.lexsort((-cos, other, own))
        own, other, cos = own[order], other[order], cos[order]
        once = np.concatenate([[True], (own[1:] != own[:-1]) | (other[1:] != other[:-1])]) if len(own) else np.zeros(0, bool)
        own, other, cos = own[once], other[once], cos[once]
        order = np.lexsort((other, -cos, own))
        own, other, cos = own[order], other[order], cos[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        keep = rank < k
        return pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(other[keep]), pa.array(cos[keep])], names=["node", "twin", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("id"))
            stop = int(np.searchsorted(ids, ids[-1]))  # the last node may go on in the next batch
            if stop:
                yield decide([*held, batch.slice(0, stop)])
                held = []
            elif held and held[-1].column("id")[0].as_py() != ids[0]:
                yield decide(held)
                held = []
            held.append(batch.slice(stop))
        if held:
            yield decide(held)

    return run


#: what shipping a vector to a block costs, in comparisons
COPY = 500
CHUNK = 128


def plan_windows(gaps: np.ndarray, total: int, block: int, recall: float, k: int) -> tuple[int, int]:
    """Curves and reach of least cost, from the gaps (neighbour pairs x curves) of the sample."""
    best = None
    sizes = [c for c in (8, 16, 32, 64, 128) if c < gaps.shape[1]] + [gaps.shape[1]]
    for curves in sizes:
        near = np.sort(gaps[:, :curves].min(axis=1)) if len(gaps) else np.ones(1)
        reach = int(min(total, near[min(len(near) - 1, int(np.ceil(recall * len(near))))] + k))
        cost = curves * (2 * reach + CHUNK + COPY * (1 + 2 * reach / max(block, reach)))
        if best is None or cost < best[0]:
            best = (cost, curves, reach)
    return best[1], best[2]


def neighbours(vectors: DataFrame, k: int = 10, curves: int = 32, recall: float = 0.95, sample: int = 256, block_bytes: int = 4 << 20, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, neighbour, rank (1 .. k) and cosine: every row is a query."""
    ensure_columns(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    empty = "vec_id long, neighbour long, rank int, cosine double"
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    good = good.groupBy("id").agg(F.min("v").alias("v")).where("exists(v, x -> x <> 0)")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist() if len(set(batch.column(1).value_lengths().to_pylist())) > 1 else np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            out = [np.asarray(v) / np.abs(v).max() for v in rows]
            out = [(v / np.linalg.norm(v)).astype(np.float32) + np.float32(0) for v in out]  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in out], pa.int32()), pa.array([v.tobytes() for v in out], pa.binary())], names=["id", "d", "v"])

    members = cut(good.mapInArrow(unit, "id long, d int, v binary"), "unit-vectors")
    sizes = [r["d"] for r in members.select("d").distinct().collect()]
    if not sizes:
        return spark.createDataFrame([], empty)
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    dims = sizes[0]
    nodes = cut(members.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "nodes")
    total = nodes.count()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_matrix(batch.column(1), dims), dims, curves, seed)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(keys), c, np.int32)), pa.array(keys[:, c])], names=["id", "curve", "key"])

    placed = cut(_ranked(nodes.mapInArrow(keyed, "id long, curve int, key long")), "places")
    queries = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    q_ids, q = np.array([r["id"] for r in queries]), np.frombuffer(b"".join(bytes(r["v"]) for r in queries), np.float32).reshape(-1, dims)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column(0))
                row, other, cos = _top(q @ _matrix(batch.column(1), dims).T, ids, q_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(other), pa.array(cos.astype(float))], names=["id", "other", "cos"])

    best = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    truth = nodes.mapInArrow(exact, "id long, other long, cos double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("id", "other")
    truth = cut(truth, "true-neighbours")  # sample * k rows
    apart = truth.join(placed.withColumnRenamed("place", "here"), "id").join(placed.select("curve", F.col("id").alias("other"), F.col("place").alias("there")), ["curve", "other"])
    rows = apart.groupBy("id", "other").agg(F.array_sort(F.collect_list(F.struct("curve", F.abs(F.col("here") - F.col("there")).alias("gap")))).alias("g")).select("g.gap").collect()
    block = max(1, block_bytes // (4 * dims))
    used, reach = plan_windows(np.array([r["gap"] for r in rows]).reshape(-1, curves), total, block, recall, k)
    block = max(block, reach)  # margins come from the blocks beside a block alone
    home, off = F.floor(F.col("place") / block), F.pmod(F.col("place"), F.lit(block))
    where = F.array_compact(F.array(home, F.when((off < reach) & (home > 0), home - 1), F.when(off >= block - reach, home + 1)))
    spread = placed.where(F.col("curve") < used).select("curve", "id", "place", home.alias("home"), F.explode(where).alias("block")).join(nodes, "id")

    def rerank(key, table):
        place = np.asarray(table.column("place").combine_chunks())
        order = np.argsort(place)
        place, home = place[order], np.asarray(table.column("home").combine_chunks())[order]
        ids, x = np.asarray(table.column("id").combine_chunks())[order], _matrix(table.column("v"), dims)[order]
        mine = np.flatnonzero(home == key[1].as_py())
        got: list[tuple] = []
        for i in range(0, len(mine), CHUNK):
            a, b = mine[i], mine[min(len(mine), i + CHUNK) - 1] + 1  # a home's places follow each other
            low, high = np.searchsorted(place, place[a] - reach), np.searchsorted(place, place[b - 1] + reach, side="right")
            row, other, cos = _top(x[a:b] @ x[low:high].T, ids[low:high], ids[a:b], k)
            got.append((ids[a:b][row], other, cos))
        own, other, cos = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return pa.table(dict(zip(("id", "others", "cos"), _packed(own, other, cos))))

    found = spread.groupBy("curve", "block").applyInArrow(rerank, "id long, others binary, cos binary")  # a row a node and curve
    lists = found.repartition("id").sortWithinPartitions("id").mapInArrow(_merged(k), "node long, twin long, cos double")
    return _expanded(lists, members.join(nodes.select(F.col("id").alias("node"), "v"), "v").select("id", "node"), k)


def _expanded(lists: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From nodes' lists (node, twin, cos) to those of their members (id, node): of each node only the k + 1 smallest ids can count."""
    members = cut(members, "members")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("node").alias("twin"), F.col("id").alias("other"))
    own = members.groupBy("node").count().where("count > 1").select("node", F.col("node").alias("twin"), F.lit(1.0).alias("cos"))
    near = Window.partitionBy("node").orderBy(F.desc("cos"), "other")
    best = lists.unionByName(own).join(first, "twin").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("node", "other", "cos")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))
    return members.join(best, "node").where("id <> other").withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour"), "rank", F.col("cos").alias("cosine"))
