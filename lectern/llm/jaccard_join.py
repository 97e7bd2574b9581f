"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of word n-grams (lower case, split at white space).  One
pass makes a MinHash signature for each.  Rows with the same token sequence
are one *node*; nodes that share a band of the signature are candidates.  A
candidate's signatures are compared a block at a time, and it is dropped once
the posterior probability (uniform prior, binomial likelihood) that its
similarity reaches the threshold is under the tolerance; what is left is
verified on the exact n-gram sets.

Candidates never become rows before they are pruned: a bucket (the nodes of one
band) is compared where its signatures meet, in tiles of bounded size.  Nodes
that are near beyond doubt are tied to a leader, so that a cluster of n near
copies costs about n comparisons; across what isn't tied, every pair that the
posterior leaves is given out, in the first band that the two share.  Should an
exact check break a tie, its buckets are compared again in full.  The links
found so make the classes: their connected components are those of all links.

Pairs meet their sets by *hub*: a node's hub is its smallest candidate
partner, and a pair is handled where the smaller of its two hubs is, so the
members of a cluster are sent there about once rather than once a pair.  A hub
with many pairs or many bytes is split into blocks by the hashes of both ends.

Texts are shuffled only where they are needed: a bitmap of the keys that a join
looks for is tested first, where the texts are read.  What passes it by chance is
shuffled too, so that the joins stay exact.

The join gives a row a document: its class and its number of links.  As links
lie within classes, they are counted there, over all pairs of the class's nodes
and on their exact sets, in tiles; no pair is written.  ``drop_near_duplicates``
keeps one row of each class.

Defined cases: a row with a null id or a text without words has no link, and such
rows stay (in the join a document without words is its own class, and a null id
gives no row); a text of fewer than n words has one n-gram, all its words; in the
join, rows that share an id count as one document (the one with the smallest token
hash), so repeated rows make no link; ``drop_near_duplicates`` looks at every
row by itself, whatever its id; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut, ensure_columns

HASHES = 160
ROWS = 3  # 53 bands: a pair at similarity 0.5 shares one with probability 0.9992, at 0.2 with 0.35
BLOCK = 32
PAIRS_A_BLOCK = 200_000
BYTES_A_BLOCK = 32_000_000
TILE = 8192  # nodes of a bucket that meet at once
SMALL = 32  # buckets up to this size are compared in full
SURE = 0.9999  # posterior at which a node is tied to a leader before the exact check
NODES_A_TILE = 2000  # of a class
BYTES_A_TILE = 16_000_000
BITS_A_KEY = 32  # of a bitmap of keys: one in 32 other keys passes
MOST_BITS = 1 << 27  # 16 MB; more keys than 4 million let more others pass


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    return (tk.mix(k * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (tk.mix(k + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)


def minhash(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES minima, for every row with grams."""
    rows = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, HASHES), dtype=np.uint16)
    if len(rows):
        mul, add = _seeds()
        starts = at[rows]
        half = (grams >> np.uint64(32)).astype(np.uint32)
        for j in range(HASHES):
            low = np.minimum.reduceat((half ^ add[j]) * mul[j], starts)
            out[rows, j] = (tk.mix(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def min_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number n of compared values, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    Under the uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail is
    a binomial sum: P(s < t) = P(Binomial(n + 1, t) >= m + 1).
    """
    out = {}
    for n in range(BLOCK, HASHES + 1, BLOCK):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)  # P(Binomial <= m) = P(s >= t)
            if tail >= tolerance:
                out[n] = m
                break
        else:
            out[n] = n + 1
    return out


def token_keys(h: np.ndarray, first: np.ndarray, live: np.ndarray) -> np.ndarray:
    """128 bits for the token sequence of each live row."""
    lo, hi = first[live], first[live + 1]
    back = tk.powers(len(h) + 1, True)[lo]
    keys = []
    for x in (h, tk.mix(h + np.uint64(77))):
        prefix = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(x * tk.powers(len(h)), out=prefix[1:])
        keys.append(tk.mix((prefix[hi] - prefix[lo]) * back + (hi - lo).astype(np.uint64)))
    return np.stack(keys, axis=1)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text), k (128-bit hash of the token sequence), size (n-grams) and sig of the rows with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(2)))
            for i, j in tk.slices(texts):
                data, off = tk.raw(texts.slice(i, j - i))
                s, e, first = tk.words(data, off)
                h = tk.word_hashes(data, s, e)
                grams, at = tk.gram_hashes(h, first, n)
                live = np.flatnonzero(np.diff(first))
                if not len(live):
                    continue
                sig = minhash(grams, at)[live]
                key = token_keys(h, first, live)
                ids, ts = (batch.column(c).slice(i, j - i).take(pa.array(live)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, ts, _fixed(key, 16), pa.array(np.diff(at)[live]), _fixed(sig, HASHES * 2)], names=["id", "t", "k", "size", "sig"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, t long, k binary, size long, sig binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).where("id is not null and text is not null")


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    n = len(a)
    off = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(a).tobytes())])


def _six(h: np.ndarray) -> bytes:
    """48-bit hashes, six bytes each."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """node, text -> node and grams, the sorted distinct gram hashes (48 bits, so that two of a pair's some hundred meet by chance once in 10**9 pairs) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(1)))
            for i, j in tk.slices(texts):
                data, off = tk.raw(texts.slice(i, j - i))
                s, e, first = tk.words(data, off)
                grams, at = tk.gram_hashes(tk.word_hashes(data, s, e), first, n)
                short = grams >> np.uint64(16)
                sets = [_six(np.unique(short[at[r] : at[r + 1]])) for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node long, grams binary")


def _verify(threshold: float, tolerance: float):
    need = min_matches(threshold, tolerance)

    def decide(t: pa.Table) -> pa.RecordBatch | None:
        a_col = np.asarray(t.column("a"))
        b_col = t.column("b")
        pair = np.asarray(b_col.is_valid())
        if not pair.any():
            return None
        g = np.unique(np.asarray(t.column("block").combine_chunks().dictionary_encode().indices), return_inverse=True)[1]
        docs, pairs = np.flatnonzero(~pair), np.flatnonzero(pair)
        kept = t.take(pa.array(docs))
        sig = np.frombuffer(b"".join(kept.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        sets = [_from_six(x) for x in kept.column("grams").to_pylist()]
        a, b = a_col[pairs], np.asarray(b_col.take(pa.array(pairs)).combine_chunks())
        ids, inv = np.unique(np.concatenate([a_col[docs], a, b]), return_inverse=True)
        code = g[docs].astype(np.int64) * len(ids) + inv[: len(docs)]
        order = np.argsort(code)
        find = lambda x: order[np.searchsorted(code, g[pairs].astype(np.int64) * len(ids) + x, sorter=order)]
        x, y = find(inv[len(docs) : len(docs) + len(pairs)]), find(inv[len(docs) + len(pairs) :])
        live = np.arange(len(pairs))
        seen = np.zeros(len(pairs), dtype=np.int32)
        for n, m in need.items():
            for part in range(0, len(live), 50_000):
                p = live[part : part + 50_000]
                seen[p] += (sig[x[p], n - BLOCK : n] == sig[y[p], n - BLOCK : n]).sum(axis=1, dtype=np.int32)
            live = live[seen[live] >= m]
        score = np.empty(len(live))
        for i, p in enumerate(live):
            u, v = sets[x[p]], sets[y[p]]
            if min(len(u), len(v)) < threshold * max(len(u), len(v)):
                score[i] = 0
                continue
            w = np.sort(np.concatenate([u, v]))
            both = int((w[1:] == w[:-1]).sum())
            score[i] = both / (len(w) - both)
        ok = score >= threshold
        return pa.RecordBatch.from_arrays([pa.array(a[live][ok]), pa.array(b[live][ok]), pa.array(score[ok])], names=["a", "b", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            if (out := decide(t)) is not None:
                yield out

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in the order of ``block`` as tables in which every block is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block")
        last = blocks[-1].as_py()
        starts = np.asarray(pa.compute.equal(blocks, last)).argmax()
        if held and held[-1].column("block")[-1].as_py() == last and starts == 0:
            held.append(batch)
            continue
        if starts:
            held.append(batch.slice(0, starts))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(starts)]
    if held:
        yield pa.Table.from_batches(held)


def _nodes(docs: DataFrame, n: int, id_col: str, text_col: str, one_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signature table, with ``one_text`` without all texts of an id but one, and the nodes: node (a number), k, size, sig, and the row (id, t) from which its n-grams are taken."""
    ensure_columns(docs, id_col, text_col)
    table = cut(signatures(docs, n, id_col, text_col), "signatures")
    if one_text:
        several = table.groupBy("id").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").select("id", "least")
        table = table.join(several, "id", "left").where("least is null or k = least").drop("least")
    one = table.groupBy("k").agg(F.first("sig").alias("sig"), F.max("size").alias("size"), F.min(F.struct("id", "t")).alias("row"))
    return table, cut(one.select(F.monotonically_increasing_id().alias("node"), "k", "size", "sig", "row.id", "row.t"), "nodes")


def _bands(nodes: DataFrame) -> DataFrame:
    """node and band, for every band of its signature; a band's low six bits are its place in the signature."""
    part = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda i: F.shiftleft(F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))), 6).bitwiseOR(i.cast("long")))
    return nodes.select("node", F.explode(part).alias("band")).repartition("band")


def _tiled(rows: DataFrame, key: str, ways: Column) -> DataFrame:
    """Rows (node, key and others) with block and side: any two of a key's rows meet in one block, in a block of two parts at different sides (1 and 2)."""
    rows = rows.withColumn("ways", ways.cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    block = F.when(F.col("ways") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("part", "with"), F.greatest("part", "with")))
    side = F.when(F.col("part") == F.col("with"), 0).when(F.col("part") < F.col("with"), 1).otherwise(2)
    return rows.withColumn("block", block).withColumn("side", side.cast("int")).drop("ways", "part", "with", key)


def _starts(block: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))


def _prune(threshold: float, tolerance: float, tie: bool):
    """Buckets' rows in the order of block -> a < b of nodes with different roots that may be near, and whether it is a tie to a leader."""
    need, sure = min_matches(threshold, tolerance), min_matches(threshold, SURE)[HASHES]

    def decide(t: pa.Table) -> pa.RecordBatch:
        block, node, size, root, side = (np.asarray(t.column(c).combine_chunks()) for c in ("block", "node", "size", "root", "side"))
        place = np.asarray(t.column("place").combine_chunks())
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        found: list[tuple[np.ndarray, np.ndarray, bool]] = []

        def test(i: np.ndarray, j: np.ndarray, parts: np.ndarray) -> None:
            live = (parts[i] != parts[j]) & ((side[i] == 0) | (side[i] != side[j]))
            live &= np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            i, j = i[live], j[live]
            seen = np.zeros(len(i), dtype=np.int16)
            for n, m in need.items():
                seen += (sig[i, n - BLOCK : n] == sig[j, n - BLOCK : n]).sum(axis=1, dtype=np.int16)
                live = seen >= m
                i, j, seen = i[live], j[live], seen[live]
            first = (sig[i, : HASHES // ROWS * ROWS] == sig[j, : HASHES // ROWS * ROWS]).reshape(-1, HASHES // ROWS, ROWS).all(axis=2).argmax(axis=1)
            live = first == place[i]  # one bucket of those that the two share
            found.append((i[live], j[live], False))

        edges = _starts(block)
        end = np.repeat(edges[1:], np.diff(edges))
        more = np.where(end - np.repeat(edges[:-1], np.diff(edges)) <= SMALL, end - np.arange(len(node)) - 1, 0)
        for k in range(0, len(node), 4096):
            n = more[k : k + 4096]
            i = np.repeat(np.arange(k, k + len(n)), n)
            test(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), root)
        for b in np.flatnonzero(np.diff(edges) > SMALL):
            rows, parts = np.arange(edges[b], edges[b + 1]), root.copy()
            left = rows[np.argsort(node[rows])] if tie else rows[:0]
            while len(left) > 1:
                c, left = left[0], left[1:]
                close = np.flatnonzero((sig[left, :BLOCK] == sig[c, :BLOCK]).sum(axis=1) >= need[BLOCK])
                close = close[(sig[left[close]] == sig[c]).sum(axis=1) >= sure]
                if len(close):
                    tied = left[close]
                    parts[tied] = parts[c]
                    found.append((np.full(len(tied), c), tied, True))
                    left = np.delete(left, close)
            if (parts[rows] == parts[rows[0]]).all():
                continue
            step = max(1, 200_000 // len(rows))
            for k in range(0, len(rows), step):
                i, j = np.nonzero(parts[rows[k : k + step], None] != parts[rows[None, k:]])
                ok = j > i
                test(rows[k + i[ok]], rows[k + j[ok]], parts)
        i, j = (np.concatenate([f[c] for f in found]) for c in (0, 1))
        ties = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(ties)], names=["a", "b", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            yield decide(t)

    return run


def _near(buckets: DataFrame, nodes: DataFrame, threshold: float, tolerance: float, tie: bool) -> DataFrame:
    """Distinct a < b and tie, from buckets (band, node, root, n)."""
    rows = buckets.join(nodes.select("node", "size", "sig"), "node").withColumn("place", F.col("band").bitwiseAND(63))
    tiles = _tiled(rows, "band", F.ceil(F.col("n") / TILE)).select("block", "node", "size", "root", "side", "place", "sig")
    pairs = tiles.repartition("block").sortWithinPartitions("block").mapInArrow(_prune(threshold, tolerance, tie), "a long, b long, tie boolean")
    return cut(pairs.groupBy("a", "b").agg(F.max("tie").alias("tie")), "near")


def _among(keys: DataFrame) -> Callable[[Column, Column], Column]:
    """A test of id and t that all of ``keys`` (id, t; read more than once) pass, and few others: a bit for each hash, in parts of 32,768."""
    bits = min(MOST_BITS, 1 << (keys.count() * BITS_A_KEY).bit_length())
    place = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(bits))
    at = keys.select(place(F.col("id"), F.col("t")).alias("at")).select(F.shiftright("at", 15).alias("part"), F.col("at").bitwiseAND(32767).alias("bit"))
    whole = np.zeros((-(-bits // 32768), 4096), dtype=np.uint8)
    for part, some in at.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        whole[part] = np.frombuffer(some, dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(whole.ravel())

    @F.arrow_udf("boolean")
    def has(at: pa.Array) -> pa.Array:
        x = np.asarray(at)
        return pa.array((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    return lambda i, t: has(place(i, t))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """node and grams of the ``wanted`` nodes."""
    rows = cut(nodes.join(wanted.select("node"), "node", "left_semi").select("id", "t", "node"), "wanted")
    few = _rows(docs, id_col, text_col).where(_among(rows)(F.col("id"), F.col("t"))).repartition("id", "t")  # else a task has two Python workers where rows are broadcast
    texts = few.join(rows, ["id", "t"])
    return gram_sets(texts, n).groupBy("node").agg(F.first("grams").alias("grams"))


def _checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, threshold: float, tolerance: float, id_col: str, text_col: str, keep: list[DataFrame] | None = None) -> DataFrame:
    """a, b, jaccard of those of the distinct ``pairs`` a < b of nodes that reach the threshold; ``keep`` gets the table of their sets."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    hubs = cut(ends.groupBy("node").agg(F.min("other").alias("hub")), "hubs")
    placed = (
        pairs.join(hubs.select(F.col("node").alias("a"), F.col("hub").alias("ha")), "a")
        .join(hubs.select(F.col("node").alias("b"), F.col("hub").alias("hb")), "b")
        .select("a", "b", F.least("ha", "hb").alias("hub"))
    )
    placed = cut(placed, "placed")
    sizes = nodes.select("node", (F.col("size") * 6 + 2 * HASHES + 64).alias("bytes"))
    held = placed.select("hub", F.col("a").alias("node")).union(placed.select("hub", "b")).distinct().join(sizes, "node").groupBy("hub").agg(F.sum("bytes").alias("bytes"))
    ways = F.greatest(F.ceil(F.sqrt(F.col("n") / PAIRS_A_BLOCK)), F.ceil(2 * F.col("bytes") / BYTES_A_BLOCK))
    big = cut(placed.groupBy("hub").agg(F.count("*").alias("n")).join(held, "hub").select("hub", ways.alias("ways")).where("ways > 1"), "large-hubs")
    side = lambda c: F.pmod(F.xxhash64(c), F.coalesce("ways", F.lit(1)))
    blocks = placed.join(big, "hub", "left").select("a", "b", F.concat_ws("/", "hub", side("a"), side("b")).alias("block"))
    wanted = blocks.select("block", F.col("a").alias("node")).union(blocks.select("block", "b")).distinct()
    sets = _sets(docs, nodes, hubs, n, id_col, text_col)
    if keep is not None:
        sets = cut(sets, "sets")
        keep.append(sets)
    sets = sets.join(nodes.select("node", "sig"), "node")
    items = wanted.join(sets, "node").select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "sig", "grams")
    tasks = blocks.select("block", "a", "b", F.lit(None).cast("binary").alias("sig"), F.lit(None).cast("binary").alias("grams"))
    return items.unionByName(tasks).repartition("block").sortWithinPartitions("block").mapInArrow(_verify(threshold, tolerance), "a long, b long, jaccard double")


def _overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many grams each set of ``a`` shares with each of ``b``: frequent grams by matrix products, the others by their matches."""
    long_a, long_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    grams, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    col_a, col_b = code[: long_a.sum()], code[long_a.sum() :]
    row_a, row_b = np.repeat(np.arange(len(a)), long_a), np.repeat(np.arange(len(b)), long_b)
    in_a, in_b = np.bincount(col_a, minlength=len(grams)), np.bincount(col_b, minlength=len(grams))
    out = np.zeros((len(a), len(b)), dtype=np.float32)  # whole numbers under 2**24
    hot = in_a * in_b * 400 > len(a) * len(b)
    number = np.cumsum(hot) - 1
    for low in range(0, int(hot.sum()), 2048):
        wide = min(2048, int(hot.sum()) - low)
        x, y = np.zeros((len(a), wide), dtype=np.float32), np.zeros((len(b), wide), dtype=np.float32)
        for m, row, col in ((x, row_a, col_a), (y, row_b, col_b)):
            own = hot[col] & (number[col] >= low) & (number[col] < low + wide)
            m[row[own], number[col[own]] - low] = 1
        out += x @ y.T
    order = np.argsort(col_b, kind="stable")
    row_b, first = row_b[order], np.cumsum(in_b) - in_b
    rare = np.flatnonzero(~hot[col_a] & (in_b[col_a] > 0))
    many = in_b[col_a[rare]]
    flat, done = out.ravel(), np.cumsum(many)
    for k in range(0, int(done[-1]) if len(done) else 0, 1_000_000):
        part = slice(*np.searchsorted(done, [k, k + 1_000_000], side="right"))
        r, c = rare[part], many[part]
        at = np.repeat(first[col_a[r]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        np.add.at(flat, np.repeat(row_a[r], c) * len(b) + row_b[at], np.float32(1))
    return out


def _count(threshold: float):
    """Classes' rows in the order of block -> node and links to the nodes of its block, each of which counts for its documents."""

    def decide(t: pa.Table) -> pa.RecordBatch:
        block, node, side, docs = (np.asarray(t.column(c).combine_chunks()) for c in ("block", "node", "side", "docs"))
        sets = [_from_six(x) for x in t.column("grams").to_pylist()]
        size = np.array([len(x) for x in sets], dtype=np.float64)
        links, edges = np.zeros(len(node), dtype=np.int64), _starts(block)
        for low, high in zip(edges[:-1], edges[1:]):
            rows = np.arange(low, high)
            x, y = (rows[side[rows] == 1], rows[side[rows] == 2]) if side[low] else (rows, rows)
            if not len(x) or not len(y):
                continue
            for k in range(0, len(x), NODES_A_TILE):
                i = x[k : k + NODES_A_TILE]
                both = _overlap([sets[r] for r in i], [sets[r] for r in y]).astype(np.float64)
                near = both / (size[i, None] + size[None, y] - both) >= threshold
                if side[low]:
                    links[y] += docs[i] @ near
                else:
                    near &= i[:, None] != y[None, :]
                links[i] += near @ docs[y]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            yield decide(t)

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and links of every id: documents are linked at Jaccard similarity of at least ``threshold``, a class is what hangs together by links, named by its smallest id, and ``links`` counts the other documents that a document is linked to, copies among them."""
    ensure_columns(docs, id_col, text_col)
    table, nodes = _nodes(docs, n, id_col, text_col, one_text=True)
    sets: list[DataFrame] = []
    roots = cut(linked_nodes(nodes, lambda pairs: _checked(docs, nodes, pairs, n, threshold, tolerance, id_col, text_col, sets), threshold, tolerance), "roots")
    group = nodes.select("k", "node").join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("k", "node", F.coalesce("root", "node").alias("root"))
    ids = cut(table.select("id", "k").distinct().join(group, "k").select("id", "node", "root"), "members")
    held = ids.groupBy("node", "root").agg(F.count("*").alias("docs"))
    classes = ids.groupBy("root").agg(F.min("id").alias("class_id"))
    grams = sets[0] if len(sets) == 1 else reduce(DataFrame.unionByName, sets).groupBy("node").agg(F.first("grams").alias("grams"))
    inner = grams.join(held, "node")
    extent = inner.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("grams") + 64).alias("bytes")).where("n > 1")
    tiles = _tiled(inner.join(extent, "root"), "root", F.greatest(F.ceil(F.col("n") / NODES_A_TILE), F.ceil(F.col("bytes") / BYTES_A_TILE))).select("block", "node", "side", "docs", "grams")
    counted = tiles.repartition("block").sortWithinPartitions("block").mapInArrow(_count(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    own = F.coalesce("links", F.lit(0)) + F.col("docs") - 1
    rows = ids.join(held.drop("root"), "node").join(classes, "root").join(counted, "node", "left").select(F.col("id").alias("doc_id"), "class_id", own.alias("links"))
    wordless = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().join(ids, "id", "left_anti")
    return rows.unionByName(wordless.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest node that an id is connected to, by alternating large and small stars."""
    now, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = cut(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state


def linked_nodes(nodes: DataFrame, check, threshold: float = 0.5, tolerance: float = 0.001) -> DataFrame:
    """id, root: nodes that hang together by candidate pairs that pass ``check`` (distinct pairs a < b -> those that link).

    Ties stand for the pairs of a bucket that they connect.  A tie that the check
    breaks, and whose ends aren't connected otherwise, has its buckets compared
    without ties, across roots.
    """
    band = _bands(nodes)
    buckets = cut(band.join(band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"), "buckets")
    pairs = _near(buckets.withColumn("root", F.col("node")), nodes, threshold, tolerance, True)
    links = cut(check(pairs.select("a", "b")).select("a", "b"), "links")
    roots = cut(components(links), "roots")
    root = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    broken = pairs.where("tie").join(links, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    broken = cut(broken.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "broken")
    if broken.isEmpty():
        return roots
    ends = broken.join(buckets.select(F.col("node").alias("a"), "band"), "a").join(buckets.select(F.col("node").alias("b"), "band"), ["b", "band"]).select("band").distinct()
    again = buckets.join(ends, "band", "left_semi").join(roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = cut(check(_near(again, nodes, threshold, tolerance, False).select("a", "b")).select("a", "b"), "links")
    return components(rest.unionByName(_as_edges(roots)))


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("id").alias("b"))


def drop_near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one row of each group of connected near copies: the row of smallest id, and of those the one of smallest text hash.

    Rows without an id or without words stay.  Rows that share an id are rows like
    any other: they go only as copies of each other or of other rows.
    """
    table, nodes = _nodes(docs, n, id_col, text_col)
    roots = linked_nodes(nodes, lambda pairs: _checked(docs, nodes, pairs, n, threshold, tolerance, id_col, text_col), threshold, tolerance)
    group = nodes.select("k", "node").join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("k", F.coalesce("root", "node").alias("root"))
    rows = cut(table.groupBy("id", "t").agg(F.first("k").alias("k"), F.count("*").alias("copies")).join(group, "k").select("id", "t", "root", "copies"), "grouped")
    first = rows.groupBy("root").agg(F.min(F.struct("id", "t")).alias("first"), F.count("*").alias("n")).where("n > 1")
    key = lambda df: df.select(F.col("id").alias("__lectern_id"), F.col("t").alias("__lectern_t"))
    gone = cut(key(rows.join(first, "root").where("id <> first.id or t <> first.t")), "dropped")
    again = key(rows.where("copies > 1"))
    own_id, own_t = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    own = lambda df: (own_id == df["__lectern_id"]) & (own_t == df["__lectern_t"])
    touched = _among(gone.union(again).toDF("id", "t"))(own_id, own_t)
    rest = docs.where(~touched)
    kept = docs.where(touched).join(gone, own(gone), "left_anti")
    if again.isEmpty():
        return rest.union(kept)
    twice = kept.join(again, own(again), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    order = Window.partitionBy(F.col(f"row.`{id_col}`"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string"))).orderBy(F.to_json("row"))
    once = twice.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
    return rest.union(kept.join(again, own(again), "left_anti")).union(once)
