"""Order-preserving packing of documents into windows.

The corpus, in the order of id, is a row of sentences, where one longer than a
window counts as several, each a window long but the last; a window holds
consecutive sentences, and a cut lies between two of them, inside a document at
a price.  A window of x tokens costs ``size - x`` for padding if it is short and
``truncation * (x - size)`` if it is long, as what is beyond is cut off.  The
cheapest cuts come from

    dp[j] = cut(j) + min(min{dp[i] + size - S[j] + S[i] : S[j] - S[i] <= size},
                         min{dp[i] + truncation * (S[j] - S[i] - size) : S[j] - S[i] > size})

with a monotone queue for the first minimum and a running one for the second,
so a step is constant on average.  The order is cut into shards of about
``shard_tokens`` tokens at document starts, by each document's place in the
running token count of the whole corpus; windows don't cross shards, and the
result doesn't depend on Spark's partitions.

Tokens are white-space separated words, or those of a tiktoken vocabulary file.

Defined cases: rows with a null id or a text without tokens are in no window;
rows that share an id follow each other by the text's hash, and repeated rows
are packed as often as they occur; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut, ensure_columns

_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def sentences(texts: pa.Array, tokenizer: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of all sentences, and the first sentence of each row (and one past the last)."""
    data, off = tk.raw(texts)
    s, e, first = tk.words(data, off)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    close = _STOP[data[e - 1]]
    close[:-1] |= newline[s[1:]] > newline[e[:-1]]
    close[first[1:][first[1:] > 0] - 1] = True
    ends = np.flatnonzero(close) + 1
    starts = np.concatenate([[0], ends[:-1]])
    if tokenizer is None:
        size = ends - starts
    else:
        enc, whole = _encoding(tokenizer, PATTERN), data.tobytes()
        size = np.array([len(enc.encode_ordinary(whole[s[a] : e[b - 1]].decode())) for a, b in zip(starts, ends)], dtype=np.int64)
    return size, np.searchsorted(ends, first, side="right")


def _within(size: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with sentences longer than ``window`` cut at every window's length."""
    parts = np.maximum(1, -(-size // window))
    last = np.cumsum(parts)
    out = np.full(int(parts.sum()), window, dtype=np.int64)
    out[last - 1] = size - (parts - 1) * window
    return out, np.concatenate([[0], last])[at]


def best_cuts(size: list[int], inner: list[bool], window: int, truncation: float, split: float) -> tuple[list[int], float]:
    """Ends of the cheapest windows over sentences; inner[j]: a cut after sentence j would be inside a document."""
    n = len(size)
    total = [0] * (n + 1)
    for j in range(n):
        total[j + 1] = total[j] + size[j]
    dp, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque()  # starts within reach, dp + total rising
    key = [0.0] * (n + 1)
    far, far_at, left = float("inf"), -1, 0
    for j in range(1, n + 1):
        i = j - 1
        k = key[i] = dp[i] + total[i]
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(i)
        reach = total[j] - window
        while left < j and total[left] < reach:
            v = dp[left] - truncation * total[left]
            if v < far:
                far, far_at = v, left
            left += 1
        while queue and total[queue[0]] < reach:
            queue.popleft()
        cost, at = float("inf"), -1
        if queue:
            cost, at = key[queue[0]] + window - total[j], queue[0]
        if far_at >= 0:
            c = far + truncation * (total[j] - window)
            if c < cost:
                cost, at = c, far_at
        dp[j], back[j] = cost + (split if inner[j - 1] else 0.0), at
    ends, j = [], n
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1], dp[n]


def pack(docs: DataFrame, window: int = 2048, truncation: float = 4.0, split: float = 32.0, shard_tokens: int = 1 << 20, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a window: shard, window (its number in the shard), doc_ids, starts and stops (tokens of each document, half open), n_tokens, padding, truncated."""
    ensure_columns(docs, id_col, text_col)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.as_array(batch.column(1))
            for i, j in tk.slices(texts):
                size, at = _within(*sentences(texts.slice(i, j - i), tokenizer), window)
                rows = np.flatnonzero(np.diff(at))
                if len(rows):
                    whole = size.astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i).take(pa.array(rows)), batch.column(2).slice(i, j - i).take(pa.array(rows)), pa.array(np.add.reduceat(size, at[rows])), pa.array([whole[at[r] : at[r + 1]].tobytes() for r in rows], pa.binary())],
                        names=["id", "r", "n", "sizes"],
                    )

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("r")).where("id is not null and text is not null")
    lines = cut(base.mapInArrow(lengths, "id long, r long, n long, sizes binary"), "sentences")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = np.asarray(batch.column("n"))
            start = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "start"])

    placed = cut(lines.repartitionByRange("id", "r").sortWithinPartitions("id", "r").withColumn("part", F.spark_partition_id()).mapInArrow(running, "id long, r long, n long, sizes binary, part int, start long"), "ordered")
    parts = placed.groupBy("part").agg(F.sum("n").alias("t")).withColumn("before", F.sum("t").over(Window.orderBy("part")) - F.col("t")).select("part", "before")  # one row a partition
    shards = placed.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before")).withColumn("shard", F.floor(F.col("start") / shard_tokens)).select("shard", "start", "id", "sizes")

    def decide(t: pa.Table) -> pa.RecordBatch:
        ids = np.asarray(t.column("id").combine_chunks())
        parts = [np.frombuffer(x, dtype=np.int32) for x in t.column("sizes").to_pylist()]
        size = np.concatenate(parts).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        inner = np.zeros(len(size), dtype=bool)
        inner[:-1] = owner[1:] == owner[:-1]
        ends, _ = best_cuts(size.tolist(), inner.tolist(), window, truncation, split)
        total = np.concatenate([[0], np.cumsum(size)])
        doc_start = total[np.searchsorted(owner, np.arange(len(parts)))]
        doc_stop = np.append(doc_start[1:], total[-1])
        out, a = {k: [] for k in ("doc_ids", "starts", "stops", "n_tokens", "padding", "truncated")}, 0
        for b in ends:
            low, high = int(total[a]), int(min(total[b], total[a] + window))
            members = np.arange(owner[a], owner[b - 1] + 1)
            members = members[doc_start[members] < high]
            out["doc_ids"].append(ids[members])
            out["starts"].append(np.maximum(low - doc_start[members], 0).astype(np.int32))
            out["stops"].append((np.minimum(high, doc_stop[members]) - doc_start[members]).astype(np.int32))
            out["n_tokens"].append(high - low)
            out["padding"].append(max(0, window - (high - low)))
            out["truncated"].append(int(total[b]) - high)
            a = b
        shard = t.column("shard")[0].as_py()
        kinds = {"doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "stops": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(ends), pa.int64()), pa.array(range(len(ends)), pa.int64()), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["shard", "window", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                shard = np.asarray(batch.column("shard"))
                if held and held[0].column("shard")[0].as_py() != shard[0]:
                    yield decide(pa.Table.from_batches(held))
                    held = []
                stop = int(np.searchsorted(shard, shard[0], side="right"))
                held.append(batch.slice(0, stop))
                batch = batch.slice(stop)
        if held:
            yield decide(pa.Table.from_batches(held))

    return shards.repartition("shard").sortWithinPartitions("shard", "start").mapInArrow(run, "shard long, window long, doc_ids array<long>, starts array<int>, stops array<int>, n_tokens long, padding long, truncated long")
