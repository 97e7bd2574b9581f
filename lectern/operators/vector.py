"""Exact vector search and the embedding interface."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import top
from .packs import meet, pack


def similarity(a: str, b: str, metric: str = "l2sq") -> Column:
    """1 - squared distance (default) or the cosine."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    if metric == "l2sq":
        return 1 - total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return dot / F.sqrt(total(F.transform(x, lambda p: p * p)) * total(F.transform(y, lambda p: p * p)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """query_id, chunk_id, score, rank from vectors (chunk_id, embedding) and queries (query_id, embedding); scores have 6 decimals.

    Packs of vectors meet packs of queries of the same length in one matrix product
    each, and k rows a query and pack are shuffled.  Null and empty vectors match
    nothing; nor, by cosine, do vectors of zeros.
    """
    some = "embedding is not null and size(embedding) > 0"
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "chunk_id"))]
    stored = pack(vectors.where(some).select("chunk_id", F.col("embedding").cast("array<double>").alias("v")), "l_", "v")
    asked = pack(queries.where(some).select("query_id", F.col("embedding").cast("array<double>").alias("v")), "r_", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ids, xs, q_ids, qs = (batch.column(batch.schema.get_field_index(c)) for c in ("l_size", "l_chunk_id", "l_v", "r_query_id", "r_v"))
            for i in range(batch.num_rows):
                x, q = (np.asarray(m[i].values.flatten()).reshape(-1, size[i].as_py()) for m in (xs, qs))
                with np.errstate(invalid="ignore", divide="ignore"):
                    dot, qq, xx = q @ x.T, (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
                    s = np.round(1 - (qq + xx - 2 * dot) if metric == "l2sq" else dot / np.sqrt(qq * xx), 6)
                s[np.isnan(s)] = -np.inf
                keep = s > -np.inf
                if s.shape[1] > k:  # all that tie with the k-th stay, so that ids decide
                    keep &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([q_ids[i].values.take(pa.array(r)), ids[i].values.take(pa.array(c)), pa.array(s[r, c])], names=["query_id", "chunk_id", "score"])

    return top(meet(stored, asked).mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def hashing_embedder(dims: int = 64):
    """A deterministic stand-in for an embedding model: signed hashed words, scaled to length 1.  It is no neural model."""
    import xxhash

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            v = np.zeros(dims)
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def batched_embedder(encode, dims: int, batch: int = 256, wait: float = 1.0):
    """An embedder from ``encode`` (texts -> vectors), called on ``batch`` texts at a time; a call that fails is tried again once after ``wait`` seconds, and then gives zeros."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        import time

        out: list = []
        for i in range(0, len(texts), batch):
            some = texts.iloc[i : i + batch].fillna("").tolist()
            for left in (1, 0):
                try:
                    got = [[float(x) for x in v] for v in encode(some)]
                    break
                except Exception:  # a model's failure must not end the job
                    got = [[0.0] * dims for _ in some]
                    if left:
                        time.sleep(wait)
            out += got
        return pd.Series(out, index=texts.index)

    return embed


def split_cached(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses); the key is the hash of text and model."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("|", F.coalesce("text", F.lit("")), F.lit(model)), 256))
    return keyed.join(cache.select("key", "embedding"), "key"), keyed.join(cache.select("key"), "key", "left_anti")


#: a vector of zeros marks a failure and is never cached
IS_VECTOR = "exists(embedding, x -> x <> 0)"


def embed_missing(texts: DataFrame, cache: DataFrame, embed, model: str) -> DataFrame:
    """key and embedding of the texts that the cache lacks, each once; zeros where embedding failed."""
    _, misses = split_cached(texts, cache, model)
    return misses.select("key", "text").dropDuplicates(["key"]).select("key", embed("text").alias("embedding"))
