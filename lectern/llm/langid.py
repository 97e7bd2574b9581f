"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3 bytes, lower case), term
frequencies damped by log and weighted by inverse document frequency over *all*
documents, scaled to length 1.  Each language has several centroids, from
spherical k-means on a bounded sample of its labelled rows, those of smallest
hash; the sample's size is shared out so that a language of few rows gives all
it has before a larger one gives more, and never less than ``least_rows`` of
them.  A text takes the language of the centroid with the highest cosine.  It is rejected (``und``)
where that cosine is under the centroid's own limit, a low quantile of its
members' cosines less a margin, or where the text has no letters.

Defined cases: null or letterless texts are ``und`` with cosine 0; labels that
are null or ``und`` aren't trained on; repeated rows get equal rows; ties go to
the language first by name; an empty table gives an empty result; without any
labelled row every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut, ensure_columns

DIMS = 4096
SLICE = 500_000

#: bytes as they enter n-grams: letters and bytes over 127 stay, all else is one space
_CODE = np.full(256, 32, dtype=np.uint32)
_CODE[97:123] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DIMS) n-gram counts of lower-cased texts, and the number of letters of each row."""
    data, off = tk.raw(texts)
    rows = len(off) - 1
    if not len(data):
        return np.zeros((rows, DIMS), np.float32), np.zeros(rows, np.int64)
    code = _CODE[data]
    letter = code != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a word
    keep[off[:-1][off[:-1] < len(data)]] = True
    row = np.repeat(np.arange(rows), np.diff(off))[keep]
    code = code[keep]
    base = row.astype(np.int64) * DIMS
    out = np.zeros(rows * DIMS, dtype=np.int64)
    gram = code.astype(np.uint32)
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint32(257) + code[n - 1 :]
            ok = row[: len(gram)] == row[n - 1 :]
        else:
            ok = code != 32
        slot = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((base[: len(gram)] + slot)[ok], minlength=rows * DIMS)
    return out.reshape(rows, DIMS).astype(np.float32), np.bincount(row, weights=code != 32, minlength=rows).astype(np.int64)


def vectors(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, letters = counts(texts)
    x = np.log1p(c, out=c) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), letters


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k unit centroids; starts are rows far from the starts before them."""
    chosen = [x.mean(axis=0)]
    near = x @ (chosen[0] / max(np.linalg.norm(chosen[0]), 1e-9))
    picks = []
    for _ in range(min(k, len(x))):
        i = int(np.argmin(near))
        picks.append(x[i])
        near = np.maximum(near, x @ x[i])
    c = np.array(picks)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid, in order
    limits: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is accepted, for lower-cased texts."""
        x, letters = vectors(texts, self.idf)
        if not len(self.centroids):
            return ["und"] * len(x), np.zeros(len(x)), np.zeros(len(x), bool)
        cos = x @ self.centroids.T
        best = np.argmax(cos, axis=1)
        value = cos[np.arange(len(x)), best].astype(float)
        # a short text has a short cosine with any centroid: the limit grows with the letters
        ok = (letters > 0) & (value >= self.limits[best] * np.minimum(1, np.sqrt(letters / 400)))
        value[letters == 0] = 0
        return [self.languages[b] if k else "und" for b, k in zip(best, ok)], value, ok


def _level(counts: list[int], total: int) -> int:
    """Rows that a language may give so that all together give at most ``total``."""
    left = sorted(counts)
    while left and left[0] * len(left) <= total:
        total -= left.pop(0)
    return total // len(left) if left else max(counts, default=0)


def fit(docs: DataFrame, sample_rows: int = 4000, clusters: int = 4, quantile: float = 0.01, margin: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_rows: int = 50) -> LanguageModel:
    """Document frequencies over every row; centroids from at most ``sample_rows`` labelled rows, or ``least_rows`` a language if that is more."""
    ensure_columns(docs, id_col, text_col, lang_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(0)))
            for i, j in tk.slices(texts, SLICE, 512):
                c, letters = counts(texts.slice(i, j - i))
                total += (c > 0).sum(axis=0)
                rows += int((letters > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([rows], pa.int64())], names=["df", "n"])

    parts = base.where("text is not null").select("text").mapInArrow(df, "df array<long>, n long")
    summed = parts.select("n", F.posexplode("df").alias("slot", "c")).groupBy("slot").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toPandas()
    freq, n = np.zeros(DIMS), 0
    if len(summed):
        freq[summed["slot"].to_numpy()] = summed["c"].to_numpy()
        n = int(summed["n"].iloc[0])
    idf = np.log((n + 1) / (freq + 1)).astype(np.float32) + np.float32(0.1)
    labelled = base.where("text is not null and lang is not null and lang <> 'und'").where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]")).select("lang", "text", F.xxhash64("id", "text").alias("h"))
    hashes = cut(labelled.select("lang", "h").distinct(), "language-hashes")
    level = max(least_rows, _level([r["count"] for r in hashes.groupBy("lang").count().collect()], sample_rows))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    edge = hashes.withColumn("r", place).where(F.col("r") <= level).groupBy("lang").agg(F.max("h").alias("edge"))
    rows = cut(labelled.join(F.broadcast(edge), "lang").where("h <= edge").select("lang", "text", "h").dropDuplicates(["lang", "h"]), "language-sample")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(1)))
            for i, j in tk.slices(texts, SLICE, 512):
                x, letters = vectors(texts.slice(i, j - i), idf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(letters), batch.column(2).slice(i, j - i), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["lang", "letters", "h", "x"])

    got = rows.mapInArrow(sample, "lang string, letters long, h long, x binary").where("letters > 0").toPandas().sort_values(["lang", "h"])
    centroids, languages, limits = [], [], []
    for lang, own in got.groupby("lang", sort=True):
        x = np.frombuffer(b"".join(own["x"]), dtype=np.float16).reshape(len(own), DIMS).astype(np.float32)
        c = spherical_kmeans(x, clusters)
        cos, long = (x @ c.T).max(axis=1), own["letters"].to_numpy() >= 400
        limit = max(0.0, float(np.quantile(cos[long] if long.any() else cos, quantile)) * margin)
        centroids.append(c)
        languages += [lang] * len(c)
        limits += [limit] * len(c)
    return LanguageModel(idf, np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMS), np.float32), languages, np.array(limits))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, language (``und`` where rejected), cosine, accepted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.lower(tk.as_array(batch.column(1)))
            for i, j in tk.slices(texts, SLICE, 512):
                lang, cos, ok = model.predict(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(cos), pa.array(ok)], names=["doc_id", "language", "cosine", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, language string, cosine double, accepted boolean")
