"""Mixing sources to target weights.

Documents hang on a tree (domain, language, source).  The token budget goes
down from the root: a node's children share it by weight, a child that can't
take its share (its tokens times ``max_epochs``) is filled, and what it leaves
goes to its siblings by weight; only what no sibling can take reaches the
ancestor's siblings, as a node's capacity is the sum of its children's.  A leaf
takes whole epochs and then a prefix of the next one: its rows in the order of
a seeded hash, as far as their running token count stays within the rest.

The leaves' totals are all that is collected.  The prefix is found without
sorting a leaf on one task: token counts by hash bucket give the bucket in
which the rest ends, and only that bucket's rows are ranked.

Defined cases: a source without a number, or with one beyond 64 bits, is of the
domain ``other``; a null level is the child named ''; a child without a weight
has weight 1, one of weight 0 gets nothing; rows that share an id have one hash and
enter together; null texts have 0 tokens; an empty table gives an empty result;
other columns are kept by ``mix_rows`` and ignored by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, ensure_columns

WORD = r"[^ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class Mix:
    """``levels`` are SQL expressions from the top down; ``weights`` maps a path such as ("d0", "en") to its weight among its siblings, ("*", "en") for any parent."""

    levels: tuple[str, ...] = ("coalesce(concat('d', pmod(try_cast(regexp_extract(source, '[0-9]+', 0) as bigint), 4)), 'other')", "lang", "source")
    names: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict = field(default_factory=lambda: {("d0",): 0.4, ("d1",): 0.3, ("d2",): 0.2, ("d3",): 0.1, ("other",): 0.1, ("*", "en"): 0.5, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.1})
    budget: float = 1.0  # share of the table's tokens
    max_epochs: int = 2
    seed: int = 17

    def weight(self, path: tuple[str, ...]) -> float:
        return float(self.weights.get(path, self.weights.get(("*",) * (len(path) - 1) + path[-1:], 1.0)))


def water_fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """What each (weight, capacity) gets: min(capacity, level * weight), the level such that all of the budget is placed if it can be."""
    out = [0.0] * len(children)
    order = sorted((i for i, (w, c) in enumerate(children) if w > 0 and c > 0), key=lambda i: (children[i][1] / children[i][0], i))
    weight = sum(children[i][0] for i in order)
    for k, i in enumerate(order):
        level = budget / weight if weight > 0 else 0.0
        if level <= children[i][1] / children[i][0]:
            for j in order[k:]:
                out[j] = min(children[j][1], level * children[j][0])
            break
        out[i] = float(children[i][1])
        budget -= out[i]
        weight = sum(children[j][0] for j in order[k + 1 :])
    return out


def allocate(leaves: dict[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], int]:
    """Token quota of each leaf path, from the leaves' tokens."""
    kids: dict[tuple, set] = {}
    cap: dict[tuple, float] = {}
    depth = len(mix.levels)
    for path, tokens in leaves.items():
        cap[path] = float(tokens * mix.max_epochs)
        for k in range(depth):
            kids.setdefault(path[:k], set()).add(path[: k + 1])
    for k in range(depth - 1, -1, -1):
        for node in [n for n in kids if len(n) == k]:
            cap[node] = sum(cap[c] for c in kids[node] if mix.weight(c) > 0)
    quota = {(): min(cap.get((), 0.0), mix.budget * sum(leaves.values()))}
    for k in range(depth):
        for node in sorted(n for n in kids if len(n) == k):
            below = sorted(kids[node])
            for c, x in zip(below, water_fill(quota[node], [(mix.weight(c), cap[c]) for c in below])):
                quota[c] = x
    return {p: floor(quota[p] + 1e-6) for p in leaves}


def _levels(mix: Mix) -> list[Column]:
    return [F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(f"l{i}") for i, e in enumerate(mix.levels)]


def _key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))


def plan(docs: DataFrame, mix: Mix, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, levels, n_tokens of every row; levels, full epochs and the last key of the next one, of every leaf)."""
    ensure_columns(docs, id_col, text_col)
    spark = docs.sparkSession
    names = [f"l{i}" for i in range(len(mix.levels))]
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), *_levels(mix), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")), "mix-rows")
    totals = {tuple(r[n] for n in names): r["t"] for r in rows.groupBy(*names).agg(F.sum("n_tokens").alias("t")).collect()}
    quota = allocate(totals, mix)
    table = [(*p, q // totals[p] if totals[p] else 0, q - (q // totals[p]) * totals[p] if totals[p] else 0) for p, q in quota.items()]
    schema = ", ".join(f"{n} string" for n in names) + ", full int, rest long"
    leaves = spark.createDataFrame(table, schema)
    keyed = rows.join(leaves, names).where("rest > 0").withColumn("key", _key(F.col("full"), mix.seed)).select(*names, "key", "n_tokens", "rest", F.substring("key", 1, 4).alias("bucket"))
    buckets = keyed.groupBy(*names, "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("bucket"))
    edge = buckets.withColumn("upto", upto).where("upto > rest").groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(*names, "e.*")
    inside = keyed.join(edge, [*names, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key")))
    last = inside.where("upto <= rest").groupBy(*names).agg(F.max("key").alias("key"))
    # no row of the edge bucket fits: all before the bucket; no edge: the rest takes the whole epoch
    leaves = leaves.join(edge.select(*names, "bucket"), names, "left").join(last, names, "left")
    leaves = leaves.select(*names, "full", F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("key", "bucket", F.lit("g"))).alias("last"))
    return rows, cut(leaves, "mix-leaves")


def _copies(frame: DataFrame, leaves: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Each row once for every epoch that takes it."""
    joined = frame.join(leaves, names)
    extra = F.when(_key(F.col("full"), seed) <= F.col("last"), 1).otherwise(0)
    return joined.withColumn("copies", F.col("full") + extra).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


def mix(docs: DataFrame, spec: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the levels, epoch and n_tokens of every selected copy."""
    spec = spec or Mix()
    rows, leaves = plan(docs, spec, id_col, text_col)
    names = [f"l{i}" for i in range(len(spec.levels))]
    return _copies(rows, leaves, names, spec.seed).select(F.col("id").alias("doc_id"), *(F.col(n).alias(a) for n, a in zip(names, spec.names)), "epoch", "n_tokens")


def mix_rows(docs: DataFrame, spec: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected rows with all their columns, once for every epoch that takes them."""
    spec = spec or Mix()
    _, leaves = plan(docs, spec, id_col, text_col)
    names = [f"l{i}" for i in range(len(spec.levels))]
    packed = docs.select(F.col(id_col).cast("long").alias("id"), *_levels(spec), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return _copies(packed, leaves, names, spec.seed).select("row.*")
