"""Rank fusion and the stages after it, for a whole batch of queries at once.

Ranked lists have query_id, chunk_id, score and rank (from 1).  Every order
ends with chunk_id, so results never depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, is_symbol_lookup
from ..schema import API_TYPES
from ..session import settled


def by_score(query: str = "query_id") -> Window:
    return Window.partitionBy(query).orderBy(F.desc("score"), "chunk_id")


def rerank_by_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(by_score()))


def reciprocal_ranks(vector: DataFrame, keyword: DataFrame, k: int = 30, depth: int = 40, keyword_weight: float = 2.0) -> DataFrame:
    """Weighted reciprocal rank fusion: what both lists hold adds up; up to twice ``depth`` rows a query."""
    part = lambda d, w: d.where(F.col("rank") <= depth).select("query_id", "chunk_id", (F.lit(w) / (k + F.col("rank"))).alias("score"))
    both = part(vector, 1.0).unionByName(part(keyword, float(keyword_weight)))
    return rerank_by_score(both.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")))


def best_of_variants(hits: DataFrame, depth: int) -> DataFrame:
    """Hits of a query's variants as one list: the highest score of each chunk, cut to ``depth``."""
    return rerank_by_score(hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))).where(F.col("rank") <= depth)


def dedup(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each query's chunk in ``order``."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def rerank_candidates(fused: DataFrame, limit: int = 30) -> DataFrame:
    """API types first as far as ``limit`` goes, others in what is left, then by score again; ``type`` must be a column.  A limit of 0 or less keeps all."""
    if limit <= 0:
        return fused
    api = F.col("type").isin(*API_TYPES)
    order = Window.partitionBy("query_id").orderBy(F.desc(api.cast("int")), "rank")
    return rerank_by_score(fused.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= limit).drop("slot"))


def rerank_decision(queries: DataFrame, fused: DataFrame, threshold: float = 0.15) -> DataFrame:
    """query_id, gap (null under two rows), rerank: not for symbol lookups, not where the first leads by more than ``threshold``."""
    first = fused.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    gap = F.col("a") - F.col("b")
    return queries.join(first, "query_id").select("query_id", gap.alias("gap"), (~is_symbol_lookup(F.col("query")) & ~F.coalesce(gap > threshold, F.lit(False))).alias("rerank"))


def lexical_scorer(query: Column, text: Column) -> Column:
    """Default second-stage scorer: share of the query's distinct words in the first 512 characters, through a sigmoid.  A lexical stand-in, not a neural model."""
    from ..functions.text import tokenize

    q = F.array_distinct(tokenize(query))
    share = F.size(F.array_intersect(q, tokenize(F.substring(text, 1, 512)))) / F.greatest(F.size(q), F.lit(1))
    return 1 / (1 + F.exp(-(4 * share - 2)))


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, scorer=lexical_scorer) -> DataFrame:
    """Candidates scored anew by ``scorer(query column, text column)``, an expression or a pandas UDF."""
    pairs = candidates.select("query_id", "chunk_id").join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "embed_text"), "chunk_id")
    return rerank_by_score(pairs.select("query_id", "chunk_id", F.round(scorer(F.col("query"), F.col("embed_text")), 6).alias("score")))


def code_boost(rows: DataFrame, queries: DataFrame, triggers: list[str], ratio: float = 1.2) -> DataFrame:
    """Chunks with code rise by ``ratio`` for queries that hold a trigger; ``contains_code`` must be a column."""
    flagged = rows.drop("rank").join(queries.select("query_id", contains_any(F.col("query"), triggers).alias("boost")), "query_id")
    return rerank_by_score(flagged.withColumn("score", F.when(F.col("boost") & F.col("contains_code"), F.col("score") * ratio).otherwise(F.col("score"))).drop("boost"))


def expand_references(rows: DataFrame, chunks: DataFrame, limit: int = 5, top: int = 5, held: DataFrame | None = None) -> DataFrame:
    """Appends up to ``limit`` chunks a query that its ``top`` rows refer to, at 0.8 of the referring score.

    References count in the order of the referring row, then of its list.  Each
    takes the first chunk of that symbol by collection; one that is in the list
    already adds nothing.  The new rows come after all others.  ``held`` may have the
    rows' chunks, so that they needn't be looked for among all.
    """
    owners = Window.partitionBy("collection", "symbol_id").orderBy("chunk_id")
    named = settled(rows.where(F.col("rank") <= top).join((chunks if held is None else held).select("chunk_id", "references"), "chunk_id").select("query_id", "rank", "score", F.posexplode("references").alias("place", "ref")), "references")
    sought = chunks.where("symbol_id <> ''").join(named.select(F.col("ref").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    targets = sought.withColumn("nth", F.row_number().over(owners)).where("nth = 1").select(F.col("symbol_id").alias("ref"), F.col("chunk_id").alias("target"), "collection")
    known = rows.select("query_id", F.col("chunk_id").alias("target"))
    fresh = named.join(targets, "ref").join(known, ["query_id", "target"], "left_anti")
    each = Window.partitionBy("query_id", "rank", "place").orderBy("collection", "target")
    once = Window.partitionBy("query_id", "target").orderBy("rank", "place")
    picked = fresh.withColumn("nth", F.row_number().over(each)).where("nth = 1").withColumn("nth", F.row_number().over(once)).where("nth = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "place")
    added = picked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("query_id", F.col("target").alias("chunk_id"), (F.col("score") * 0.8).alias("score"), "nth")
    last = rows.groupBy("query_id").agg(F.max("rank").alias("last"))
    added = added.join(last, "query_id").select("query_id", "chunk_id", "score", (F.col("last") + F.col("nth")).alias("rank"))
    return rows.select("query_id", "chunk_id", "score", "rank").unionByName(added)


def module_filter(rows: DataFrame, chunks: DataFrame, module: str | None) -> DataFrame:
    """Rows of one module, ranked on; it comes after expansion and must not go before."""
    if not module:
        return rows
    kept = rows.join(chunks.where(F.col("source_module") == module).select("chunk_id"), "chunk_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def active_only(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of registered sources."""
    return rows.join(sources.select(F.col("label").alias("source_label")), "source_label", "left_semi")
