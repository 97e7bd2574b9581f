"""Retrieval quality over tables of queries, ranked results and relevant ids.

relevance: query_id, relevant (array of ids).  ranked: query_id, chunk_id, rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packs import meet, pack

STAGES = "bm25 vector rrf reranker final".split()


def passages_in(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, relevant: the chunks (chunk_id, remarks) that hold each passage (query_id, text) verbatim; passages that none holds are left out."""
    kinds = f"query_id {passages.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        @lru_cache(maxsize=4)
        def automaton(asked: tuple[str, ...]):
            found = ahocorasick.Automaton()
            for i, text in enumerate(asked):
                found.add_word(text, found.get(text, ()) + (i,))
            found.make_automaton()
            return found

        for batch in batches:
            ids, texts, q_ids, asked = (batch.column(batch.schema.get_field_index(c)) for c in ("l_chunk_id", "l_remarks", "r_query_id", "r_text"))
            for i in range(batch.num_rows):
                search = automaton(tuple(asked[i].as_py()))
                pairs = sorted({(q, c) for c, text in enumerate(texts[i].as_py()) for _, found in search.iter(text) for q in found})
                yield pa.RecordBatch.from_arrays([q_ids[i].values.take(pa.array([q for q, _ in pairs], pa.int64())), ids[i].values.take(pa.array([c for _, c in pairs], pa.int64()))], names=["query_id", "chunk_id"])

    texts = pack(chunks.where("remarks <> ''").select("chunk_id", "remarks"), "l_")
    hits = meet(texts, pack(passages.where("text <> ''").select("query_id", "text"), "r_")).mapInArrow(run, kinds)
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))


def ranked_lists(ranked: DataFrame) -> DataFrame:
    """query_id, retrieved: ids in the order of rank."""
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; 1 where nothing is relevant."""
    rel = F.array_distinct(relevant)
    return F.when(F.size(rel) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), rel)) / F.size(rel))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    hits = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / (i + 1))), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(hits), F.lit(0.0))


def _gain(flags: Column) -> Column:
    return F.aggregate(F.transform(flags, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, b: a + b)


def ndcg_at(retrieved: Column, relevant: Column, k: int, standard: bool = False) -> Column:
    """Discounted gain over its ideal.  The ideal orders the hits among the first k; with ``standard`` it has all relevant ids instead."""
    flags = F.transform(F.slice(retrieved, 1, k), lambda x: F.when(F.array_contains(relevant, x), 1.0).otherwise(0.0))
    count = F.least(F.size(F.array_distinct(relevant)), F.lit(k)) if standard else F.aggregate(flags, F.lit(0.0), lambda a, b: a + b).cast("int")
    ideal = F.when(count > 0, _gain(F.array_repeat(F.lit(1.0), count)))
    return F.coalesce(F.when(ideal > 0, _gain(flags) / ideal), F.lit(0.0))


def per_query(ranked: DataFrame, relevance: DataFrame, ks: list[int]) -> DataFrame:
    """Metrics of every query of ``relevance``; one without results has an empty list."""
    joined = relevance.join(ranked_lists(ranked), "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast(dict(relevance.dtypes)["relevant"])))
    r, rel = F.col("retrieved"), F.col("relevant")
    return joined.select("query_id", reciprocal_rank(r, rel).alias("mrr"), *(recall_at(r, rel, k).alias(f"recall_at_{k}") for k in ks), *(ndcg_at(r, rel, k).alias(f"ndcg_at_{k}") for k in ks))


def summary(metrics: DataFrame, ks: list[int]) -> DataFrame:
    """Means over all queries (0 without any) and how many found nothing at the largest k."""
    names = ["mrr", *(f"recall_at_{k}" for k in ks), *(f"ndcg_at_{k}" for k in ks)]
    return metrics.agg(F.count("*").alias("num_queries"), F.count_if(F.col(f"recall_at_{max(ks)}") == 0).alias("num_zero_recall"), *(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names))


def stage_metrics(traces: DataFrame, relevance: DataFrame) -> DataFrame:
    """stage, recall_at_5, recall_at_10, mrr: means over all queries; a query that lacks a stage counts 0 there, or 1 in recall where nothing is relevant and the stage is there."""
    lists = traces.groupBy("stage", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    spark = traces.sparkSession
    grid = relevance.crossJoin(spark.createDataFrame([(s,) for s in STAGES], "stage string")).join(lists, ["stage", "query_id"], "left")
    r, rel = F.col("retrieved"), F.col("relevant")
    zero = lambda c: F.coalesce(F.when(r.isNotNull(), c), F.lit(0.0))
    return grid.groupBy("stage").agg(F.avg(zero(recall_at(r, rel, 5))).alias("recall_at_5"), F.avg(zero(recall_at(r, rel, 10))).alias("recall_at_10"), F.avg(zero(reciprocal_rank(r, rel))).alias("mrr"))


def bad_cases(traces: DataFrame, relevance: DataFrame) -> DataFrame:
    """query_id, category for queries whose final ten hold nothing relevant; a query may be in several."""
    hit = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("recall"))), F.lit(0.0)).alias(s)
    lists = traces.groupBy("stage", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    flat = relevance.join(lists, "query_id", "left").withColumn("recall", F.when(F.col("retrieved").isNotNull(), recall_at(F.col("retrieved"), F.col("relevant"), 10)))
    wide = flat.groupBy("query_id").agg(*(hit(s) for s in STAGES), F.max(F.size("relevant")).alias("n")).where("final = 0 and n > 0")
    found = (F.col("bm25") > 0) | (F.col("vector") > 0)
    kinds = F.array(F.when(~found, F.lit("knowledge_gap")), F.when(found, F.lit("ranking_failure")), F.when((F.col("rrf") > 0) & (F.col("reranker") < F.col("rrf")), F.lit("reranker_regression")))
    return wide.select("query_id", F.explode(F.array_compact(kinds)).alias("category"))


def nearest_rank(column: str, p: float) -> Column:
    """The ceil(p * n)-th smallest value of a column; null without any."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")
