"""The whole search as one plan over a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import bm25, fusion, rewrite, vector
from ..operators.evaluate import STAGES
from ..session import settled


@dataclass
class Index:
    """chunks (with collection), postings of build_index or bm25.Unwritten, vectors (chunk_id, embedding) or None."""

    chunks: DataFrame
    postings: DataFrame | bm25.Unwritten
    vectors: DataFrame | None = None


@dataclass
class Found:
    """Ranked rows of each stage: query_id, chunk_id, score, rank."""

    bm25: DataFrame
    vector: DataFrame
    rrf: DataFrame
    reranker: DataFrame
    final: DataFrame

    def traces(self) -> DataFrame:
        """stage, query_id, chunk_id, rank of all stages."""
        out = None
        for name in STAGES:
            part = getattr(self, name).select(F.lit(name).alias("stage"), "query_id", "chunk_id", "rank")
            out = part if out is None else out.unionByName(part)
        return out


def collections_of(chunks: DataFrame, label: str | None, strict: bool = False) -> list[str] | None:
    """Collections of a source; None, which means all, for no label and, unless ``strict``, for an unknown one."""
    if not label:
        return None
    found = [r[0] for r in chunks.where(F.col("source_label") == label).select("collection").distinct().collect()]
    if not found and strict:
        raise ValueError(f"unknown source: {label}")
    return found or None


def search(index: Index, queries: DataFrame, config: Config = Config(), top_k: int | None = None, module=None, source_label=None, skip_rerank=False, enable_rewrite=False, query_vectors: DataFrame | None = None, replies: DataFrame | None = None, scorer=fusion.lexical_scorer, embed=None) -> Found:
    """queries: query_id, query.  ``query_vectors`` (query_id, embedding) go to the vector side, or what ``embed`` makes of the queries; without either it finds nothing.

    ``enable_rewrite`` adds synonym variants to the keyword side, or what a model
    proposed in ``replies`` (query_id, reply); a completed query among these is
    embedded in place of the given one.  ``scorer`` None leaves fused
    scores as they are.
    """
    k = top_k or config.top_k_default
    depth = k * config.candidate_expand_factor
    names = collections_of(index.chunks, source_label)
    meant = given = queries
    if enable_rewrite:
        if replies is not None:
            meant, given = rewrite.apply_replies(queries, replies, config.query_rewrite_max_variants)
        else:
            given = rewrite.variant_queries(queries, config.query_rewrite_max_variants).select("query_id", "query")
    postings = bm25.postings_for(index.postings, given)
    if names is not None:
        postings = postings.where(F.col("collection").isin(names))
    if enable_rewrite:
        keyword = rewrite.search_variants(postings, given, depth, config.weights)
    else:
        keyword = bm25.search(postings, queries, depth, config.weights)
    if query_vectors is None and embed is not None:
        query_vectors = meant.select("query_id", embed("query").alias("embedding"))
    if query_vectors is not None and index.vectors is not None:
        vectors = index.vectors
        if names is not None and "collection" in vectors.columns:
            vectors = vectors.where(F.col("collection").isin(names))
        elif names is not None:
            vectors = vectors.join(index.chunks.where(F.col("collection").isin(names)).select("chunk_id"), "chunk_id", "left_semi")
        near = vector.knn(vectors, query_vectors, depth, config.metric)
    else:
        near = keyword.limit(0)
    # a few rows a query, from which all later stages and the traces follow
    keyword, near = settled(keyword, "keyword-hits"), settled(near, "vector-hits")
    fused = fusion.reciprocal_ranks(near, keyword, config.rrf_k, depth, config.rrf_bm25_weight)
    # of all chunks only those found are needed from here on
    ids = keyword.select("chunk_id").unionByName(near.select("chunk_id")).distinct()
    held = settled(index.chunks.join(ids, "chunk_id", "left_semi").select("chunk_id", "type", "contains_code", "references", "embed_text"), "found-chunks")
    facts = held.select("chunk_id", "type", "contains_code")
    ranked = fused
    if scorer is not None and not skip_rerank:
        decided = fusion.rerank_decision(queries, fused, config.reranker_score_gap_threshold).where("rerank").select("query_id")
        chosen = fusion.rerank_candidates(fused.join(decided, "query_id", "left_semi").join(facts.select("chunk_id", "type"), "chunk_id"), config.reranker_max_candidates)
        anew = fusion.rerank(chosen, queries, held, scorer)
        ranked = anew.select("query_id", "chunk_id", "score", "rank").unionByName(fused.join(decided, "query_id", "left_anti").select("query_id", "chunk_id", "score", "rank"))
        ranked = settled(ranked, "reranked")
    boosted = fusion.code_boost(ranked.join(facts.select("chunk_id", "contains_code"), "chunk_id"), queries, list(config.code_boost_triggers), config.code_boost_ratio)
    expanded = fusion.expand_references(boosted, index.chunks, config.ref_expansion_max, held=held)
    final = fusion.module_filter(expanded, index.chunks, module).where(F.col("rank") <= k)
    return Found(keyword, near, fused, ranked, final)


def with_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows.join(chunks, "chunk_id")
