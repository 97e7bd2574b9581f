"""Documentation of classes and functions by name, for tables of names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import bm25
from ..session import settled
from .hybrid import Index, search


def _found(index: Index, queries: DataFrame, config: Config, top_k: int, label: str | None, embed) -> DataFrame:
    return search(index, queries.select("query_id", "query"), config, top_k=top_k, source_label=label, skip_rerank=True, embed=embed).final.select("query_id", "chunk_id", "score", "rank")


def _by_source(index: Index, known: DataFrame, config: Config, top_k: int, embed) -> DataFrame | None:
    """Searches of known (query_id, query, source_label), each in its own source; one plan a source."""
    out = None
    for (label,) in sorted(known.select("source_label").distinct().collect()):
        found = _found(index, known.where(F.col("source_label") == label), config, top_k, label, embed)
        out = found if out is None else out.unionByName(found)
    return out


def _asked(index: Index, known: DataFrame, other: DataFrame) -> tuple[Index, DataFrame, DataFrame]:
    """Known and other names (query_id, query) as written tables, whose sizes Spark knows, and the index with the postings that both need."""
    both = settled(known.unionByName(other, allowMissingColumns=True), "names")
    index = replace(index, postings=bm25.postings_for(index.postings, both))
    return index, both.where("source_label is not null"), both.where("source_label is null").drop("source_label")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def api_classes(index: Index, symbols: DataFrame, names: DataFrame, config: Config = Config(), embed=None) -> DataFrame:
    """query_id, chunk_id, score, rank for names (query_id, class_name).

    A class in the symbol index: its members among the first 20 that its name finds
    in its source.  Another name: the first 10 for "class <name>".
    """
    classes = symbols.where("type = 'class'").select(F.col("symbol_id").alias("class_name"), "source_label")
    known = names.join(classes, "class_name").select("query_id", F.col("class_name").alias("query"), "source_label")
    other = names.join(classes, "class_name", "left_anti").select("query_id", F.concat(F.lit("class "), "class_name").alias("query"))
    index, known, other = _asked(index, known, other)
    rest = _found(index, other, config, 15, None, embed).where("rank <= 10")
    hits = _by_source(index, known, config, 20, embed)
    if hits is None:
        return rest
    hits = settled(hits.join(names.select("query_id", "class_name"), "query_id"), "class-hits")
    members = index.chunks.where("type <> 'narrative'").join(hits, ["chunk_id", "class_name"], "left_semi").select("chunk_id", "class_name")  # the few that were found, not all
    own = _ranked(hits.join(members, ["chunk_id", "class_name"], "left_semi").drop("class_name"))
    return own.select("query_id", "chunk_id", "score", "rank").unionByName(rest)


def api_functions(index: Index, symbols: DataFrame, names: DataFrame, config: Config = Config(), embed=None) -> DataFrame:
    """query_id, chunk_id, score, rank for names (query_id, function_name, class_name or null).

    A function in the symbol index, first as the class's and then by its bare name:
    the first 5 that its symbol finds in its source.  Another name: the first 10.
    """
    full = F.when(F.coalesce("class_name", F.lit("")) != "", F.concat_ws("::", "class_name", "function_name"))
    tries = names.select("query_id", F.posexplode(F.array_compact(F.array(full, F.col("function_name")))).alias("nth", "symbol_id"))
    first = tries.join(symbols.select("symbol_id", "source_label"), "symbol_id").groupBy("query_id").agg(F.min_by(F.struct("symbol_id", "source_label"), "nth").alias("s"))
    known = first.select("query_id", F.col("s.symbol_id").alias("query"), F.col("s.source_label").alias("source_label"))
    other = names.join(first, "query_id", "left_anti").select("query_id", F.coalesce(full, "function_name").alias("query"))
    index, known, other = _asked(index, known, other)
    rest = _found(index, other, config, 10, None, embed)
    hits = _by_source(index, known, config, 5, embed)
    return rest if hits is None else hits.unionByName(rest)
