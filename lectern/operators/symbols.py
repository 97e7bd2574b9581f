"""Symbol index, lookups and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import last_member, strip_templates


COLUMNS = "symbol_id chunk_id type signature source_label source_module source_file".split()


def collection_symbols(chunks: DataFrame) -> DataFrame:
    """One row for each non-empty symbol of a collection: its first chunk by id."""
    named = chunks.where("symbol_id <> ''")
    return named.groupBy("collection", "symbol_id").agg(F.min_by(F.struct(*COLUMNS[1:]), "chunk_id").alias("c")).select("collection", "symbol_id", "c.*")


def first_symbols(symbols: DataFrame) -> DataFrame:
    """One row a symbol: that of the first collection."""
    return symbols.groupBy("symbol_id").agg(F.min_by(F.struct(*COLUMNS[1:]), F.struct("collection", "chunk_id")).alias("c")).select("symbol_id", "c.*")


def symbol_index(chunks: DataFrame) -> DataFrame:
    """One row a non-empty symbol: its first chunk by collection and id."""
    return first_symbols(collection_symbols(chunks))


def lookup(index: DataFrame, names: DataFrame) -> DataFrame:
    """Exact matches of names (symbol_id)."""
    return names.join(index, "symbol_id")


def remove_source(index: DataFrame, label: str) -> DataFrame:
    return index.where(F.col("source_label") != label)


def remove_files(index: DataFrame, label: str, files: DataFrame) -> DataFrame:
    """Without the symbols of one source's files (source_file)."""
    gone = files.select("source_file").withColumn("source_label", F.lit(label))
    return index.join(gone, ["source_label", "source_file"], "left_anti")


def candidates(symbol: Column) -> Column:
    """As given, without template arguments, and the last member; '' and repeats left out."""
    plain = strip_templates(F.trim(symbol))
    return F.filter(F.array_distinct(F.array(F.trim(symbol), plain, last_member(plain))), lambda x: x != "")


def match_api(names: DataFrame, index: DataFrame) -> DataFrame:
    """For each code symbol (name) its API symbol: the first candidate in the index.  A qualified name never falls back to its bare member."""
    plain = strip_templates(F.trim(F.col("name")))
    qualified = plain.contains("::") | plain.contains(".")
    tries = names.select("name", F.posexplode(candidates(F.col("name"))).alias("place", "symbol_id"), plain.alias("plain"), qualified.alias("qualified"))
    tries = tries.where((F.col("symbol_id") == F.col("name")) | (F.col("symbol_id") == F.col("plain")) | ~F.col("qualified"))
    first = Window.partitionBy("name").orderBy("place")
    return tries.join(index, "symbol_id").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "place", "plain", "qualified")


def class_members(chunks: DataFrame, class_name: str) -> DataFrame:
    return chunks.where((F.col("class_name") == class_name) & (F.col("type") != "narrative"))


def list_modules(chunks: DataFrame, source: str | None = None) -> DataFrame:
    return (chunks if source is None else chunks.where(F.col("source_label") == source)).select("source_label", "source_module").distinct()


def index_status(chunks: DataFrame) -> DataFrame:
    """Chunks, collections and symbols of each source and, under a null label, of all."""
    counted = [F.count("*").alias("chunks"), F.count_distinct("collection").alias("collections"), F.count_distinct(F.when(F.col("symbol_id") != "", F.col("symbol_id"))).alias("symbols")]
    return chunks.rollup("source_label").agg(*counted)
