"""Prompt context from ranked results, within a token budget: window functions over each query's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "=" * 60


def nothing_for(query: str) -> str:
    return f"No documentation was found for: {query}"


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _some(c: str, *text: Column) -> Column:
    """The text where a column has one, else null, which leaves no line."""
    return F.when(F.col(c) != "", F.concat(*text))


def _code(c: str) -> Column:
    return F.concat(F.lit("```cpp\n"), F.col(c), F.lit("\n```"))


def entry(lead: Column) -> Column:
    """One result's lines; ``lead`` is null where its source is that of the entry before."""
    title = F.concat(F.lit("\n### ["), F.upper(_blank("type")), F.lit("] "), F.when(_blank("symbol_id") != "", F.col("symbol_id")).otherwise("(narrative)"))
    source = F.concat(F.lit("*Source: "), _blank("source_file"), F.lit(" | Score: "), F.format_string("%.4f", F.round("score", 4)), F.lit("*"))
    links = F.when(F.size(F.coalesce("see_also", F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n*See also: "), F.array_join("see_also", ", "), F.lit("*")))
    return F.concat_ws("\n", lead, title, _some("signature", _code("signature")), source, _some("remarks", F.col("remarks")), _some("example", F.lit("\n**Example:**\n"), _code("example")), links)


def head(query: Column) -> Column:
    return F.concat(F.lit('[Context — Query: "'), query, F.lit('"]\n' + RULE))


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def build_context(results: DataFrame, queries: DataFrame, max_tokens: int = 6000) -> DataFrame:
    """query_id, context, chunks; ``results`` has the chunk columns and score.

    Entries go by score, brought together by source and module in the order in which
    these first appear.  The entry in which the budget ends is cut there and is the
    last.  A query without results has a note that says so.
    """
    named = lambda c, other: F.when(_blank(c) != "", F.col(c)).otherwise(other).alias(f"_{c}")
    columns = ["query_id", "chunk_id", "score", "type", "symbol_id", "signature", "source_file", "remarks", "example", "see_also"]
    rows = results.select(*columns, named("source_label", "unknown"), named("source_module", "root")).join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    rows = rows.withColumn("s", F.min("place").over(Window.partitionBy("query_id", "_source_label"))).withColumn("m", F.min("place").over(Window.partitionBy("query_id", "_source_label", "_source_module")))
    order = Window.partitionBy("query_id").orderBy("s", "m", "place")
    fresh = F.coalesce(F.lag("s").over(order) != F.col("s"), F.lit(True))
    told = rows.withColumn("nth", F.row_number().over(order)).withColumn("text", entry(F.when(fresh, F.concat(F.lit("\n## Source: "), "_source_label"))))
    room = F.lit(max_tokens) - tokens(head(F.col("query"))) - F.coalesce(F.sum(tokens(F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = told.withColumn("room", room).where("nth = 1 or room > 0")
    short = F.concat(F.substring("text", F.lit(1), F.greatest(F.col("room"), F.lit(0)).cast("int") * 4), F.lit("\n[...truncated]"))
    kept = kept.withColumn("text", F.when(tokens(F.col("text")) > F.col("room"), short).otherwise(F.col("text")))
    body = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n").alias("body"), F.count("*").alias("chunks"))
    whole = F.concat(head(F.col("query")), F.lit("\n"), F.col("body"), F.lit("\n\n---\n*"), F.col("chunks").cast("string"), F.lit(" chunks included in context.*"))
    none = F.concat(F.lit(nothing_for("")), F.coalesce("query", F.lit("")))
    return queries.select("query_id", "query").join(body, "query_id", "left").select("query_id", F.coalesce(whole, none).alias("context"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
