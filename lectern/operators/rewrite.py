"""Query rewriting: synonym variants, and merging what a model proposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize

#: word -> its two substitutes, in the order in which they are tried
SUBSTITUTES = [
    ("setup", "initialize|configure"), ("connect", "attach|bind"), ("error", "status|result code"), ("config", "settings|parameters"), ("create", "instantiate|construct"),
    ("run", "execute|start"), ("stop", "halt|terminate"), ("get", "retrieve|query"), ("set", "assign|write"), ("toolpath", "tool path|toolpath calculation"),
    ("axis", "multi axis|5 axis"), ("render", "rendering|display"), ("simulate", "simulation|emulate"), ("transform", "transformation|matrix"),
]


def variants(query: Column, limit: int = 3) -> Column:
    """The query and up to ``limit`` variants.

    A word must be a whole token to be tried, but is replaced wherever its
    letters occur, in the lower-cased query.  Symbol lookups and single words
    have no variants.
    """
    words = tokenize(query)
    tries = [F.when(F.array_contains(words, w), F.replace(F.lower(query), F.lit(w), F.lit(s))) for w, both in SUBSTITUTES for s in both.split("|")]
    made = F.array_except(F.array_distinct(F.filter(F.array(*tries), lambda x: x.isNotNull())), F.array(query))
    some = (query != "") & ~query.contains("::") & (F.size(words) != 1)
    return F.when(F.coalesce(some, F.lit(False)), F.concat(F.array(query), F.slice(made, 1, limit))).otherwise(F.array(query))


def variant_queries(queries: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, nth (0: as given), query."""
    return queries.select("query_id", F.posexplode(variants(F.col("query"), limit)).alias("nth", "query"))


REPLY = "completed string, sub_queries array<string>, variants array<string>"


def parse_reply(reply: Column) -> Column:
    """A model's reply as a struct: the text as JSON, else its first braces without braces inside, else null."""
    direct = F.from_json(reply, REPLY)
    inner = F.from_json(F.regexp_extract(reply, r"(?s)(\{[^{}]*\})", 1), REPLY)
    some = lambda s: s.isNotNull() & (s["completed"].isNotNull() | s["sub_queries"].isNotNull() | s["variants"].isNotNull())
    return F.when(some(direct), direct).when(some(inner), inner)


def apply_replies(queries: DataFrame, replies: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(query_id, query for vectors) and (query_id, query for keywords, the given one included).

    Where the model's reply (query_id, reply) has a completed query, that goes to
    the vectors and its variants and parts to the keywords; else the synonyms do.
    """
    parsed = queries.join(replies, "query_id", "left").withColumn("r", parse_reply(F.col("reply")))
    ok = F.coalesce(F.col("r.completed") != "", F.lit(False))
    none = F.array().cast("array<string>")
    more = F.concat(F.coalesce("r.variants", none), F.coalesce("r.sub_queries", none))
    vector = parsed.select("query_id", F.when(ok, F.col("r.completed")).otherwise(F.col("query")).alias("query"))
    keyword = parsed.select("query_id", F.explode(F.when(ok, F.concat(F.array("query"), more)).otherwise(variants(F.col("query"), limit))).alias("query"))
    return vector, keyword


def search_variants(postings: DataFrame, given: DataFrame, depth: int, weights) -> DataFrame:
    """Keyword search of all variants; each runs to ``depth`` by itself before they merge."""
    from .bm25 import search
    from .fusion import best_of_variants

    order = Window.partitionBy("query_id").orderBy("query")
    numbered = given.distinct().withColumn("v", F.row_number().over(order)).select(F.struct("query_id", "v").alias("query_id"), "query")
    hits = search(postings, numbered, depth, weights).select("query_id.query_id", "chunk_id", "score")
    return best_of_variants(hits, depth)
