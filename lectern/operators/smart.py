"""Code-aware search: symbols in code-usage payloads lead to the documentation query."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .symbols import match_api

NAMED = tuple("symbol qualified_name symbol_id symbol_name".split())
HINTS = frozenset((*NAMED, *"path file_path file location signature type kind".split()))


def decode(content: Column) -> Column:
    """A tool result (JSON) as its payload: the text items of ``content``, one a line, if there are any; else the result as it is."""
    items = F.from_json(content, "content array<struct<type string, text string>>")["content"]
    texts = F.transform(F.filter(items, lambda i: (i["type"] == "text") & i["text"].isNotNull()), lambda i: i["text"])
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(content)


def names_in(value) -> list[str]:
    """Symbol names in a decoded payload, in order and once each: of symbol keys, of ``name`` beside a hint, and of Markdown headings."""
    found: dict[str, None] = {}
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):  # a name that is due now
            found.setdefault(v[0])
        elif isinstance(v, dict):
            hinted = bool(HINTS & v.keys()) and isinstance(v.get("name"), str) and v["name"].strip().lower() not in ("search result", "search results")
            nexts = []
            for k, x in v.items():
                if isinstance(x, str) and x and (k in NAMED or (k == "name" and hinted)):
                    nexts.append((x,))
                nexts.append(x)
            todo.extend(reversed(nexts))
        elif isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, str):
            for line in v.split("\n"):
                head, sep, tail = line.rstrip().rpartition(" (")
                if line.startswith("### ") and sep and tail.endswith(")") and len(tail) > 1 and ")" not in tail[:-1] and head[4:].strip():
                    found.setdefault(head[4:].strip())
    return list(found)


def symbol_names(payload: Column) -> Column:
    """Names in a payload column; text that is no JSON counts as text.  The scan is recursive, so it is an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def scan(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return []
            try:
                return names_in(json.loads(x))
            except ValueError:
                return names_in(x)

        return s.map(one)

    return scan(payload)


def api_matches(usages: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """usages: query_id, payload.  (query_id, symbol_id in order, once each) and (query_id, name) of what has no match."""
    named = usages.select("query_id", F.posexplode(symbol_names(decode(F.col("payload")))).alias("place", "name"))
    found = match_api(named.select("name").distinct(), index).select("name", "symbol_id")
    joined = named.join(found, "name", "left")
    matched = joined.where("symbol_id is not null").groupBy("query_id", "symbol_id").agg(F.min("place").alias("place"))
    return matched, joined.where("symbol_id is null").select("query_id", "name")


def doc_queries(queries: DataFrame, matched: DataFrame, available: bool = True) -> DataFrame:
    """query_id, query, degraded: the matched symbols in order, or the query as given where none matched or code search isn't there."""
    if not available:
        return queries.select("query_id", "query", F.lit(True).alias("degraded"))
    joined = matched.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol_id"))), lambda x: x["symbol_id"]), " ").alias("symbols"))
    return queries.join(joined, "query_id", "left").select("query_id", F.coalesce("symbols", "query").alias("query"), F.lit(False).alias("degraded"))
