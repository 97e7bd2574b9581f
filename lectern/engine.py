"""The engine: eleven operations by name over one store."""

from __future__ import annotations

import math
import os
import time
from collections import OrderedDict
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, save_config
from .operators import context, evaluate, fusion, smart, symbols, vector
from .operators.chunking import result_rows
from .plans import hybrid, indexing, lookups
from .sources.store import Store


KEPT = 128


class Engine:
    """Single-query calls for people and tools; batches go to ``search_batch``."""

    def __init__(self, spark: SparkSession, config: Config, config_path: str | None = None, embed=None):
        self.spark, self.config, self.config_path = spark, config, config_path
        self.embed = embed or vector.hashing_embedder(config.embed_dims)
        self.store = Store(spark, config.db_path)
        self._kept: OrderedDict = OrderedDict()

    def index(self) -> hybrid.Index | None:
        chunks = self.store.read("chunks")
        return None if chunks is None else hybrid.Index(chunks, self.store.read("postings"), self.store.read("vectors"))

    def search_batch(self, queries: DataFrame, **options) -> hybrid.Found | None:
        index = self.index()
        if index is None:
            return None
        return hybrid.search(index, queries, self.config, embed=self.embed, **options)

    def _one(self, query: str, **options) -> list[dict]:
        """Results for one query; the last 128 are kept while the store and the sources stay as they are."""
        key = (query, repr(sorted(options.items())), self.store.state("chunks"), self.store.state("postings"), tuple(self.config.doc_sources))
        if key not in self._kept:
            self._kept[key] = self._search_one(query, **options)
            while len(self._kept) > KEPT:
                self._kept.popitem(last=False)
        self._kept.move_to_end(key)
        return [dict(r) for r in self._kept[key]]

    def latencies(self, queries: list[str], **options) -> dict[str, float]:
        """Seconds of single searches: the nearest-rank 50th and 95th percentile."""
        took = []
        for q in queries:
            start = time.perf_counter()
            self._search_one(q, **options)
            took.append(time.perf_counter() - start)
        took.sort()
        return {f"p{p}": took[max(0, math.ceil(p / 100 * len(took)) - 1)] for p in (50, 95)} if took else {"p50": 0.0, "p95": 0.0}

    def _search_one(self, query: str, **options) -> list[dict]:
        queries = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        found = self.search_batch(queries, **options)
        return [] if found is None else self._shown(found.final)

    def _shown(self, ranked: DataFrame) -> list[dict]:
        active = self.spark.createDataFrame([(x,) for x in self.config.doc_sources] or [("",)], "label string")
        rows = fusion.active_only(hybrid.with_chunks(ranked, self.store.read("chunks")), active)
        ranks = rows.select("chunk_id", "rank")
        return [r.asDict() for r in result_rows(rows).join(ranks, "chunk_id").orderBy("rank").drop("rank").collect()]

    # the operations

    def find_symbol(self, symbol_id: str) -> dict | None:
        index = indexing.symbols_of(self.store)
        row = None if index is None else index.where(F.col("symbol_id") == symbol_id).first()
        return row.asDict() if row and row["source_label"] in self.config.doc_sources else None

    def search_docs(self, query: str, top_k=10, **options) -> list[dict]:
        """``options``: source_label, module and what else hybrid.search takes."""
        return self._one(query, top_k=top_k, **options)

    def get_api_class(self, class_name: str) -> list[dict]:
        return self._looked_up(lookups.api_classes, [(0, class_name)], "query_id long, class_name string")

    def get_api_function(self, function_name: str, class_name: str | None = None) -> list[dict]:
        return self._looked_up(lookups.api_functions, [(0, function_name, class_name)], "query_id long, function_name string, class_name string")

    def _looked_up(self, plan, names: list[tuple], schema: str) -> list[dict]:
        index = self.index()
        if index is None:
            return []
        active = indexing.symbols_of(self.store).where(F.col("source_label").isin(list(self.config.doc_sources)))
        return self._shown(plan(index, active, self.spark.createDataFrame(names, schema), self.config, self.embed))

    def list_modules(self, source_label=None) -> list[str]:
        chunks = self.store.read("chunks")
        return [] if chunks is None else sorted({r["source_module"] for r in symbols.list_modules(chunks, source_label).collect()})

    def build_context(self, query: str, max_tokens: int = 6000, top_k: int = 10, **options) -> str:
        queries = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        found = self.search_batch(queries, top_k=top_k, **options)
        if found is None:
            return context.nothing_for(query)
        return context.build_context(hybrid.with_chunks(found.final, self.store.read("chunks")), queries, max_tokens).first()["context"]

    def add_doc_source(self, label: str, path: str) -> None:
        if label in self.config.doc_sources:
            raise ValueError(f"source exists: {label}")
        if "://" not in path and not os.path.isdir(path):
            raise ValueError(f"no such folder: {path}")
        self._sources({**self.config.doc_sources, label: path})

    def remove_doc_source(self, label: str) -> None:
        """Takes the source out of the settings, then its rows out of the store; without the second step its rows are hidden anyway."""
        if label not in self.config.doc_sources:
            raise ValueError(f"no such source: {label}")
        before = self.config
        self._sources({k: v for k, v in self.config.doc_sources.items() if k != label})
        try:
            indexing.remove_source(self.store, label)
        except Exception:
            self._sources(before.doc_sources)
            raise

    def list_doc_sources(self) -> dict[str, str]:
        return dict(self.config.doc_sources)

    def reindex(self, labels: list[str] | None = None, full: bool = False) -> indexing.Totals:
        return indexing.index_all(self.spark, self.config, labels, full, self.embed)

    def index_status(self) -> dict:
        chunks = self.store.read("chunks")
        rows = [] if chunks is None else symbols.index_status(chunks).collect()
        whole = next((r for r in rows if r["source_label"] is None), {"chunks": 0, "collections": 0, "symbols": 0})
        return {"total_chunks": whole["chunks"], "collections": whole["collections"], "symbols": whole["symbols"], "per_source": {r["source_label"]: r["chunks"] for r in rows if r["source_label"] is not None}}

    # beyond the eleven

    def smart_search(self, query: str, payload: str | None, top_k: int = 10) -> dict:
        """``payload``: what code search returned for the query as JSON; None where there is no code search."""
        index = indexing.symbols_of(self.store)
        if payload is None or index is None:
            return dict(query=query, degraded=True, matched=[], unmatched=[], doc_results=self.search_docs(query, top_k))
        usages = self.spark.createDataFrame([(0, payload)], "query_id long, payload string")
        matched, missing = smart.api_matches(usages, index)
        names = [r["symbol_id"] for r in matched.orderBy("place").collect()]
        return dict(query=query, degraded=False, matched=names, unmatched=[r["name"] for r in missing.collect()], doc_results=self.search_docs(" ".join(names) or query, top_k))

    def evaluate(self, annotated: DataFrame, ks: list[int] | None = None, **options) -> dict:
        """annotated: query_id, query, relevant."""
        ks = ks or [1, 3, 5, 10]
        found = self.search_batch(annotated.select("query_id", "query"), **options)
        relevance = annotated.select("query_id", "relevant")
        traces = found.traces()
        metrics = evaluate.summary(evaluate.per_query(found.final, relevance, ks), ks).first().asDict()
        metrics["stages"] = {r["stage"]: r.asDict() for r in evaluate.stage_metrics(traces, relevance).collect()}
        metrics["bad_cases"] = [r.asDict() for r in evaluate.bad_cases(traces, relevance).collect()]
        return metrics

    def _sources(self, sources: dict[str, str]) -> None:
        self.config = replace(self.config, doc_sources=sources)
        if self.config_path:
            save_config(self.config, self.config_path)


OPERATIONS = "find_symbol search_docs get_api_class get_api_function list_modules build_context add_doc_source remove_doc_source list_doc_sources reindex index_status".split()


def call(engine: Engine, name: str, arguments: dict):
    """One of OPERATIONS, or smart_search, by name."""
    if name not in (*OPERATIONS, "smart_search"):
        raise KeyError(name)
    return getattr(engine, name)(**arguments)
