"""Indexing as one plan: crawl, parse, chunk, embed, store.  A run reads and writes only the collections in which files changed."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import bm25, chunking, symbols, vector
from ..sources import crawl, registry
from ..sources.store import Store, upsert


@dataclass
class Totals:
    """``errors``: by source, or by file for those that can't be parsed (at most 100 of them; ``failed`` counts all)."""

    chunks: int = 0
    files: int = 0
    deleted: int = 0
    failed: int = 0
    errors: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)  # by phase

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = round(self.seconds.get(name, 0.0) + time.perf_counter() - start, 3)


def index_all(spark: SparkSession, config: Config, labels: list[str] | None = None, full: bool = False, embed=None) -> Totals:
    """Brings the store up to date with the sources.  A source that can't be read is reported and leaves the others alone."""
    store, totals = Store(spark, config.db_path), Totals()
    known = config.doc_sources if labels is None else {x: config.doc_sources[x] for x in labels}
    for label, root in sorted(known.items()):
        try:
            index_source(spark, store, config, label, root, full, embed, totals)
        except Exception as e:  # reported to the caller, source by source
            totals.errors[label] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
    chunks = store.read("chunks")
    totals.chunks = 0 if chunks is None else chunks.count()
    return totals


def index_source(spark: SparkSession, store: Store, config: Config, label: str, root: str, full: bool = False, embed=None, totals: Totals | None = None) -> Totals:
    totals = totals or Totals()
    state = store.read("state")
    if state is None:
        state = spark.createDataFrame([], crawl.STATE)
    mine = state.where(F.col("source_label") == label)
    with totals.phase("crawl"):
        files = crawl.list_files(spark, label, root)
        seen = crawl.changes(files, mine.limit(0) if full else mine)
        todo = seen.where("needs_index")
        gone = crawl.deleted(files, mine)
        totals.files += todo.count()
        totals.deleted += gone.count()
    with totals.phase("parse"):
        store.write("parsed", registry.parse_report(todo))  # read several times below
        report = store.read("parsed")
        fresh = chunking.collapse_ids(chunking.build_chunks(registry.elements_of(report), config.chunk_max_chars))
        failed = registry.failures_of(report).join(todo.select("source_label", "file_path", "rel_path"), ["source_label", "file_path"])
        for r in failed.select("file_path", "error").limit(100).collect():
            totals.errors[r["file_path"]] = r["error"]
        totals.failed += failed.count()
    with totals.phase("chunks"):
        paths = todo.select("source_label", F.col("file_path").alias("source_file"))
        left = gone.select("source_label", F.concat(F.lit(crawl.qualified(spark, root) + "/"), F.col("rel_path")).alias("source_file"))
        stored = store.read("chunks")
        if stored is not None and full:
            left = left.unionByName(stored.where(F.col("source_label") == label).select("source_label", "source_file").distinct())
        changed = replace_chunks(store, fresh, paths.unionByName(left))
    store.replace("state", crawl.next_state(seen, state, failed).where(F.col("source_label") == label), "source_label", [label])
    refresh(store, config, changed, embed, totals)
    return totals


def replace_chunks(store: Store, fresh: DataFrame, files: DataFrame | None = None) -> list[str]:
    """Puts chunks into the store in place of those of the same files and of ``files`` (source_label, source_file); the collections that this changes."""
    stored = store.read("chunks")
    if stored is None:
        changed = [r[0] for r in fresh.select("collection").distinct().collect()]
        store.write("chunks", fresh, "collection")
        return changed
    touched = fresh.select("source_label", "source_file")
    if files is not None:
        touched = touched.unionByName(files.select("source_label", "source_file"))
    old = stored.join(touched.distinct(), ["source_label", "source_file"], "left_semi").select("collection")
    changed = [r[0] for r in old.unionByName(fresh.select("collection")).distinct().collect()]
    if changed:
        store.replace("chunks", upsert(stored.where(F.col("collection").isin(changed)), fresh, files), "collection", changed)
    return changed


def refresh(store: Store, config: Config, collections: list[str], embed=None, totals: Totals | None = None) -> None:
    """Vectors, postings and symbols of these collections, from their chunks as they are now."""
    totals = totals or Totals()
    chunks = store.read("chunks")
    if chunks is None or not collections:
        return
    spark = chunks.sparkSession
    chunks = chunks.where(F.col("collection").isin(collections))
    with totals.phase("embed"):
        embed = embed or vector.hashing_embedder(config.embed_dims)
        cache = store.read("embedding_cache")
        if cache is None:
            cache = spark.createDataFrame([], "key string, embedding array<double>")
        texts = chunks.select("chunk_id", "collection", F.col("embed_text").alias("text"))
        store.write("embedded", vector.embed_missing(texts, cache, embed, "default"))  # written before it is used: each text is embedded once
        new = store.read("embedded")
        store.append("embedding_cache", new.where(vector.IS_VECTOR))
        done, _ = vector.split_cached(texts, cache.unionByName(new), "default")
        store.replace("vectors", done.select("collection", "chunk_id", "embedding"), "collection", collections)
    with totals.phase("postings"):
        store.replace("postings", bm25.build_index(chunks, config.full_fields), "collection", collections)
    with totals.phase("symbols"):
        store.replace("symbols", symbols.collection_symbols(chunks), "collection", collections)


def remove_source(store: Store, label: str) -> None:
    """Takes a source's rows out of every table; nothing else is read or written."""
    chunks = store.read("chunks")
    if chunks is not None:
        gone = [r[0] for r in chunks.where(F.col("source_label") == label).select("collection").distinct().collect()]
        for table in ("chunks", "vectors", "postings", "symbols"):
            rows = store.read(table)
            if rows is not None and gone:
                store.replace(table, rows.limit(0), "collection", gone)
    state = store.read("state")
    if state is not None:
        store.replace("state", state.limit(0), "source_label", [label])


def symbols_of(store: Store) -> DataFrame | None:
    rows = store.read("symbols")
    return None if rows is None else symbols.first_symbols(rows)
