"""Continuous indexing, an extension: new element files flow into the store as they land, and searches see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import chunking
from ..plans.indexing import refresh, replace_chunks
from ..schema import ELEMENT
from ..sources.store import Store


def apply_batch(store: Store, elements: DataFrame, config: Config = Config(), embed=None) -> list[str]:
    """One batch of parsed elements into chunks, vectors, postings and symbols; the collections that changed.  Applying it twice changes nothing."""
    changed = replace_chunks(store, chunking.collapse_ids(chunking.build_chunks(elements, config.chunk_max_chars)))
    refresh(store, config, changed, embed)
    return changed


def start(spark: SparkSession, folder: str, store: Store, checkpoint: str, config: Config = Config(), embed=None, **trigger):
    """A query that upserts JSON lines of elements from ``folder``; ``trigger`` as for writeStream.trigger."""
    stream = spark.readStream.schema(ELEMENT).json(folder)
    write = stream.writeStream.foreachBatch(lambda df, _: apply_batch(store, df, config, embed) and None).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()
