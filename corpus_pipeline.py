"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and is written as Parquet and read again as the next one's docs.  All but
the last return the columns of ``documents`` (or of the docs given, whatever
columns these have besides, under whatever names); the last returns windows, as
``lectern.llm.packing.pack`` describes them.

Defined cases, for every stage: an empty table gives an empty result; a null in
``lang``, ``source`` or ``n_chars`` is a value like any other; texts of any
length are taken whole.  What each stage does with null ids, null and empty
texts, ties and repeated rows is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from lectern.llm.shared import run_folder
from lectern.session import share_code


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls toxic go.

    Null and wordless texts stay, as do rows with a null id if they aren't toxic;
    rows of equal text share one decision, and repeated rows stay repeated.
    """
    labels = share_code(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of connected near copies stays, that of the smallest id (of equal ids, the smaller text hash).

    Rows with a null id, and null and wordless texts, stay, as often as they are
    there.  Repeated rows are copies: one stays.  Rows that share an id but not their
    text are different documents.
    """
    share_code(spark)
    return jaccard_join.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur earlier in the corpus, by id and place, are cut out, and ``n_chars`` is counted again.

    A document of which nothing is left goes.  Rows with a null id, and null texts,
    stay as they are; rows equal in id and text are one occurrence, and all stay.
    """
    share_code(spark)
    return suffix_dedup.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by target weights of domain, language and source; a row that two epochs take comes twice.

    A null level is the level '', a source without a number of the domain ``other``;
    null texts have no tokens; rows that share an id enter or stay out together.
    """
    share_code(spark)
    return mixing.mix_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens in the order of the documents.

    Rows with a null id or without words are in no window; rows that share an id
    follow each other by text hash, repeated rows as often as they are there.
    """
    share_code(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]

#: a trained classifier, a dynamic program: SQL can't express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the whole pipeline over ``documents``.  The stages' tables go when the process ends."""
    docs = share_code(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
