"""Incremental crawling: files against the state of the last run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import file_type

STATE = "source_label string, rel_path string, sha1 string, mtime long, size long"


def module_of(rel_path: Column) -> Column:
    """The first folder of a path, ``root`` without one; backslashes count as slashes."""
    parts = F.split(F.translate(rel_path, "\\", "/"), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("root")


def qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system names it in the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def list_files(spark: SparkSession, label: str, root: str) -> DataFrame:
    """Files of a source with a known type: source_label, source_module, rel_path, file_path, file_type, mtime, size and content, which is read only where it is used."""
    base = qualified(spark, root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(re.sub(r"([\\*?\[\]{}])", r"\\\1", base))
    rel = F.substring("path", F.lit(len(base) + (not base.endswith("/")) + 1), F.length("path"))
    files = read.select(F.lit(label).alias("source_label"), rel.alias("rel_path"), F.col("path").alias("file_path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return files.withColumn("file_type", file_type(F.col("rel_path"))).where("file_type <> 'unknown'").withColumn("source_module", module_of(F.col("rel_path")))


def crawl_all(spark: SparkSession, sources: dict[str, str]) -> DataFrame | None:
    out = None
    for label, root in sorted(sources.items()):
        files = list_files(spark, label, root)
        out = files if out is None else out.unionByName(files)
    return out


def changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files with sha1 and needs_index: new ones, and those whose time or size differ and whose content does too.  An untouched file's content isn't hashed."""
    old = state.select("source_label", "rel_path", F.col("sha1").alias("old_sha1"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    joined = files.join(old, ["source_label", "rel_path"], "left")
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    now = F.when(F.coalesce(same, F.lit(False)), F.col("old_sha1")).otherwise(F.sha1("content"))
    return joined.withColumn("sha1", now).withColumn("needs_index", F.coalesce(F.col("sha1") != F.col("old_sha1"), F.lit(True))).drop("old_sha1", "old_mtime", "old_size")


def deleted(files: DataFrame, state: DataFrame) -> DataFrame:
    """State rows whose file is gone."""
    return state.join(files.select("source_label", "rel_path"), ["source_label", "rel_path"], "left_anti")


def next_state(files: DataFrame, state: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """State after a run: what is there now, and what other sources had.  A file in ``failed`` keeps its old row or has none, so that it is tried again."""
    now = files.select("source_label", "rel_path", "sha1", "mtime", "size")
    if failed is not None:
        bad = failed.select("source_label", "rel_path")
        now = now.join(bad, ["source_label", "rel_path"], "left_anti").unionByName(state.join(bad, ["source_label", "rel_path"], "left_semi"))
    others = state.join(files.select("source_label").distinct(), "source_label", "left_anti")
    return now.unionByName(others.select(now.columns))
