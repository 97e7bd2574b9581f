"""The index store: Parquet in parts, of which a run writes only those that changed.

A table's rows belong to parts by one column (such as ``collection``).  A
manifest, a small JSON file with a number, says which folder holds each part; a
run writes its parts to a folder of its own and then a manifest with the next
number, so readers never see half of a run, and a job that dies leaves the last
state as it was.  Of two runs that end at once the second fails, as its number
is taken.  Folders that neither the last manifest nor the one before it names
are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "__part"
MANIFESTS = 2  # how many stay readable
PIECES = 64  # appended pieces after which a table is written whole


def upsert(stored: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Chunks after a run: all chunks of a file that was parsed again are replaced, those of deleted files (source_label, source_file) go."""
    files = fresh.select("source_label", "source_file").distinct()
    if gone is not None:
        files = files.unionByName(gone.select("source_label", "source_file")).distinct()
    kept = stored.join(files, ["source_label", "source_file"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def part_of(column: str):
    return F.substring(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256), 1, 24)


class Store:
    """Named tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _list(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def _numbers(self, table: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list(f"{self.path}/{table}/manifests") if n.endswith(".json"))

    def _manifest(self, table: str, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{table}/manifests/{number}.json", wholetext=True).first()[0])

    def _current(self, table: str) -> tuple[int, dict | None]:
        numbers = self._numbers(table)
        return (numbers[-1], self._manifest(table, numbers[-1])) if numbers else (0, None)

    def state(self, table: str) -> int:
        """A number that changes when the table does."""
        return (self._numbers(table) or [0])[-1]

    def read(self, table: str) -> DataFrame | None:
        _, now = self._current(table)
        if now is None:
            return None
        schema = T.StructType.fromJson(now["schema"])
        paths = sorted(f"{self.path}/{table}/{p}" for p in now["parts"].values())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, table: str, number: int, schema: T.StructType, parts: dict[str, str]) -> None:
        fs, target = self._fs(f"{self.path}/{table}/manifests/{number + 1}.json")
        stream = fs.create(target, False)  # fails where another run took the number
        stream.write(bytearray(json.dumps({"schema": json.loads(schema.json()), "parts": parts}).encode()))
        stream.close()
        self._prune(table)

    def _prune(self, table: str) -> None:
        numbers = self._numbers(table)
        for old in numbers[:-MANIFESTS]:
            fs, target = self._fs(f"{self.path}/{table}/manifests/{old}.json")
            fs.delete(target, False)
        named = {p for n in numbers[-MANIFESTS:] for p in self._manifest(table, n)["parts"].values()}
        for run in self._list(f"{self.path}/{table}"):
            if run == "manifests":
                continue
            parts = [p for p in self._list(f"{self.path}/{table}/{run}") if p.startswith(PART)]
            gone = [f"{run}/{p}" for p in parts if f"{run}/{p}" not in named]
            for path in [run] if len(gone) == len(parts) and run not in named else gone:
                fs, target = self._fs(f"{self.path}/{table}/{path}")
                fs.delete(target, True)

    def write(self, table: str, df: DataFrame, by: str | None = None) -> None:
        """The whole table anew."""
        number, _ = self._current(table)
        self._commit(table, number, df.schema, self._save(table, df, by))

    def _save(self, table: str, df: DataFrame, by: str | None) -> dict[str, str]:
        run = uuid.uuid4().hex
        if by is None:
            df.write.parquet(f"{self.path}/{table}/{run}")
            return {run: run}
        placed = df.withColumn(PART, part_of(by))
        placed.repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{table}/{run}")
        return {name.partition("=")[2]: f"{run}/{name}" for name in self._list(f"{self.path}/{table}/{run}") if name.startswith(PART + "=")}

    def replace(self, table: str, df: DataFrame, by: str, values: Iterable[str]) -> None:
        """The parts of ``values`` of column ``by`` become the rows of ``df``, which has no others; the rest stays unread."""
        values = list(values)
        number, now = self._current(table)
        if now is None:
            self.write(table, df, by)
            return
        keys = {r[0] for r in self.spark.createDataFrame([(v,) for v in values], f"{by} string").select(part_of(by)).collect()} if values else set()
        kept = {k: p for k, p in now["parts"].items() if k not in keys}
        self._commit(table, number, T.StructType.fromJson(now["schema"]), kept | (self._save(table, df.select(*T.StructType.fromJson(now["schema"]).names), by) if values else {}))

    def append(self, table: str, df: DataFrame) -> None:
        """More rows; once there are many pieces the table is written whole."""
        number, now = self._current(table)
        if now is None or len(now["parts"]) >= PIECES:
            old = self.read(table)
            self.write(table, df if old is None else old.unionByName(df))
            return
        self._commit(table, number, df.schema, now["parts"] | self._save(table, df, None))
