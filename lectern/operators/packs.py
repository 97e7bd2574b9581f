"""Rows in packs, so that two tables meet pack by pack in a vectorised kernel.

``meet`` is a join without keys whose rows are packs: Spark broadcasts the packs
of one side while they are small and takes their product where they aren't, so
the plan is one for every size and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def pack(df: DataFrame, prefix: str, size_of: str | None = None) -> DataFrame:
    """One row for a batch of rows, each column an array; rows of unequal length of the array ``size_of`` are kept apart, that length in ``<prefix>size``."""
    fields = df.schema.fields
    at = df.columns.index(size_of) if size_of else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column(at)) if at is not None else pa.array([0] * batch.num_rows, pa.int32())
            for size in sorted(set(sizes.to_pylist())):
                part = batch.filter(pc.equal(sizes, size))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *lists], names=[f"{prefix}size", *(prefix + f.name for f in fields)])

    schema = T.StructType([T.StructField(f"{prefix}size", T.IntegerType()), *(T.StructField(prefix + f.name, T.ArrayType(f.dataType)) for f in fields)])
    return df.mapInArrow(run, schema)


def meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pack ``l_…`` beside every pack ``r_…`` of the same size."""
    return left.join(right, (left["l_size"] <= right["r_size"]) & (left["l_size"] >= right["r_size"]))
