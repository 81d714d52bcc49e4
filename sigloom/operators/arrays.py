"""Pieces of series as arrays in rows, and Arrow batches of them in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Values that a worker handles at once, about.
AT_ONCE = 1 << 20


def listed(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(row of each entry, the entries' fields) of a column of lists of structs."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().flatten()


def numbers(column: pa.Array) -> np.ndarray:
    """Values as doubles, nulls as zeros."""
    return np.asarray(column.fill_null(0.0) if column.null_count else column, float)


def keys(df: DataFrame, by: list[str], more: str) -> StructType:
    fields = [StructField(f.name, f.dataType) for f in (df.schema[c] for c in by)]
    return StructType(fields + StructType.fromDDL(more).fields)


def repeated(batch: pa.RecordBatch, n: int, rows: np.ndarray, columns: list[np.ndarray], schema: list[str]) -> pa.RecordBatch:
    """The first ``n`` columns of ``batch`` at ``rows``, then ``columns``."""
    at = pa.array(rows.astype(np.int64))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(n)), *map(pa.array, columns)], schema)


def slices(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``AT_ONCE`` values, if a row has ``values``."""
    step = max(1, AT_ONCE // values)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def chunked(rows: DataFrame, by: list[str], first: Column, last: Column, *fields: str) -> DataFrame:
    """(by, chunk, entries): the ``fields`` of the rows of each chunk, a row being in the chunks from ``first`` to ``last``."""
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), last.cast("long"))))
    return chunks.groupBy(*by, "chunk").agg(F.collect_list(F.struct(*fields)).alias("entries"))
