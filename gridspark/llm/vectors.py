"""Vectors as rows of integers, and element-wise sums over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many values of all tasks together go to the driver as they are; more are summed by a shuffle before.
GATHERED = 1 << 20


def whole_vectors(rows: DataFrame, most: float) -> tuple[DataFrame, int]:
    """``rows`` with finite vectors, and x = floor(1024 * c) of each entry c as a long in their place; how many entries.

    Rows go whose vector is null, empty or holds null or non-finite entries, or has another length than most have (of
    equally frequent lengths the longest counts). Entries of x end at ``most`` on either side."""
    real = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & real)
    sizes = held.groupBy(F.size("embedding").alias("dims")).count()
    row = sizes.agg(F.max(F.struct("count", "dims"))["dims"].alias("dims")).first()
    clipped = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * 1024, F.lit(float(most))), F.lit(-float(most)))).cast("long"))
    return held.where(F.size("embedding") == F.lit(row.dims or 0)).withColumn("embedding", clipped), row.dims or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of ``dims`` values a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def summed(table: DataFrame, tasks: int, partial: Callable[[pa.RecordBatch], np.ndarray], length: int, kind: str = "double") -> np.ndarray:
    """Sum of ``partial`` over all batches of ``table``, which has ``tasks`` partitions; each task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.float64 if kind == "double" else np.int64)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["part"])

    parts = table.mapInArrow(run, f"part array<{'double' if kind == 'double' else 'bigint'}>")
    if tasks * length <= GATHERED:
        values = parts.toArrow().column("part").combine_chunks().flatten().to_numpy()
        return values.reshape(-1, length).sum(0)
    places = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    return places.orderBy("at").toArrow().column("value").to_numpy()
