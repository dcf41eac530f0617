"""Sums of arrays over a table, for models that are fitted from totals.

A task adds up one array over all its rows; the arrays are cut into parts and the parts
of all tasks are added by reducers, so neither driver nor reducer holds an array per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers that travel together.
PART = 1 << 14


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed(df: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``kernel(batch)``, an array of ``size`` numbers, over all batches of all tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(batch)
        cuts = range(0, size, PART)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at // PART for at in cuts], pa.int32()), pa.array([total[at:at + PART].tobytes() for at in cuts], pa.binary())],
            names=["part", "v"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = np.frombuffer(v.as_py(), dtype=np.float64)
                held[part] = held[part] + numbers if part in held else numbers
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "v"]
        )

    schema, out = "part int, v binary", np.zeros(size)
    for row in df.mapInArrow(partial, schema).repartition("part").mapInArrow(add, schema).collect():
        v = np.frombuffer(row["v"], dtype=np.float64)
        out[row["part"] * PART:row["part"] * PART + len(v)] = v
    return out
