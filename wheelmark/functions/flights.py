"""Whole flights in Arrow batches: many at once, where a group's own call to Python would cost more than its work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a block of equally long flights, at most (one flight at least).
BLOCK = 1 << 20


def starts_of(key: pa.Array) -> np.ndarray:
    """Where another key begins."""
    if len(key) < 2:
        return np.zeros(min(len(key), 1), np.int64)
    a, b = key.slice(1), key.slice(0, len(key) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1])


def in_flights(rows: DataFrame, order: list[Column], run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str, key: str = "flight_id") -> DataFrame:
    """``run`` over batches of whole flights in ``order``: it gets the rows and where each flight begins.

    A window brings a flight's rows together and in order, without a shuffle where they are already; Spark sees that they
    need no further sort. What a batch cuts off is held until its flight ends.
    """
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).sortWithinPartitions(key, *order)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            if held and not len(starts_of(pa.concat_arrays([held[-1][key].slice(held[-1].num_rows - 1), part[key]]))) > 1:
                held.append(part)
                continue
            part = pa.concat_batches([*held, part])
            at = starts_of(part[key])
            if len(at) > 1:
                yield run(part.slice(0, at[-1]), at[:-1])
            held = [part.slice(at[-1])]
        if held:
            part = pa.concat_batches(held)
            yield run(part, starts_of(part[key]))

    return placed.mapInArrow(batches, schema)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as float64, NaN for null."""
    return batch[name].cast(pa.float64()).to_numpy(zero_copy_only=False)


def alike(starts: np.ndarray, sizes: np.ndarray, cells: Callable[[int], int] = lambda n: n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flights of equal size in blocks: their numbers, and the rows of each (flights x size)."""
    for n in np.unique(sizes).tolist():
        same, many = np.flatnonzero(sizes == n), max(1, BLOCK // max(cells(n), 1))
        for a in range(0, len(same), many):
            yield same[a : a + many], starts[same[a : a + many], None] + np.arange(n)
