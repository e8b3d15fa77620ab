"""Kernels over the rows of one group after the other, without a Python call from the JVM for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows held at once, besides those of the group at hand.
HELD = 100_000


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the groups of a sorted table, and the end."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(fresh), table.num_rows)


def in_runs(rows: DataFrame, keys: Sequence[str], kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies ``kernel`` to the rows of one group of ``keys`` after the other, for many small groups.

    Rows are shuffled by the keys and sorted; a task holds HELD rows and one group at most, so groups must be
    of bounded size. A group's rows come in no order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo, hi in zip(start[:-1], start[1:]):
                yield from kernel(table.slice(lo, hi - lo)).to_batches()

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= HELD:
                table = pa.Table.from_batches(held)
                start = starts(table, keys)
                yield from whole(table, start[:-1])  # the last group may go on
                held, size = table.slice(start[-2]).to_batches(), table.num_rows - int(start[-2])
        if held:
            table = pa.Table.from_batches(held)
            yield from whole(table, starts(table, keys))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(read, schema)
