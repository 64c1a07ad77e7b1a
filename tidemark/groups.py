"""Sorted partitions as Arrow tables of whole groups, for operators that work on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS_AT_ONCE = 65_536


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Marks the rows at which a group of equal keys begins; the keys hold no nulls."""
    n = table.num_rows
    marks = np.ones(n, bool)
    if n > 1:
        marks[1:] = False
        for k in keys:
            column = table.column(k)
            marks[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
    return marks


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_once: int = ROWS_AT_ONCE) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of some at_once rows that cut no group in two, and the number of each row's group. What is held back is one
    group at most, and a group is a shard that the caller has bounded."""
    held: list[pa.RecordBatch] = []
    rows = wanted = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < max(wanted, at_once):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        marks = starts_of(table, keys)
        last = int(np.flatnonzero(marks)[-1])
        if last:
            yield table.slice(0, last), np.cumsum(marks[:last])
        held = table.slice(last).to_batches()
        rows -= last
        wanted = 2 * rows  # a long group is not looked through again and again
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.cumsum(starts_of(table, keys))
