"""Blocks of one table against blocks of another, in cells that are shuffled like any other rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Cell(Protocol):
    """What a cell does with the rows of the second table, which come batch by batch."""

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def result(self) -> Iterator[pa.RecordBatch]: ...


def dealt(key: Column | str, blocks: int) -> Column:
    """The block of a row among so many of about equal size."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def every(blocks: int) -> Column:
    """A copy of the row for each block."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


def meet(left: DataFrame, right: DataFrame, work: Callable[[pa.Table], Cell], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """Both tables have a column `cell`; rows of one cell meet in one task.

    A cell's rows of `left` are few by construction and are held, those of `right` stream past them, sorted by `order`. The
    plan has one shuffle, whatever the number of cells.
    """
    names = [c for c in [*left.columns, *right.columns] if c != "cell"]
    if len(set(names)) < len(names):
        raise ValueError("the two tables share a column besides cell")
    both = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    mine, theirs = [c for c in left.columns if c != "cell"], [c for c in right.columns if c != "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *ends], [*ends, len(cells)], strict=True):
                if z <= a:
                    continue
                if cells[a] != at:
                    if state is not None:
                        yield from state.result()
                    at, held, state = cells[a], [], None
                part = batch.slice(a, z - a)
                if kinds[a] == 0:
                    held.append(part.select(mine))
                elif held:
                    state = work(pa.Table.from_batches(held)) if state is None else state
                    yield from state.add(part.select(theirs))
        if state is not None:
            yield from state.result()

    return both.repartition("cell").sortWithinPartitions("cell", "kind", *order).mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten(), np.float64)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), max(lengths, default=0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out
