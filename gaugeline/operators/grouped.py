"""Arrow batches of whole trials: one shuffle and one sort by Spark, then kernels that look at many trials at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of whole trials that are looked at together, about; a longer trial makes a block by itself.
BLOCK = 1 << 16


def trial_numbers(keys: pa.Array) -> np.ndarray:
    """Numbers of the runs of equal keys, NULL being a key too."""
    if not len(keys):
        return np.zeros(0, np.int64)
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.append(False, codes[1:] != codes[:-1]))


def whole_trials(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole trials and the trial number of each row. The first column is the trial, and its rows are neighbours."""
    held, size, wanted = [], 0, most

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).combine_chunks()
        return table, trial_numbers(keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= wanted:
            table, numbers = joined()
            end = int(np.searchsorted(numbers, numbers[-1]))
            if end:
                yield table.slice(0, end).combine_chunks(), numbers[:end]
            held = table.slice(end).to_batches()
            size -= end
            # A trial that isn't whole yet is joined again only when it has doubled.
            wanted = max(most, 2 * size)
    if size:
        yield joined()


def dealt(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """All rows of a key in one task, for functions on batches, of which Spark doesn't know that they need it.

    The hash is one of our own: a plain repartition by keys that a window or an aggregate below has been dealt by is left out of the plan, and then
    nothing keeps the tasks of a union's sides together when Spark merges small shuffle partitions of each side in its own way.
    """
    own = F.xxhash64(*[F.col(k) for k in keys])
    return df.repartition(own) if n is None else df.repartition(n, own)


def map_trials(df: DataFrame, order: Sequence[str | Column], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on blocks of whole trials (first column) whose rows are in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, numbers in whole_trials(batches):
            yield from work(block, numbers)

    key = df.columns[0]
    # A number of its own, as kernels take far more time for a row than the bytes of small shuffles suggest, and those would be put together.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(df, [key], n).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def numbers_of(block: pa.Table, name: str) -> np.ndarray:
    """A column as numbers, NULL as NaN."""
    column = block.column(name).combine_chunks()
    return np.asarray(column.to_numpy(zero_copy_only=False), float)
