"""Hashes of ordered keys, fed to the hash one after the other: a group may have any number of keys, none are gathered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators import grouped

#: What stands before, between and after the keys.
LINES = ("", "\n", "")
JSON_LIST = ("[", ",", "]")
NO_LINES = hashlib.sha256(b"").hexdigest()


def ordered_digests(rows: DataFrame, group: Sequence[str], key: str, count: str = "n_keys", digest: str = "keys_hash", form: tuple[str, str, str] = LINES) -> DataFrame:
    """group columns, count and SHA-256 of each group's keys in order: whole numbers by value, then other texts.

    Keys come sorted to the task of their group and go through the hash in batches, so memory stays the same for a group of any size. A key that
    repeats counts each time; NULL keys don't count; a group without keys has no row.
    """
    begin, between, end = (x.encode() for x in form)
    chosen = rows.select(*group, F.col(key).cast("string").alias("__k")).filter("__k is not null")
    if dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        by_value, order = rows.filter(F.col(key).isNotNull()).select(*group, F.col(key).alias("__n")), ["__n"]
    else:
        number = F.col("__k").try_cast("decimal(38,0)")
        by_value, order = chosen.withColumns({"__t": number.isNull(), "__n": number}), ["__t", "__n", "__k"]
    text = F.col("__n").cast("string").alias("__k") if order == ["__n"] else F.col("__k")
    dealt = grouped.dealt(by_value, group).sortWithinPartitions(*group, *order).select(*group, text)
    fields = [f for f in dealt.schema.fields if f.name != "__k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hasher, n = None, None, 0
        done: list[tuple] = []
        for batch in filter(len, batches):
            # Runs of a group within the batch are joined as columns; only the first can go on from the batch before, only the last into the next.
            new = np.ones(len(batch), bool)
            new[1:] = reduce(np.logical_or, [np.diff(grouped.trial_numbers(c)) != 0 for c in batch.columns[: len(fields)]])
            starts = np.flatnonzero(new)
            heads = list(zip(*(c.take(pa.array(starts)).to_pylist() for c in batch.columns[: len(fields)]), strict=True))
            sizes = np.diff(np.append(starts, len(batch))).tolist()
            runs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(batch)), pa.int32()), batch.column(len(fields)).cast(pa.binary()))
            for head, size, text in zip(heads, sizes, pc.binary_join(runs, pa.scalar(between, pa.binary())).to_pylist(), strict=True):
                if hasher is None or head != current:
                    if hasher is not None:
                        hasher.update(end)
                        done.append((*current, n, hasher.hexdigest()))
                    current, hasher, n = head, hashlib.sha256(begin), 0
                hasher.update(between + text if n else text)
                n += size
            if len(done) >= 10_000:
                yield told(done)
                done = []
        if hasher is not None:
            hasher.update(end)
            done.append((*current, n, hasher.hexdigest()))
        if done:
            yield told(done)

    names = [*(f.name for f in fields), count, digest]
    schema = T.StructType([*fields, T.StructField(count, T.LongType()), T.StructField(digest, T.StringType())])

    def told(done: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*done, strict=True), schema.fields, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    return dealt.mapInArrow(run, schema)
