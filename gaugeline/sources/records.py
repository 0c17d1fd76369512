"""Records of text tables of any size, with their place in the file, read by byte ranges.

Spark cuts a large file into ranges of bytes and reads each range's lines in a task of its own. What a range alone can't know is how
many records stand before it, and whether it begins within a quoted field. So a task says for each line what would be so if the
range began outside quotes and what if it began inside; a table with one row for each range, its number of quotes and of
records either way, is summed up file by file; and a join with that table gives every line its record. No file, and no row of the
size of a file, is held anywhere: only the lines of a record that spans several lines are gathered, by record.

Defined results: blank lines outside quotes are no records and count for nothing; line ends within quotes become a newline; a file
whose quotes don't pair up has no quoted line ends at all, so that one stray quote doesn't swallow the rest of a log;
a byte order mark at the start of a file is dropped; an empty file has no records; a file that is named twice is read once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.sources.kept import kept

LINES = "file_path string, block long, at long, inside boolean, quotes long, outer long, inner long, plain long, blank boolean, line string"


def file_path() -> Column:
    """The file's path; local ones come with one slash or three, by the reader, and have one here."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of the file, each with: its number in the range, whether it begins within quotes if the range doesn't, its number of
    quotes, and how many records have begun, itself included, if the range begins outside quotes, inside, or if quotes mean nothing."""
    range_, at, quoted, begun = None, 0, 0, np.zeros(3, np.int64)
    for batch in batches:
        line = batch.column("line")
        quotes = pc.count_substring(line, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.match_substring_regex(line, r"^[ \t]*$").to_numpy(zero_copy_only=False)
        file, block = batch.column("file_path").dictionary_encode(), batch.column("block").to_numpy()
        code = file.indices.to_numpy()
        edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
        columns: list[list[np.ndarray]] = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
            if a == b:
                continue
            here = (file.dictionary[int(code[a])].as_py(), int(block[a]))
            if here != range_:
                range_, at, quoted, begun = here, 0, 0, np.zeros(3, np.int64)
            before = quoted + np.concatenate([[0], np.cumsum(quotes[a:b])])
            inside = before[:-1] % 2 == 1
            full = ~blank[a:b]
            counts = begun[:, None] + np.cumsum(np.array([~inside & full, inside & full, full]), axis=1)
            columns.append([at + np.arange(b - a), inside, *counts])
            at, quoted, begun = at + b - a, int(before[-1]), counts[:, -1]
        if columns:
            numbers, inside, outer, inner, plain = (np.concatenate(c) for c in zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_path"), batch.column("block"), pa.array(numbers), pa.array(inside), pa.array(quotes), pa.array(outer), pa.array(inner), pa.array(plain), pa.array(blank), line],
                ["file_path", "block", "at", "inside", "quotes", "outer", "inner", "plain", "blank", "line"],
            )


def ranges(lines: DataFrame) -> DataFrame:
    """file_path, block, open (whether it begins within quotes), unpaired (whether the file's quotes pair up), before (records in earlier ranges)."""
    per = lines.groupBy("file_path", "block").agg(F.sum("quotes").alias("quotes"), *[F.max(c).alias(c) for c in ("outer", "inner", "plain")])
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    seen = per.withColumns({"unpaired": F.sum("quotes").over(whole) % 2 == 1, "open": F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1})
    own = F.when(F.col("unpaired"), F.col("plain")).when(F.col("open"), F.col("inner")).otherwise(F.col("outer"))
    return seen.withColumn("before", F.coalesce(F.sum(own).over(earlier), F.lit(0))).select("file_path", "block", "open", "unpaired", "before")


def records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file_path, record (its number in the file, from 0), text of every record of the files."""
    if not paths:
        return spark.createDataFrame([], "file_path string, record long, text string")
    scan = spark.read.text(sorted(set(paths))).select(file_path().alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    # Written once: ranges are summed up and lines numbered over the same cut of the files, whatever becomes of executors.
    lines = kept(scan.mapInArrow(_marked, LINES))
    placed = lines.join(ranges(lines), ["file_path", "block"])
    within = ~F.col("unpaired") & (F.col("inside") != F.col("open"))
    begun = F.when(F.col("unpaired"), F.col("plain")).when(F.col("open"), F.col("inner")).otherwise(F.col("outer"))
    placed = placed.withColumns({"within": within, "record": F.col("before") + begun - 1}).filter("within or not blank")
    placed = placed.withColumn("line", F.when((F.col("block") == 0) & (F.col("at") == 0), F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")))
    several = F.col("within") | (~F.col("unpaired") & (F.col("quotes") % 2 == 1))
    single = placed.filter(~several).select("file_path", "record", F.col("line").alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda p: p["line"])
    joined = placed.filter(several).groupBy("file_path", "record").agg(F.array_join(parts, "\n").alias("text"))
    return single.unionByName(joined)
