"""Importance resampling towards a target text: DuckDB makes hashed n-grams in each partition, Spark merges and scores.

A task feeds its texts in pieces of bounded size to an in-process DuckDB: SQL extracts and unnests the words, a window puts each
word behind the one or two before it, and a registered function, zlib's CRC, gives each n-gram its bucket. What a task returns
is spilled to Parquet in the shared folder: for each document the buckets of its features, and for the task one row with the
counts of all buckets. Spark adds up the tasks' counts (a fixed number of buckets for any input), works out each bucket's gain
from corpus and target, and sums the gains over every document's features, without making n-grams again.

The draw adds Gumbel noise, a hash of the document's id, to the weight and takes the highest scores. Ranks come from a sort
by ranges of the score and from the ranges' counts; no task holds more than its range.

A text longer than a piece goes through DuckDB in stretches that end between words; the last two words of a stretch are
shown to the next one again, where only n-grams that end behind them count.

Defined results: null texts have no words, as empty ones; a null doc_id hashes as the empty string and comes last among ties;
repeated rows count, and are drawn, one by one; an empty table gives no rows, an empty target has no counts; texts of any
length are read whole; of the tables only the columns of id and text are read, so others may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.bytes import pieces, stretches, utf8
from gaugeline.llm.storage import Scratch, keep

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Bytes of text that DuckDB gets at once.
PIECE = 2 << 20
_WORD = rb"[0-9a-z\x80-\xff]+"

FEATURES = r"""
CREATE OR REPLACE TEMP TABLE features AS
WITH listed AS (SELECT r, carried, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM piece),
word AS (SELECT r, carried, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM listed),
gram AS (SELECT r, pos > carried AS own, word AS one, lag(word) OVER w || ' ' || word AS two, lag(word, 2) OVER w || ' ' || lag(word) OVER w || ' ' || word AS three
         FROM word WINDOW w AS (PARTITION BY r ORDER BY pos))
SELECT r, 1 AS size, (crc(one) % {buckets})::INTEGER AS bucket FROM gram WHERE own
UNION ALL SELECT r, 2, (crc(two) % {buckets})::INTEGER FROM gram WHERE own AND two IS NOT NULL
UNION ALL SELECT r, 3, (crc(three) % {buckets})::INTEGER FROM gram WHERE own AND three IS NOT NULL
"""
COUNT = "INSERT INTO counts SELECT bucket, count(*) FROM features GROUP BY bucket"
GATHER = "SELECT r, count(*) FILTER (size = 1) AS n_words, list(bucket) AS buckets FROM features GROUP BY r ORDER BY r"
TOTALS = "SELECT bucket, sum(n)::BIGINT AS n FROM counts GROUP BY bucket"


def _crc(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Unsigned CRC-32 of each string's UTF-8 bytes."""
    return pa.array(list(map(zlib.crc32, column.cast(pa.binary()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.binary()).to_numpy())), pa.uint32())


def connection(buckets: int = BUCKETS):
    """An in-memory DuckDB of one thread, that writes no files, with the CRC function."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    con.execute("CREATE TEMP TABLE counts (bucket INTEGER, n BIGINT)")
    return con


def _shown(part: pa.RecordBatch) -> Iterator[pa.Table]:
    """What DuckDB gets of some texts (text): rows r, carried, text; one long text in several tables, with two words carried over."""
    data, offsets = utf8(part.column("text"))
    if part.num_rows > 1 or len(data) <= PIECE:
        yield pa.table({"r": np.arange(part.num_rows), "carried": np.zeros(part.num_rows, np.int64), "text": part.column("text")})
        return
    carried: list[bytes] = []
    for stretch, _ in stretches(data, offsets, PIECE):
        raw = b" ".join([*carried, stretch.tobytes()])
        yield pa.table({"r": np.zeros(1, np.int64), "carried": np.array([len(carried)]), "text": pa.array([raw.decode("utf-8", "replace")])})
        carried = re.findall(_WORD, raw.lower())[-2:]


def bucket_rows(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document doc_id, n_words, buckets (of all its features); for each task a row whose counts are those of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection(buckets)
        names = ["doc_id", "n_words", "buckets", "counts"]
        for part in pieces(batches, "text", PIECE):
            found: list[list[pa.Array]] = []
            for piece in _shown(part):
                con.register("piece", piece)
                con.execute(FEATURES.format(buckets=buckets))
                con.execute(COUNT)
                got = con.sql(GATHER).to_arrow_table().combine_chunks()
                found.append([got["r"].to_numpy(), got["n_words"].to_numpy(), got["buckets"].combine_chunks()])
                con.unregister("piece")
            n_words, size = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for r, words, lists in found:
                n_words[r] += words
                size[r] += lists.value_lengths().to_numpy()
            flat = pa.concat_arrays([lists.flatten() for *_, lists in found]).cast(pa.int32())
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), listed, pa.nulls(part.num_rows, pa.list_(pa.int64()))], names)
        counts = np.zeros(buckets, np.int64)
        total = con.sql(TOTALS).to_arrow_table()
        counts[total["bucket"].to_numpy()] = total["n"].to_numpy()
        con.close()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int64()))], names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, buckets array<int>, counts array<long>")


def merged(rows: DataFrame, name: str) -> DataFrame:
    """bucket and its count over all tasks' rows."""
    each = rows.filter("counts is not null").select(F.posexplode("counts").alias("bucket", "n"))
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the gains of all buckets, in order. corpus, target: rows of bucket_rows()."""
    s, t = merged(corpus, "s"), merged(target, "t")
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    number = lambda c: F.col(c).cast("double")
    ratio = (number("t") + 1) * (number("all_s") + buckets) / ((number("s") + 1) * (number("all_t") + buckets))
    gain = both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))
    return gain.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a written table with rank, 1 for the first in this order: a sort by ranges, and an offset for each range."""
    with Scratch(rows.sparkSession) as scratch:
        ranges = scratch.keep(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
        return keep(_numbered(ranges, order), "ranked")


def _numbered(ranges: DataFrame, order: list[Column]) -> DataFrame:
    # One row for each range: as many as there are partitions, whatever the number of rows.
    per = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = per.select(F.col("range"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = ranges.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return inside.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("at")).drop("range", "before", "at")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every document; rank is null for those that are not drawn.

    Drawn are the floor(percent * N / 100) highest scores of the N documents with ``least_words`` words at least.
    """
    with Scratch(docs.sparkSession) as scratch:
        of_docs = scratch.keep(bucket_rows(docs, buckets, id_col, text_col), "grams")
        of_target = scratch.keep(bucket_rows(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text_col}`").alias("text")), buckets, "id", "text"), "target-grams")
        gain = scratch.keep(gains(of_docs, of_target, buckets), "gains")
        each = of_docs.filter("counts is null").crossJoin(F.broadcast(gain))
        weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get("gains", b))
        scored = each.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
        scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
        scored = scratch.keep(scored, "scored")
        eligible = scored.filter(F.col("n_words") >= least_words)
        drawn = eligible.count() * percent // 100
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
        places = ranked(eligible, order)
        rank = F.when(F.col("rank") <= drawn, F.col("rank"))
        some = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        return keep(places.withColumn("rank", rank).unionByName(some).select("doc_id", "n_words", "n_features", "weight", "score", "rank"), "resampled")
