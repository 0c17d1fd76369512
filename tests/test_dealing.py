"""Whole trials in one task, however Spark merges the shuffle partitions below."""

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import grouped
from gaugeline.operators.digests import ordered_digests

#: Small partitions are merged up to about 4 kB, so that a wide side of a union and a narrow one are merged differently.
MERGED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}


@pytest.fixture
def merged(spark):
    before = {k: spark.conf.get(k) for k in MERGED}
    for k, v in MERGED.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def side(spark, name, n):
    """Rows of 40 trials, shuffled and sorted by a window as cleaning does."""
    rows = spark.range(n).select((F.col("id") % 40).alias("trial_id"), F.xxhash64("id").alias("k"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("trial_id").orderBy("k"))).select("trial_id", F.lit(name).alias("side"), "place")


def test_both_sides_of_a_union_meet_in_one_task(spark, merged):
    def work(block, numbers):
        trials = block.column("trial_id").to_pylist()
        seen = [(t, {s for u, s in zip(trials, block.column("side").to_pylist(), strict=True) if u == t}) for t in sorted(set(trials))]
        yield pa.RecordBatch.from_pylist([{"trial_id": t, "sides": len(s)} for t, s in seen])

    both = side(spark, "a", 20_000).unionByName(side(spark, "b", 400))
    got = grouped.map_trials(both, ["side", "place"], work, "trial_id long, sides long").collect()
    assert sorted(map(tuple, got)) == [(t, 2) for t in range(40)]


def test_digests_of_a_union_are_one_for_each_group(spark, merged):
    both = side(spark, "a", 20_000).unionByName(side(spark, "b", 400)).select("trial_id", F.concat("side", F.col("place").cast("string")).alias("key"))
    got = ordered_digests(both, ["trial_id"], "key").collect()
    assert sorted((r["trial_id"], r["n_keys"]) for r in got) == [(t, 510) for t in range(40)]
