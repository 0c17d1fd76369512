"""Large buckets are dealt by cells: the same classes for any size of a cell, and no task for each piece of one side with each of the other."""

import random

import pytest

pytest.importorskip("gaugeline.llm")

from gaugeline.llm import near_dup  # noqa: E402

SPLIT = {
    "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def family(spark):
    """A family of texts that share bands, some of them near each other, some only like."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if rng.random() > share else f"x{rng.randrange(999)}" for w in base) for share in (0.01, 0.02, 0.03) for _ in range(50)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cells_change_nothing_and_split_no_join(spark, split, monkeypatch):
    docs, seen, plain = family(spark).cache(), [], near_dup.Scratch.keep

    def keep(self, df, name, by=None):
        if name == "dup-pairs":
            df.collect()
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(self, df, name, by)

    monkeypatch.setattr(near_dup.Scratch, "keep", keep)
    got = {}
    for size in (512, 7):
        monkeypatch.setattr(near_dup, "CELL", size, raising=False)
        got[size] = sorted(map(tuple, near_dup.class_ids(docs).collect()))
    assert got[7] == got[512]
    assert 1 < len({c for _, c in got[7]}) < 150
    assert seen and not any("skew=true" in p for p in seen)
