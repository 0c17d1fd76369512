"""The operators' inputs on ordinary tables: users are trials, some event types are telemetry, the others the reference stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN, OTHER = ("click", "view"), ("purchase", "signup", "error")

#: SQL of the same streams, to be put after WITH.
SQL_STREAMS = """
s AS (SELECT user_id AS trial_id, event_id AS source_row_index, epoch_us(ts) / 1e6 AS t, event_type, value, (value * 7) % 360 AS heading FROM events),
e AS (SELECT * FROM s WHERE event_type IN ('click', 'view')),
v AS (SELECT * FROM s WHERE event_type IN ('purchase', 'signup', 'error'))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("source_row_index"), t.alias("t"), "event_type", "value", ((F.col("value") * 7) % 360).alias("heading"))


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).filter(F.col("event_type").isin(*OWN))


def other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).filter(F.col("event_type").isin(*OTHER))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the outer edge, so that the order of sums doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
