"""Extensions beyond the batch library: the tracking-gap flag and the pairing of two streams on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracking_sessions(rows: DataFrame, gap: str = "0.5 seconds", late: str = "10 seconds", key: str = "trial_id", time: str = "ts") -> DataFrame:
    """Unbroken stretches of a trial's samples: a session ends after ``gap`` without one. State is dropped once the watermark is past it."""
    return rows.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("rows")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "rows")


def paired_samples(left: DataFrame, right: DataFrame, within: str = "1 second", late: str = "10 seconds", key: str = "trial_id", time: str = "ts") -> DataFrame:
    """Pairs of samples of both streams of a trial at most ``within`` apart; both watermarks and the time bound limit the state."""
    a = left.withWatermark(time, late).select(F.col(key), F.col(time).alias("left_ts"), F.struct(*left.columns).alias("left"))
    b = right.withWatermark(time, late).select(F.col(key).alias("__key"), F.col(time).alias("right_ts"), F.struct(*right.columns).alias("right"))
    bound = F.expr(f"{key} = __key AND right_ts >= left_ts - INTERVAL {within} AND right_ts <= left_ts + INTERVAL {within}")
    return a.join(b, bound).drop("__key")


def windowed_rates(rows: DataFrame, width: str = "10 seconds", late: str = "10 seconds", key: str = "trial_id", time: str = "ts") -> DataFrame:
    """Samples of each trial in fixed windows of event time."""
    return rows.withWatermark(time, late).groupBy(key, F.window(time, width)).agg(F.count("*").alias("rows")).select(key, F.col("window.start").alias("start"), "rows")
