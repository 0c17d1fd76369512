"""Stream diagnostics, reason-coded quality gates, degeneracy and the calibration/evaluation split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions.columns import json_list_hash
from gaugeline.operators.cleaning import difference, elapsed, ordered


def diagnostics(df: DataFrame, time: str, key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Rows, duration, time steps, rate, irregularity (spread over median of the steps) and longest gap of each trial's stream."""
    step = df.filter(F.col(time).isNotNull()).withColumn("__dt", difference(F.col(time), ordered(time, identity, key)))
    out = step.groupBy(key).agg(
        F.count("*").alias("rows"), (F.max(time) - F.min(time)).alias("duration_s"), F.coalesce(F.median("__dt"), F.lit(0.0)).alias("median_dt_s"),
        F.coalesce(F.avg("__dt"), F.lit(0.0)).alias("mean_dt_s"), F.coalesce(F.stddev_pop("__dt"), F.lit(0.0)).alias("std_dt_s"), F.coalesce(F.max("__dt"), F.lit(0.0)).alias("max_gap_s"),
    )
    positive = F.col("median_dt_s") > 0
    return out.withColumns({"effective_rate_hz": F.when(positive, 1 / F.col("median_dt_s")).otherwise(0.0), "irregularity": F.when(positive, F.col("std_dt_s") / F.col("median_dt_s")).otherwise(0.0)})


def _failures(checks: Sequence[tuple[Column, str, str, Column, float]]) -> Column:
    """Array of (stage, reason, value, threshold) of the checks that hold; a comparison with NULL never does."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))) for bad, stage, reason, value, limit in checks]
    return F.array_compact(F.array(*found))


def rejections(telemetry: DataFrame, tracking: DataFrame, s: Settings, key: str = "trial_id") -> DataFrame:
    """A row for each gate that a trial fails. Duration and irregularity are asked of the telemetry only."""
    both = telemetry.alias("e").join(tracking.alias("v"), key, "full")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = [
        (number("e.rows") < s.min_rows, "quality", "too_few_ev3_rows", number("e.rows"), s.min_rows),
        (number("v.rows") < s.min_rows, "quality", "too_few_vrmt_rows", number("v.rows"), s.min_rows),
        (F.col("e.duration_s") < s.min_duration_s, "quality", "insufficient_ev3_duration", F.col("e.duration_s"), s.min_duration_s),
        (F.col("e.max_gap_s") > s.max_gap_s, "quality", "excessive_ev3_gap", F.col("e.max_gap_s"), s.max_gap_s),
        (F.col("v.max_gap_s") > s.max_gap_s, "quality", "excessive_vrmt_gap", F.col("v.max_gap_s"), s.max_gap_s),
        (F.col("e.irregularity") > s.max_irregularity, "quality", "excessive_ev3_irregularity", F.col("e.irregularity"), s.max_irregularity),
    ]
    return both.select(key, F.explode(_failures(checks)).alias("f")).select(key, "f.*", F.lit(s.config_id).alias("config_id"))


def compatibility_issues(telemetry: DataFrame, tracking: DataFrame, s: Settings, key: str = "trial_id") -> DataFrame:
    """The gate of the extended tier: enough samples and time in both streams; the failures joined in one text."""
    both = telemetry.alias("e").join(tracking.alias("v"), key, "full")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    issue = F.array_compact(F.array(
        F.when(number("e.rows") < s.extended_min_rows, "insufficient_ev3_samples"), F.when(number("v.rows") < s.extended_min_rows, "insufficient_vrmt_samples"),
        F.when((number("e.duration_s") < s.min_duration_s) | (number("v.duration_s") < s.min_duration_s), "insufficient_duration"),
    ))
    return both.select(key, F.array_join(issue, ";").alias("issues"), (F.size(issue) == 0).alias("compatible"))


def accepted(pairs: DataFrame, rejected: DataFrame, key: str = "trial_id") -> DataFrame:
    """Paired trials without any rejection."""
    return pairs.filter("pair_status = 'paired'").join(rejected.select(key).distinct(), key, "left_anti")


def telemetry_degeneracy(df: DataFrame, s: Settings, time: str = "local_time_s", speed: str = "speed_magnitude", heading: str = "unwrapped_heading", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Integrated speed and total turning; degenerate only if both are small."""
    line = ordered(time, identity, key)
    dt = F.lead(time).over(line) - F.col(time)
    turn = F.abs(difference(F.col(heading), line)) if heading in df.columns else F.lit(0.0)
    part = df.select(key, F.when(dt > 0, F.col(speed) * dt).alias("d"), turn.alias("a"))
    out = part.groupBy(key).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("angular_change"))
    return out.withColumn("degenerate", (F.col("distance") < s.min_distance_m) & (F.col("angular_change") < s.min_turn_deg))


def tracking_degeneracy(df: DataFrame, s: Settings, time: str = "relative_time_s", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Length of the path in x and y; degenerate if it is small."""
    line = ordered(time, identity, key)
    part = df.select(key, F.hypot(difference(F.col("x"), line), difference(F.col("y"), line)).alias("d"))
    return part.groupBy(key).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"), F.lit(0.0).alias("angular_change")).withColumn("degenerate", F.col("distance") < s.min_distance_m)


# ------------------------------------------------------------------ partition


def boundaries(telemetry: DataFrame, s: Settings, time: str = "local_time_s", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """t_total, t_cal = min(calibration span, half of it), evaluation span and status, from the telemetry alone."""
    out = elapsed(telemetry, time, "__e", key, identity).groupBy(key).agg(F.max("__e").alias("found"))
    total = F.coalesce("found", F.lit(0.0))
    out = out.withColumns({"t_total_s": total, "t_cal_s": F.least(F.lit(s.calibration_s), total / 2)})
    span = F.greatest(F.lit(0.0), F.col("t_total_s") - F.col("t_cal_s"))
    status = F.when(F.col("found").isNull(), "missing_ev3_time").when(span < s.min_evaluation_s, "insufficient_evaluation_duration").otherwise("success")
    return out.withColumns({"evaluation_duration_s": span, "partition_status": status}).drop("found")


def partition(df: DataFrame, bounds: DataFrame, time: str, stream: str, key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Rows with their stream and partition. Tracking rows beyond the telemetry's span are outside_support; rows without a time have none.

    The boundaries have a row for each trial; Spark broadcasts them only where it finds them small.
    """
    e = F.col("partition_elapsed_s")
    inside = F.lit(True) if stream == "ev3" else e <= F.col("t_total_s")
    label = F.when(e.isNull(), F.lit(None)).when(~inside, "outside_support").when(e <= F.col("t_cal_s"), "calibration").otherwise("evaluation")
    timed = elapsed(df, time, "partition_elapsed_s", key, identity).join(bounds.select(key, "t_cal_s", "t_total_s"), key)
    return timed.withColumns({"partition": label, "stream": F.lit(stream)}).drop("t_cal_s", "t_total_s")


def ledger(rows: DataFrame, key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """A row for each trial, stream and partition: count, ordered identities and their hash.

    The identities of one partition are one array, as the ledger's format wants it: a trial's rows, not a table's.
    """
    grouped = rows.filter("partition is not null").groupBy(key, "stream", "partition").agg(F.sort_array(F.collect_set(identity)).alias("source_rows"), F.count("*").alias("rows"))
    return grouped.withColumn("identity_hash", json_list_hash(F.col("source_rows")))
