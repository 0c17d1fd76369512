"""Raw streams to cleaned ones: names, numbers, times, identities, and the signals derived from them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions.columns import exact_ns, lever_arm, numeric, phase_of, to_ns, wall_seconds, yaw

NUMERIC_TELEMETRY = ("motor_speed", "motor_angle", "gyro_heading", "left_speed", "right_speed")
NUMERIC_TRACKING = ("x", "y", "z", "qx", "qy", "qz", "qw")


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "column"


def standardize(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Rename aliases, then put all other names in snake case; names that clash get a number."""
    names: list[str] = []
    for c in df.columns:
        base = name = aliases.get(c, aliases.get(c.strip(), snake(c)))
        k = 1
        while name in names:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    return df.toDF(*names)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def ordered(time: str, identity: str = "source_row_index", key: str = "trial_id") -> Window:
    """By time, NULL last, equal times in source order."""
    return Window.partitionBy(key).orderBy(F.col(time).asc_nulls_last(), identity)


def source_order(key: str = "trial_id", identity: str = "source_row_index") -> Window:
    return Window.partitionBy(key).orderBy(identity)


def difference(c: Column, line: Window) -> Column:
    return c - F.lag(c).over(line)


def path_length(df: DataFrame, x: str, y: str, out: str = "path", time: str = "t", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Column ``out``: how far each trial has come along its rows."""
    line = ordered(time, identity, key)
    step = F.coalesce(F.hypot(difference(F.col(x), line), difference(F.col(y), line)), F.lit(0.0))
    return df.withColumn(out, step).withColumn(out, F.sum(out).over(line.rowsBetween(Window.unboundedPreceding, 0)))


def first_above(df: DataFrame, value: str, threshold: float, time: str = "t", key: str = "trial_id") -> DataFrame:
    """trial, onset: the first time at which the value is above the threshold, else the first time."""
    return df.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(value) > threshold, F.col(time))), F.min(time)).alias("onset"))


def rolling_mean(value: str, time: str = "t", width: int = 5, key: str = "trial_id", identity: str = "source_row_index") -> Column:
    """Mean of up to ``width`` rows around each."""
    return F.avg(value).over(ordered(time, identity, key).rowsBetween(-(width // 2), width // 2))


def first_known(c: Column, line: Window) -> Column:
    """The first non-NULL value in the window's order, on every row."""
    return F.first(c, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def elapsed(df: DataFrame, time: str, out: str = "elapsed_s", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Time since the first finite row in source order."""
    t = F.col(time)
    return df.withColumn(out, t - first_known(t, source_order(key, identity)))


def timestamp_status(df: DataFrame, time: str, key: str = "trial_id") -> DataFrame:
    """One row for each trial: rows, invalid times, status."""
    invalid = F.count_if(F.col(time).isNull())
    out = df.groupBy(key).agg(F.count("*").alias("rows"), invalid.alias("invalid_timestamp_count"))
    status = F.when(F.col("invalid_timestamp_count") == F.col("rows"), "no_valid_timestamps").when(F.col("invalid_timestamp_count") > 0, "invalid_timestamp_values").otherwise("ok")
    return out.withColumn("timestamp_status", status)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many key values repeat, and how many rows they affect."""
    repeated = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(F.count("*").alias("duplicate_key_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_key_rows"))


# ------------------------------------------------------------------ signals


def unwrap(degrees: Column, line: Window) -> tuple[Column, Column]:
    """The whole turns by which a heading jumps at a row, to be summed up, and that heading's difference without them."""
    step = degrees - F.lag(degrees).over(line)
    turns = F.when(step.isNull(), 0.0).otherwise(-360.0 * F.floor((step + 180.0) / 360.0) + F.when((F.pmod(step + 180.0, F.lit(360.0)) == 0) & (step > 0), 360.0).otherwise(0.0))
    return turns, step + turns


def with_unwrapped(df: DataFrame, heading: str, out: str = "unwrapped_heading", time: str = "local_time_s", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    line = ordered(time, identity, key)
    turns, _ = unwrap(F.col(heading), line)
    return df.withColumn("__turns", turns).withColumn(out, F.col(heading) + F.sum("__turns").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("__turns")


def telemetry_signals(df: DataFrame, s: Settings, speed: str = "motor_speed", heading: str = "gyro_heading", time: str = "local_time_s") -> DataFrame:
    """speed_magnitude, and with a heading unwrapped_heading and turn_rate (0 where no time has passed), and the phase."""
    line = ordered(time)
    out = df.withColumn("speed_magnitude", F.abs(F.col(speed)))
    if heading in df.columns:
        out = with_unwrapped(out, heading, time=time)
        dt = difference(F.col(time), line)
        rate = F.when(dt > 0, difference(F.col("unwrapped_heading"), line) / dt).otherwise(0.0)
        out = out.withColumn("turn_rate", rate)
    else:
        out = out.withColumn("turn_rate", F.lit(0.0))
    return out.withColumn("phase", phase_of(F.col("speed_magnitude"), F.col("turn_rate"), slow=s.stationary_speed, turning=s.turning_rate))


def tracking_signals(df: DataFrame, s: Settings, time: str = "relative_time_s") -> DataFrame:
    """Speed in space by differences (0 at the first row and where no time has passed), and a flag after long gaps."""
    line = ordered(time)
    dt = difference(F.col(time), line)
    way = F.sqrt(sum((F.pow(difference(F.col(c), line), F.lit(2)) for c in ("x", "y", "z") if c in df.columns), F.lit(0.0)))
    return df.withColumns({"speed_magnitude": F.when(dt > 0, way / dt).otherwise(0.0), "tracking_loss": F.coalesce(dt > s.tracking_gap_s, F.lit(False))})


def dead_reckoning(df: DataFrame, s: Settings, time: str = "local_time_s", left: str = "left_speed", right: str = "right_speed", key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """Odometry of a two-wheeled drive: the heading is the running sum of turn rate times time step, the position that of
    speed times its cosine and sine, the way that of speed. Unknown wheel speeds count as 0, the first time step is 0."""
    line = ordered(time, identity, key)
    running = line.rowsBetween(Window.unboundedPreceding, 0)
    wheel = {side: F.coalesce(F.radians(F.col(c)), F.lit(0.0)) * s.wheel_radius_m for side, c in (("l", left), ("r", right))}
    dt = F.coalesce(difference(F.col(time), line), F.lit(0.0))
    out = df.withColumns({"__dt": dt, "__v": (wheel["l"] + wheel["r"]) / 2, "__w": (wheel["r"] - wheel["l"]) / s.wheel_track_m})
    out = out.withColumn("odometry_theta", F.sum(F.col("__w") * F.col("__dt")).over(running))
    way = F.col("__v") * F.col("__dt")
    return out.withColumns({"odometry_way": F.sum(way).over(running), "odometry_x": F.sum(way * F.cos("odometry_theta")).over(running), "odometry_y": F.sum(way * F.sin("odometry_theta")).over(running)}).drop("__dt", "__v", "__w")


def planar(df: DataFrame, s: Settings) -> DataFrame:
    """planar_x, planar_y, planar_heading: the configured axes, moved from the tracked point to the body's by the lever arm."""
    heading = yaw(F.col("qy"), F.col("qw")) if {"qy", "qw"} <= set(df.columns) else F.lit(0.0)
    x, y = F.col(s.planar_x), F.col(s.planar_y)
    if s.apply_lever_arm:
        x, y = lever_arm(x, y, heading, s.lever_arm[0], s.lever_arm[1])
    return df.withColumns({"planar_x": x, "planar_y": y, "planar_heading": heading})


# ------------------------------------------------------------------ whole streams


def clean_telemetry(raw: DataFrame, s: Settings) -> DataFrame:
    """Cleaned telemetry from text columns trial_id, source_row_index and those of the log."""
    df = standardize(raw, s.telemetry.aliases)
    if s.telemetry.time not in df.columns:
        raise ValueError(f"telemetry has no column {s.telemetry.time!r}")
    text = F.col(s.telemetry.time)
    df = df.withColumns({
        "source_timestamp_raw": text, "local_time_s": numeric(text) * s.telemetry_time_to_s,
        "source_timestamp_ns": F.coalesce(exact_ns(text, repr(s.telemetry_time_to_s)), to_ns(numeric(text) * s.telemetry_time_to_s)),
        **{c: numeric(F.col(c)) for c in NUMERIC_TELEMETRY if c in df.columns},
    })
    return dead_reckoning(df, s) if {"left_speed", "right_speed"} <= set(df.columns) else df


def clean_tracking(raw: DataFrame, s: Settings) -> DataFrame:
    """Cleaned tracking; relative time starts at the first valid row in source order."""
    df = standardize(raw, s.tracking.aliases)
    if s.tracking.time not in df.columns:
        raise ValueError(f"tracking has no column {s.tracking.time!r}")
    text = F.col(s.tracking.time)
    df = df.withColumns({
        "source_timestamp_raw": text, "wall_time_s": wall_seconds(text, s.tracking_time_to_s),
        "source_timestamp_ns": F.coalesce(exact_ns(text, repr(s.tracking_time_to_s)), to_ns(wall_seconds(text, s.tracking_time_to_s))),
        **{c: numeric(F.col(c)) for c in NUMERIC_TRACKING if c in df.columns},
    })
    return elapsed(df, "wall_time_s", "relative_time_s")
