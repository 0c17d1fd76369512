"""The registered queries of the library's own operators, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions import columns as C
from gaugeline.operators import alignment, asof, cleaning, comparisons, gates, metrics, quality, statistics, support
from gaugeline.plans import presentation
from gaugeline.plans.stand_ins import SQL_STREAMS, other, own, rounded, stream, table
from gaugeline.sources import logs

S = Settings(min_rows=20, extended_min_rows=25, max_gap_s=200_000.0, max_irregularity=1.2, calibration_s=1_000_000.0, rpe_interval_s=86_400.0, rpe_tolerance_s=20_000.0, huber_delta=10.0, outlier_m=100.0, tracking_gap_s=86_400.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6) -> Callable:
    """Register a function under its name; doubles are rounded on both sides."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f if digits is None else lambda spark, d: rounded(f(spark, d), digits)
        if sql is not None:
            SQL[f.__name__] = sql.replace("$STREAMS", SQL_STREAMS.strip())
        return f

    return add


# ------------------------------------------------------------------ flagship


@query("""WITH $STREAMS,
b AS (SELECT trial_id, min(t) FILTER (WHERE source_row_index = first_row) AS t0, max(t) AS t1 FROM (SELECT *, min(source_row_index) OVER (PARTITION BY trial_id) AS first_row FROM e) GROUP BY trial_id),
q AS (SELECT e.*, b.t0 + least(1000000.0, (b.t1 - b.t0) / 2) AS cut FROM e JOIN b USING (trial_id)),
r AS (SELECT q.trial_id, q.value - v.value AS residual FROM q ASOF JOIN (SELECT trial_id, t, arg_max(value, source_row_index) AS value FROM v GROUP BY trial_id, t) v ON q.trial_id = v.trial_id AND q.t >= v.t
      JOIN (SELECT trial_id, max(t) AS tmax FROM v GROUP BY trial_id) m ON m.trial_id = q.trial_id WHERE q.t > q.cut AND q.t <= m.tmax)
SELECT trial_id, round(sqrt(avg(residual * residual)), 6) AS ate_rmse, round(avg(residual), 6) AS ate_mean, round(stddev_pop(residual), 6) AS ate_std, count(*) AS num_samples FROM r GROUP BY trial_id""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Held-out residual of each trial under zero-order hold."""
    a, b = own(spark, d), other(spark, d)
    bounds = quality.boundaries(a, S, "t")
    held = quality.partition(a, bounds, "t", "ev3").filter("partition = 'evaluation'").select("trial_id", "source_row_index", "t", "value")
    matched = asof.zero_order_hold(held, b, ["value"], sample_order="source_row_index").filter("valid")
    return matched.groupBy("trial_id").agg(*metrics.ate(F.col("value") - F.col("ref_value")))


# ------------------------------------------------------------------ projections and cleaning


@query("SELECT event_id AS event_no, event_type AS type_of_event, value AS measured_value_mm FROM events", None)
def standardize_names(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select(F.col("event_id").alias(" Event No."), F.col("event_type").alias("kind"), F.col("value").alias("Measured value (mm)"))
    return cleaning.standardize(raw, {"kind": "type_of_event"})


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none, TRY_CAST(('1e' || (event_id % 4)) AS DOUBLE) AS power FROM events", None)
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", C.numeric(F.get_json_object("props", "$.k")).alias("k"), C.numeric(F.col("event_type")).alias("none"), C.numeric(F.concat(F.lit("1e"), F.col("event_id") % 4)).alias("power"))


@query("SELECT event_id, round_even(value * 1e9, 0)::BIGINT AS ns, epoch_us(ts) * 1000 AS ts_ns FROM events", None)
def timestamps_ns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.date_format("ts", "SSSSSS"))
    return e.select("event_id", C.to_ns(F.col("value")).alias("ns"), C.exact_ns(text, "1.0").alias("ts_ns"))


@query("SELECT event_id, event_id * 1500000 + 25000 AS exact_ns, epoch_us(ts) / 1e6 AS wall_s FROM events", None)
def exact_timestamps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    milli = F.concat((F.col("event_id") * 3 / 2).cast("decimal(18,1)").cast("string"), F.lit("25"))
    return e.select("event_id", C.exact_ns(milli, "0.001").alias("exact_ns"), C.wall_seconds(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), 1.0).alias("wall_s"))


@query("WITH $STREAMS SELECT trial_id, source_row_index, round(t - first_value(t) OVER (PARTITION BY trial_id ORDER BY source_row_index), 6) AS relative_time_s FROM e")
def anchor_relative_time(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.elapsed(own(spark, d), "t", "relative_time_s").select("trial_id", "source_row_index", "relative_time_s")


@query("SELECT page_id, 'D' || (page_id % 9 + 1) || '_T' || (page_id % 7 + 1) AS scenario_id FROM pages", None)
def split_trial_id(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    trial = F.concat(F.lit("D"), F.col("page_id") % 9 + 1, F.lit("_T"), F.col("page_id") % 7 + 1, F.lit("_2026-01-01_00-00-00"))
    return p.select("page_id", C.scenario(trial).alias("scenario_id"))


@query("""WITH $STREAMS SELECT trial_id, source_row_index, round(1.01 * t + 2.5, 6) AS t_common_s, round(((value / 10 + pi()) - floor((value / 10 + pi()) / (2 * pi())) * 2 * pi()) - pi(), 6) AS angle,
round(2 * atan2(value / 500, 1 - value / 1000), 6) AS yaw, round(cos(value / 10) * (t % 100 - 1) - sin(value / 10) * (value - 2) + 3, 6) AS x, round(sin(value / 10) * (t % 100 - 1) + cos(value / 10) * (value - 2) + 4, 6) AS y,
round(value - (cos(value / 10) * 0.005 - sin(value / 10) * 0.01), 6) AS body_x FROM e""")
def clock_and_plane_maps(spark: SparkSession, d: str) -> DataFrame:
    e, v, lit = own(spark, d), F.col("value"), F.lit
    x, y = C.rotate_translate(F.col("t") % 100, v, v / 10, lit(1.0), lit(2.0), lit(3.0), lit(4.0))
    body, _ = C.lever_arm(v, v, v / 10, 0.005, 0.01)
    return e.select("trial_id", "source_row_index", (lit(1.01) * F.col("t") + 2.5).alias("t_common_s"), C.wrap_angle(v / 10).alias("angle"), C.yaw(v / 500, 1 - v / 1000).alias("yaw"), x.alias("x"), y.alias("y"), body.alias("body_x"))


@query("""WITH $STREAMS, d AS (SELECT *, heading - lag(heading) OVER w AS dh, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index)),
c AS (SELECT *, CASE WHEN dh IS NULL THEN 0 WHEN dh > 180 THEN -360 WHEN dh < -180 THEN 360 ELSE 0 END AS turn FROM d),
u AS (SELECT *, heading + sum(turn) OVER (PARTITION BY trial_id ORDER BY t, source_row_index ROWS UNBOUNDED PRECEDING) AS unwrapped, CASE WHEN dt > 0 THEN (dh + turn) / dt ELSE 0 END AS rate FROM c)
SELECT trial_id, source_row_index, round(unwrapped, 4) AS unwrapped_heading, round(rate, 4) AS turn_rate, CASE WHEN abs(value) < 1 THEN 'stopped' WHEN abs(rate) > 5 THEN 'turning' ELSE 'straight' END AS phase FROM u""", 4)
def telemetry_signals(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.telemetry_signals(own(spark, d), S, "value", "heading", "t").select("trial_id", "source_row_index", "unwrapped_heading", "turn_rate", "phase")


@query("""WITH $STREAMS, d AS (SELECT *, t - lag(t) OVER w AS dt, value - lag(value) OVER w AS dx, heading - lag(heading) OVER w AS dy FROM v WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index))
SELECT trial_id, source_row_index, round(CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt ELSE 0 END, 6) AS speed_magnitude, coalesce(dt > 86400, false) AS tracking_loss FROM d""")
def tracking_signals(spark: SparkSession, d: str) -> DataFrame:
    v = other(spark, d).withColumnsRenamed({"value": "x", "heading": "y"})
    return cleaning.tracking_signals(v, S, "t").select("trial_id", "source_row_index", "speed_magnitude", "tracking_loss")


@query("""WITH $STREAMS, d AS (SELECT *, coalesce(t - lag(t) OVER w, 0) / 1000 AS dt, radians(value) * 0.028 AS l, radians(heading) * 0.028 AS r FROM e WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index)),
h AS (SELECT *, sum((r - l) / 0.12 * dt) OVER (PARTITION BY trial_id ORDER BY t, source_row_index ROWS UNBOUNDED PRECEDING) AS theta FROM d)
SELECT trial_id, source_row_index, round(theta, 3) AS odometry_theta, round(sum((l + r) / 2 * dt) OVER (PARTITION BY trial_id ORDER BY t, source_row_index ROWS UNBOUNDED PRECEDING), 3) AS odometry_way FROM h""", 3)
def dead_reckoning(spark: SparkSession, d: str) -> DataFrame:
    e = own(spark, d).withColumns({"left": F.col("value"), "right": F.col("heading"), "ms": F.col("t") / 1000})
    return cleaning.dead_reckoning(e, S, "ms", "left", "right").select("trial_id", "source_row_index", "odometry_theta", "odometry_way")


@query("""WITH $STREAMS, p AS (SELECT *, sqrt(power(value - lag(value) OVER w, 2) + power(heading - lag(heading) OVER w, 2)) AS way FROM e WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index)),
c AS (SELECT *, sum(coalesce(way, 0)) OVER (PARTITION BY trial_id ORDER BY t, source_row_index ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT trial_id, round(max(run), 4) AS path_length, round(min(t) FILTER (WHERE run >= 500), 4) AS crossed_at FROM c GROUP BY trial_id""", 4)
def path_crossing(spark: SparkSession, d: str) -> DataFrame:
    run = cleaning.path_length(own(spark, d), "value", "heading", "run")
    return run.groupBy("trial_id").agg(F.max("run").alias("path_length"), F.min(F.when(F.col("run") >= 500, F.col("t"))).alias("crossed_at"))


@query("WITH $STREAMS SELECT trial_id, source_row_index, round(avg(value) OVER (PARTITION BY trial_id ORDER BY t, source_row_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM e")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return own(spark, d).select("trial_id", "source_row_index", cleaning.rolling_mean("value").alias("smooth"))


@query("""SELECT count(*) AS duplicate_key_count, coalesce(sum(n), 0)::BIGINT AS duplicate_key_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)""", None)
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT user_id AS trial_id, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS invalid_timestamp_count,
CASE WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'no_valid_timestamps' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'invalid_timestamp_values' ELSE 'ok' END AS timestamp_status FROM events GROUP BY user_id""", None)
def timestamp_status(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.timestamp_status(stream(spark, d).withColumn("t", F.when(F.col("event_type") != "error", F.col("t"))), "t")


# ------------------------------------------------------------------ quality and partition

_DIAGNOSTICS = """d AS (SELECT *, t - lag(t) OVER (PARTITION BY trial_id ORDER BY t, source_row_index) AS dt FROM {0}),
g{0} AS (SELECT trial_id, count(*) AS rows, max(t) - min(t) AS duration_s, coalesce(median(dt), 0) AS median_dt_s, coalesce(avg(dt), 0) AS mean_dt_s, coalesce(stddev_pop(dt), 0) AS std_dt_s, coalesce(max(dt), 0) AS max_gap_s FROM {1} GROUP BY trial_id)"""
_BOTH = "WITH $STREAMS, " + _DIAGNOSTICS.format("e", "d") + ", " + _DIAGNOSTICS.replace("d AS", "d2 AS").format("v", "d2")


@query(_BOTH + """ SELECT trial_id, rows, round(duration_s, 6) AS duration_s, round(median_dt_s, 6) AS median_dt_s, round(mean_dt_s, 6) AS mean_dt_s, round(std_dt_s, 6) AS std_dt_s, round(max_gap_s, 6) AS max_gap_s,
round(CASE WHEN median_dt_s > 0 THEN 1 / median_dt_s ELSE 0 END, 6) AS effective_rate_hz, round(CASE WHEN median_dt_s > 0 THEN std_dt_s / median_dt_s ELSE 0 END, 6) AS irregularity FROM ge""")
def stream_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return quality.diagnostics(own(spark, d), "t")


def _stream_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return quality.diagnostics(own(spark, d), "t"), quality.diagnostics(other(spark, d), "t")


_REJECTED = _BOTH + """, j AS (SELECT coalesce(ge.trial_id, gv.trial_id) AS trial_id, ge.rows AS re, gv.rows AS rv, ge.duration_s AS de, ge.max_gap_s AS me, gv.max_gap_s AS mv, CASE WHEN ge.median_dt_s > 0 THEN ge.std_dt_s / ge.median_dt_s ELSE 0 END AS ie FROM ge FULL JOIN gv ON ge.trial_id = gv.trial_id),
r AS (SELECT trial_id, 'too_few_ev3_rows' AS reason, coalesce(re, 0)::DOUBLE AS value, 20.0::DOUBLE AS threshold FROM j WHERE coalesce(re, 0) < 20
UNION ALL SELECT trial_id, 'too_few_vrmt_rows', coalesce(rv, 0), 20 FROM j WHERE coalesce(rv, 0) < 20 UNION ALL SELECT trial_id, 'insufficient_ev3_duration', de, 5 FROM j WHERE de < 5
UNION ALL SELECT trial_id, 'excessive_ev3_gap', me, 200000 FROM j WHERE me > 200000 UNION ALL SELECT trial_id, 'excessive_vrmt_gap', mv, 200000 FROM j WHERE mv > 200000
UNION ALL SELECT trial_id, 'excessive_ev3_irregularity', ie, 1.2 FROM j WHERE ie > 1.2)"""


@query(_REJECTED + " SELECT trial_id, 'quality' AS stage, reason, round(value, 6) AS value, threshold, 'default' AS config_id FROM r")
def quality_rejections(spark: SparkSession, d: str) -> DataFrame:
    return quality.rejections(*_stream_pair(spark, d), S)


@query(_BOTH + """, j AS (SELECT coalesce(ge.trial_id, gv.trial_id) AS trial_id, coalesce(ge.rows, 0) < 25 AS a, coalesce(gv.rows, 0) < 25 AS b, coalesce(ge.duration_s, 0) < 5 OR coalesce(gv.duration_s, 0) < 5 AS c FROM ge FULL JOIN gv ON ge.trial_id = gv.trial_id)
SELECT trial_id, concat_ws(';', CASE WHEN a THEN 'insufficient_ev3_samples' END, CASE WHEN b THEN 'insufficient_vrmt_samples' END, CASE WHEN c THEN 'insufficient_duration' END) AS issues, NOT (a OR b OR c) AS compatible FROM j""", None)
def compatibility_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.compatibility_issues(*_stream_pair(spark, d), S)


@query(_REJECTED + " SELECT DISTINCT trial_id FROM s WHERE trial_id NOT IN (SELECT trial_id FROM r WHERE reason LIKE '%irregularity')", None)
def accepted_trials(spark: SparkSession, d: str) -> DataFrame:
    """Under the one gate that the stand-in streams don't all fail."""
    pairs = stream(spark, d).select("trial_id").distinct().withColumn("pair_status", F.lit("paired"))
    return quality.accepted(pairs, quality.rejections(*_stream_pair(spark, d), S).filter("reason like '%irregularity'")).select("trial_id")


@query("""WITH $STREAMS, d AS (SELECT trial_id, value * (lead(t) OVER w - t) AS part, lead(t) OVER w - t AS dt, abs(heading - lag(heading) OVER w) AS turn FROM e WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index)),
g AS (SELECT trial_id, coalesce(sum(part) FILTER (WHERE dt > 0), 0) AS distance, coalesce(sum(turn), 0) AS angular_change FROM d GROUP BY trial_id)
SELECT trial_id, round(distance, 2) AS distance, round(angular_change, 2) AS angular_change, distance < 0.1 AND angular_change < 10 AS degenerate FROM g""", 2)
def telemetry_degeneracy(spark: SparkSession, d: str) -> DataFrame:
    return quality.telemetry_degeneracy(own(spark, d), S, "t", "value", "heading")


@query("""WITH $STREAMS, d AS (SELECT trial_id, sqrt(power(value - lag(value) OVER w, 2) + power(heading - lag(heading) OVER w, 2)) AS d FROM v WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index))
SELECT trial_id, round(coalesce(sum(d), 0), 4) AS distance, 0.0::DOUBLE AS angular_change, coalesce(sum(d), 0) < 0.1 AS degenerate FROM d GROUP BY trial_id""", 4)
def tracking_degeneracy(spark: SparkSession, d: str) -> DataFrame:
    return quality.tracking_degeneracy(other(spark, d).withColumnsRenamed({"value": "x", "heading": "y"}), S, "t")


_BOUNDS = """WITH $STREAMS, x AS (SELECT *, t - first_value(t) OVER (PARTITION BY trial_id ORDER BY source_row_index) AS el FROM e), y AS (SELECT *, t - first_value(t) OVER (PARTITION BY trial_id ORDER BY source_row_index) AS el FROM v),
b AS (SELECT trial_id, max(el) AS total, least(1000000.0, max(el) / 2) AS cal FROM x GROUP BY trial_id)"""


@query(_BOUNDS + " SELECT trial_id, round(total, 6) AS t_total_s, round(cal, 6) AS t_cal_s, round(greatest(0, total - cal), 6) AS evaluation_duration_s, CASE WHEN total - cal < 5 THEN 'insufficient_evaluation_duration' ELSE 'success' END AS partition_status FROM b")
def partition_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return quality.boundaries(own(spark, d), S, "t")


_LEDGER = _BOUNDS + """, p AS (SELECT x.trial_id, 'ev3' AS stream, source_row_index, CASE WHEN el <= cal THEN 'calibration' ELSE 'evaluation' END AS partition FROM x JOIN b USING (trial_id)
UNION ALL SELECT y.trial_id, 'vrmt', source_row_index, CASE WHEN el > total THEN 'outside_support' WHEN el <= cal THEN 'calibration' ELSE 'evaluation' END FROM y JOIN b USING (trial_id))"""


def _partitioned(spark: SparkSession, d: str) -> DataFrame:
    a = own(spark, d)
    bounds = quality.boundaries(a, S, "t")
    return quality.partition(a, bounds, "t", "ev3").unionByName(quality.partition(other(spark, d), bounds, "t", "vrmt"))


@query(_LEDGER + " SELECT trial_id, stream, source_row_index, partition FROM p", None)
def partition_rows(spark: SparkSession, d: str) -> DataFrame:
    return _partitioned(spark, d).select("trial_id", "stream", "source_row_index", "partition")


@query(_LEDGER + " SELECT trial_id, stream, partition, count(*) AS rows, sha256('[' || string_agg(source_row_index::VARCHAR, ',' ORDER BY source_row_index) || ']') AS identity_hash FROM p GROUP BY ALL", None)
def partition_ledger(spark: SparkSession, d: str) -> DataFrame:
    return quality.ledger(_partitioned(spark, d)).drop("source_rows")


# ------------------------------------------------------------------ joins in time

_UNIQUE = "u AS (SELECT trial_id, t, arg_min(value, source_row_index) AS value FROM v GROUP BY trial_id, t), m AS (SELECT trial_id, min(t) AS lo, max(t) AS hi FROM u GROUP BY trial_id)"


@query(f"""WITH $STREAMS, {_UNIQUE} SELECT e.trial_id, e.source_row_index, CASE WHEN e.t <= m.hi THEN u.value END AS ref_value, coalesce(u.value IS NOT NULL AND e.t <= m.hi, false) AS valid
FROM e ASOF LEFT JOIN u ON e.trial_id = u.trial_id AND e.t >= u.t LEFT JOIN m ON m.trial_id = e.trial_id""", None)
def asof_zero_order_hold(spark: SparkSession, d: str) -> DataFrame:
    samples = other(spark, d).groupBy("trial_id", "t").agg(F.min_by("value", "source_row_index").alias("value"))
    return asof.zero_order_hold(own(spark, d), samples, ["value"]).select("trial_id", "source_row_index", "ref_value", "valid")


@query(f"""WITH $STREAMS, {_UNIQUE}, a AS (SELECT e.trial_id, e.source_row_index, e.t, u.t AS t0, u.value AS v0 FROM e ASOF LEFT JOIN u ON e.trial_id = u.trial_id AND e.t >= u.t),
b AS (SELECT e.source_row_index, u.t AS t1, u.value AS v1 FROM e ASOF LEFT JOIN u ON e.trial_id = u.trial_id AND e.t <= u.t)
SELECT trial_id, source_row_index, round(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) WHEN t1 = t0 THEN v0 END, 6) AS ref_value, coalesce(t0 IS NOT NULL AND t1 IS NOT NULL, false) AS valid FROM a JOIN b USING (source_row_index)""")
def interpolate_linear(spark: SparkSession, d: str) -> DataFrame:
    samples = other(spark, d).groupBy("trial_id", "t").agg(F.min_by("value", "source_row_index").alias("value"))
    return asof.linear(own(spark, d), samples, ["value"]).select("trial_id", "source_row_index", "ref_value", "valid")


@query("""WITH $STREAMS, g AS (SELECT e.source_row_index, e.trial_id, min(abs(e.t - v.t)) AS gap FROM e LEFT JOIN v ON e.trial_id = v.trial_id GROUP BY ALL)
SELECT trial_id, round(avg(gap), 6) AS mean_gap_s, round(median(gap), 6) AS median_gap_s, round(quantile_cont(gap, 0.95), 6) AS p95_gap_s, round(max(gap), 6) AS max_gap_s FROM g GROUP BY trial_id""")
def nearest_gap(spark: SparkSession, d: str) -> DataFrame:
    gaps = asof.nearest_gap(own(spark, d), other(spark, d))
    return gaps.groupBy("trial_id").agg(F.avg("gap").alias("mean_gap_s"), F.median("gap").alias("median_gap_s"), F.percentile("gap", F.lit(0.95)).alias("p95_gap_s"), F.max("gap").alias("max_gap_s"))


_RPE = """WITH $STREAMS, c AS (SELECT a.trial_id, a.source_row_index, b.source_row_index AS partner, abs(b.t - a.t - 86400) AS miss, (b.value - a.value) - (b.heading - a.heading) AS err FROM e a JOIN e b ON a.trial_id = b.trial_id AND abs(b.t - a.t - 86400) <= 20000),
k AS (SELECT *, row_number() OVER (PARTITION BY source_row_index ORDER BY miss, partner) AS n FROM c), r AS (SELECT trial_id, source_row_index, partner, abs(err) AS rpe FROM k WHERE n = 1)"""


def _rpe(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rpe_by_time(own(spark, d), S, ["value"], ["heading"])


@query(_RPE + " SELECT trial_id, source_row_index, partner, round(rpe, 6) AS rpe FROM r")
def rpe_partner(spark: SparkSession, d: str) -> DataFrame:
    return _rpe(spark, d).select("trial_id", "source_row_index", F.col("partner.source_row_index").alias("partner"), "rpe")


@query(_RPE + " SELECT trial_id, round(sqrt(avg(rpe * rpe)), 6) AS rpe_rmse, round(avg(rpe), 6) AS rpe_mean, round(stddev_pop(rpe), 6) AS rpe_std, round(median(rpe), 6) AS rpe_median, count(*) AS rpe_count FROM r GROUP BY trial_id")
def rpe_by_time(spark: SparkSession, d: str) -> DataFrame:
    return metrics.describe_errors(_rpe(spark, d), "rpe", "rpe")


@query("""WITH $STREAMS, r AS (SELECT trial_id, abs((lead(value) OVER w - value) - (lead(heading) OVER w - heading)) AS rpe FROM e WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index))
SELECT trial_id, round(sqrt(avg(rpe * rpe)), 6) AS rpe_rmse, round(avg(rpe), 6) AS rpe_mean, round(stddev_pop(rpe), 6) AS rpe_std, round(median(rpe), 6) AS rpe_median, count(rpe) AS rpe_count FROM r WHERE rpe IS NOT NULL GROUP BY trial_id""")
def rpe_by_index(spark: SparkSession, d: str) -> DataFrame:
    return metrics.describe_errors(metrics.rpe_by_index(own(spark, d), 1, ["value"], ["heading"]), "rpe", "rpe")


@query("WITH $STREAMS SELECT a.trial_id, round(greatest(a0, b0), 6) AS overlap_start, round(least(a1, b1), 6) AS overlap_end FROM (SELECT trial_id, min(t) a0, max(t) a1 FROM e GROUP BY 1) a JOIN (SELECT trial_id, min(t) b0, max(t) b1 FROM v GROUP BY 1) b ON a.trial_id = b.trial_id")
def time_overlap(spark: SparkSession, d: str) -> DataFrame:
    return alignment.overlap(own(spark, d), other(spark, d), "t", "t")


@query("""WITH f AS (SELECT 'D' || (event_id * 3 // 5 % 9 + 1) || '_T1_' || (event_id * 3 // 5) AS trial_id, event_type IN ('click', 'view') AS own FROM events),
g AS (SELECT trial_id, count(*) FILTER (WHERE own) AS e, count(*) FILTER (WHERE NOT own) AS v FROM f GROUP BY trial_id)
SELECT trial_id, CASE WHEN e > 1 THEN 'duplicate_ev3' WHEN v > 1 THEN 'duplicate_vrmt' WHEN e = 0 THEN 'missing_ev3' WHEN v = 0 THEN 'missing_vrmt' ELSE 'paired' END AS pair_status, e::INT AS n_ev3, v::INT AS n_vrmt FROM g""", None)
def pair_streams(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a file, one or two neighbours to a trial."""
    e = table(spark, d, "events").withColumn("g", F.expr("event_id * 3 div 5"))
    trial = F.concat(F.lit("D"), F.col("g") % 9 + 1, F.lit("_T1_"), F.col("g"))
    files = e.select(trial.alias("trial_id"), F.when(F.col("event_type").isin("click", "view"), "ev3").otherwise("vrmt").alias("stream_type"), F.concat(F.lit("/f/"), "event_id").alias("file_path"), F.col("event_id").cast("string").alias("file_name"), F.lit("").alias("file_checksum"), F.lit("ok").alias("parser_status"))
    return logs.pairs(files).select("trial_id", "pair_status", F.size("ev3_files").alias("n_ev3"), F.size("vrmt_files").alias("n_vrmt"))


# ------------------------------------------------------------------ metrics


@query("""WITH $STREAMS, k AS (SELECT trial_id, value - 50 AS r, row_number() OVER (PARTITION BY trial_id ORDER BY value - 50) AS k, count(*) OVER (PARTITION BY trial_id) AS n FROM e), c AS (SELECT *, floor(n * 0.05 + 1e-9) AS cut FROM k)
SELECT trial_id, round(median(abs(r)), 6) AS median_abs, round(avg(0.5 * power(least(abs(r), 10), 2) + 10 * (abs(r) - least(abs(r), 10))), 6) AS huber_loss,
round(sqrt(avg(r * r) FILTER (WHERE cut = 0 OR n <= 2 * cut OR (k > cut AND k <= n - cut))), 6) AS trimmed_rmse, count(*) FILTER (WHERE abs(r) > 100) AS outlier_count, round(avg(abs(r)), 6) AS mean_abs,
round(quantile_cont(abs(r), 0.75), 6) AS p75, round(quantile_cont(abs(r), 0.95), 6) AS p95, round(max(abs(r)), 6) AS max_abs, round(min(abs(r)), 6) AS min_abs FROM c GROUP BY trial_id""")
def robust_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.robust(own(spark, d).withColumn("r", F.col("value") - 50), "r", S)


@query("WITH $STREAMS SELECT trial_id, event_type AS phase, round(sqrt(avg(value * value)), 6) AS phase_rmse, count(*) AS phase_count FROM s GROUP BY ALL")
def phase_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_phase(stream(spark, d).withColumnRenamed("event_type", "phase"), "value")


@query("""WITH k AS (SELECT o_totalprice AS v FROM orders), m AS (SELECT median(v) AS m FROM k)
SELECT round(median(v), 4) AS median, round(median(abs(v - m)), 4) AS mad, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr, round(min(v), 4) AS min, round(max(v), 4) AS max FROM k, m""", 4)
def robust_statistics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.robust_statistics(table(spark, d, "orders"), "o_totalprice")


@query("""SELECT o_orderpriority, count(o_totalprice) AS o_totalprice_n, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, round(median(o_totalprice), 4) AS o_totalprice_median,
round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS o_totalprice_iqr, round(min(o_totalprice), 4) AS o_totalprice_min, round(max(o_totalprice), 4) AS o_totalprice_max, round(1.96 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4) AS o_totalprice_ci95 FROM orders GROUP BY o_orderpriority""", 4)
def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*metrics.summary(["o_totalprice"]))


@query("""SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus)::BIGINT AS level, count(l_quantity) AS l_quantity_n, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(median(l_quantity), 6) AS l_quantity_median,
round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS l_quantity_iqr, round(min(l_quantity), 6) AS l_quantity_min, round(max(l_quantity), 6) AS l_quantity_max, round(1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS l_quantity_ci95
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))""")
def grouping_sets_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])


@query("""WITH m AS (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_custkey), o AS (SELECT var_samp(o_totalprice) AS v FROM orders)
SELECT round(v, 2) AS overall, round((SELECT var_samp(m) FROM m), 2) AS between, round(greatest(0, v - (SELECT var_samp(m) FROM m)), 2) AS within FROM o""", 2)
def variance_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return metrics.variance_decomposition(table(spark, d, "orders"), "o_totalprice", "o_custkey")


@query("""SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS iqr,
round(CASE WHEN avg(c_acctbal) <> 0 THEN stddev_samp(c_acctbal) / avg(c_acctbal) END, 4) AS cv, CASE WHEN count(*) < 2 THEN 'insufficient_repetitions' WHEN stddev_samp(c_acctbal) <= 3200 THEN 'repeatable' ELSE 'variable' END AS status FROM customer GROUP BY c_nationkey""", 4)
def repeatability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeatability(table(spark, d, "customer"), "c_acctbal", "c_nationkey", 3200.0)


_DELTA = """WITH d AS (SELECT c_mktsegment, CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN c_acctbal / 1e15 WHEN 2 THEN -c_acctbal / 1e11 WHEN 3 THEN c_acctbal / 1e8 WHEN 4 THEN -c_acctbal / 1e5 ELSE c_acctbal / 1e4 END AS d FROM customer)"""


@query(_DELTA + """ SELECT c_mktsegment, count(*) AS paired_n, count(*) FILTER (WHERE d = 0) AS exact_equality_count, count(*) FILTER (WHERE d <> 0) AS nonzero_count,
count(*) FILTER (WHERE abs(d) > 0) AS over_0, count(*) FILTER (WHERE abs(d) > 1e-12) AS over_1, count(*) FILTER (WHERE abs(d) > 1e-9) AS over_2, count(*) FILTER (WHERE abs(d) > 1e-6) AS over_3, count(*) FILTER (WHERE abs(d) > 0.001) AS over_4, count(*) FILTER (WHERE abs(d) > 0.01) AS over_5, count(*) FILTER (WHERE abs(d) > 0.1) AS over_6,
round(avg(d), 9) AS mean, round(median(d), 9) AS median, round(CASE WHEN count(*) > 1 THEN stddev_samp(d) END, 9) AS sd, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 9) AS iqr, round(quantile_cont(d, 0.01), 9) AS p01, round(quantile_cont(d, 0.05), 9) AS p05, round(quantile_cont(d, 0.25), 9) AS p25,
round(quantile_cont(d, 0.75), 9) AS p75, round(quantile_cont(d, 0.95), 9) AS p95, round(quantile_cont(d, 0.99), 9) AS p99, round(min(d), 9) AS min, round(max(d), 9) AS max, round(max(abs(d)), 9) AS max_abs FROM d GROUP BY c_mktsegment""", 9)
def describe_delta(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("c_custkey") % 7, F.col("c_acctbal")
    delta = F.when(k == 0, 0.0).when(k == 1, v / 1e15).when(k == 2, -v / 1e11).when(k == 3, v / 1e8).when(k == 4, -v / 1e5).otherwise(v / 1e4)
    out = metrics.describe_delta(table(spark, d, "customer").withColumn("d", delta), "d", ["c_mktsegment"])
    return out.withColumns({f"over_{i}": F.element_at("threshold_counts", F.lit(name)) for i, name in enumerate(metrics.EXCEEDED)}).drop("threshold_counts")


@query("""SELECT population, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT o_totalprice, 'primary' AS population FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT o_totalprice, 'all' FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')) GROUP BY population""", 4)
def overlapping_populations(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.populations(table(spark, d, "orders"), "o_orderstatus", {"primary": ["F", "O"], "all": ["F", "O", "P"]})
    return rows.groupBy("population").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


@query("WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round((value - m) / s, 6) AS z FROM events, m WHERE abs((value - m) / s) > 2.0")
def zscore_outliers(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outliers(table(spark, d, "events"), "value", 2.0).select("event_id", "z")


@query("SELECT o_orderpriority, mode(o_orderstatus ORDER BY o_orderstatus) AS most_common FROM (SELECT o_orderpriority, o_orderstatus FROM orders) GROUP BY o_orderpriority", None)
def most_common_reason(spark: SparkSession, d: str) -> DataFrame:
    return metrics.most_common(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("SELECT p_brand, round(avg(p_retailprice) FILTER (WHERE p_size <= 10), 4) AS small, round(avg(p_retailprice) FILTER (WHERE p_size > 10), 4) AS large FROM part GROUP BY p_brand", 4)
def pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("cell", F.when(F.col("p_size") <= 10, "small").otherwise("large"))
    return presentation.heatmap(p, "p_brand", "cell", ["small", "large"], "p_retailprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(l_quantity), 4) AS low, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(median(l_quantity), 4) AS median, round(quantile_cont(l_quantity, 0.75), 4) AS q3, round(max(l_quantity), 4) AS high FROM lineitem GROUP BY ALL", 4)
def box_summary(spark: SparkSession, d: str) -> DataFrame:
    return presentation.box(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])


# ------------------------------------------------------------------ support and sets


def _arms(spark: SparkSession, d: str, distinct: bool = True) -> dict[str, DataFrame]:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag")
    li = li.distinct() if distinct else li
    return {flag: li.filter(F.col("l_returnflag") == flag).select("l_suppkey", "l_orderkey") for flag in ("A", "N", "R")}


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey, l_returnflag FROM lineitem), c AS (SELECT l_suppkey, l_orderkey FROM k GROUP BY ALL HAVING count(*) = 3), g AS (SELECT l_suppkey, count(DISTINCT l_returnflag) AS arms FROM k GROUP BY l_suppkey)
SELECT g.l_suppkey, count(c.l_orderkey) AS common_support_count, sha256(coalesce(string_agg(c.l_orderkey::VARCHAR, chr(10) ORDER BY c.l_orderkey), '')) AS common_support_hash,
CASE WHEN arms < 3 THEN 'empty' WHEN count(c.l_orderkey) = 0 THEN 'no_common_support' ELSE 'valid' END AS support_status FROM g LEFT JOIN c USING (l_suppkey) GROUP BY g.l_suppkey, arms""", None)
def common_support(spark: SparkSession, d: str) -> DataFrame:
    return support.common_support(_arms(spark, d), ["l_orderkey"], ["l_suppkey"])


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey, l_returnflag FROM lineitem), c AS (SELECT l_suppkey, l_orderkey FROM k GROUP BY ALL HAVING count(*) = 3)
SELECT l_suppkey, l_orderkey::VARCHAR AS support_key FROM c""", None)
def common_keys(spark: SparkSession, d: str) -> DataFrame:
    return support.common_keys(_arms(spark, d, distinct=False), ["l_orderkey"], ["l_suppkey"])  # a key that repeats in an arm is one key


@query("""WITH k AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, sum(n)::BIGINT AS rows, sum(n)::BIGINT AS finite_rows, count(*) AS unique_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CASE WHEN count(*) FILTER (WHERE n > 1) > 0 THEN 'duplicate_key' ELSE 'valid' END AS support_status FROM k GROUP BY l_suppkey""", None)
def validate_support(spark: SparkSession, d: str) -> DataFrame:
    return support.validate(table(spark, d, "lineitem"), ["l_orderkey"], ["l_suppkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN c_custkey::VARCHAR WHEN c_custkey % 5 = 2 THEN c_name WHEN c_custkey % 5 = 3 THEN NULL ELSE NULL END AS support_key,
CASE c_custkey % 5 WHEN 0 THEN 'non_finite' WHEN 3 THEN 'non_integral' WHEN 4 THEN 'unsafe_integer' END AS key_reason FROM customer""", None)
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.lit(" nan ")).when(k % 5 == 1, F.concat(k, F.lit(".0 "))).when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, F.concat(k, F.lit(".5"))).otherwise(F.concat(k, F.lit("e25")))
    return support.with_token(table(spark, d, "customer").select("c_custkey", raw.alias("raw")), ["raw"]).select("c_custkey", "support_key", "key_reason")


@query("SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 AND c_custkey % 9 = 0", None)
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").filter("c_acctbal > 9000 and c_custkey % 9 = 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return gates.missing_cells(table(spark, d, "nation").select("n_nationkey"), rich, ["n_nationkey"])


@query("SELECT c_custkey AS k, 'customer' AS arm FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier", None)
def union_arms(spark: SparkSession, d: str) -> DataFrame:
    return comparisons.stacked({t: table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"))})


# ------------------------------------------------------------------ fits in SQL


@query("""WITH $STREAMS, g AS (SELECT trial_id, count(*) AS n, atan2(covar_pop(value, heading / 3) - covar_pop(heading, value + 5), covar_pop(value, value + 5) + covar_pop(heading, heading / 3)) AS theta, avg(value) AS sx, avg(heading) AS sy, avg(value + 5) AS tx, avg(heading / 3) AS ty FROM e GROUP BY trial_id HAVING count(*) >= 3)
SELECT trial_id, n, round(theta, 6) AS theta_rad, round(tx - cos(theta) * sx + sin(theta) * sy, 5) AS tx, round(ty - sin(theta) * sx - cos(theta) * sy, 5) AS ty FROM g""", None)
def rigid_se2(spark: SparkSession, d: str) -> DataFrame:
    m = own(spark, d).select("trial_id", F.col("value").alias("sx"), F.col("heading").alias("sy"), (F.col("value") + 5).alias("ax"), (F.col("heading") / 3).alias("ay"))
    fit = alignment.rigid_fit(m, ("sx", "sy"), ("ax", "ay"))
    return fit.select("trial_id", "n", F.round("theta_rad", 6).alias("theta_rad"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"))


@query("WITH $STREAMS SELECT trial_id, round(coalesce(min(t) FILTER (WHERE value > 100), min(t)), 6) AS onset_s FROM e GROUP BY trial_id")
def onset(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.first_above(own(spark, d), "value", 100).withColumnRenamed("onset", "onset_s")


# ------------------------------------------------------------------ rank statistics

_PAIRS = "WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity - round(l_extendedprice / 2000, 0) AS diff FROM lineitem), a AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY l_suppkey, abs(diff)) - 1) / 2.0 AS r FROM p)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("a"), F.round(F.col("l_extendedprice") / 2000, 0).alias("b"))


@query(_PAIRS + """, g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE diff > 0) AS n_positive, count(*) FILTER (WHERE diff < 0) AS n_negative, count(*) FILTER (WHERE diff = 0) AS n_zero,
sum(CASE WHEN diff > 0 THEN r WHEN diff = 0 THEN r / 2 ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN diff < 0 THEN r WHEN diff = 0 THEN r / 2 ELSE 0 END)::DOUBLE AS w_minus FROM a GROUP BY l_suppkey)
SELECT *, least(w_plus, w_minus) AS reported_w, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial FROM g""")
def signed_rank_sums(spark: SparkSession, d: str) -> DataFrame:
    return statistics.signed_rank_sums(_paired(spark, d), "a", "b", ["l_suppkey"])


def _signed_rank_sql(rows: str, group: str) -> str:
    """CTEs of the whole test, for rows (group, d): exact below 51 differences without ties and zeros, by the distribution's recursion; else the normal tail by
    the error function's series."""
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {group}, abs(d)) - 1) / 2.0::DOUBLE AS r, row_number() OVER (PARTITION BY {group} ORDER BY d) AS i FROM {rows} WHERE d IS NOT NULL),
ties AS (SELECT {group}, sum(c * c * c - c) AS ties FROM (SELECT {group}, abs(d) AS a, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY {group}),
w AS (SELECT {group}, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_positive, count(*) FILTER (WHERE d < 0) AS n_negative, count(*) FILTER (WHERE d = 0) AS n_zero, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END)::DOUBLE AS w_minus,
  avg(d) AS mean_diff, median(d) AS median_diff FROM r GROUP BY {group}),
u AS (SELECT w.*, ties, least(w_plus, w_minus) AS statistic, n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48 - (n_zero * (n_zero + 1) * (2 * n_zero + 1) / 24.0::DOUBLE - (n_zero * n_zero * n_zero - n_zero) / 48.0::DOUBLE) AS var FROM w JOIN ties USING ({group})),
law(n, c) AS (SELECT 0, [1.0]::DOUBLE[] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda k: coalesce(c[k + 1], 0) + CASE WHEN k > n THEN coalesce(c[k - n], 0) ELSE 0 END) FROM law WHERE n < 50),
erf({group}, x, k, term, total) AS (SELECT {group}, least(abs(statistic - n * (n + 1) / 4.0::DOUBLE) / sqrt(var) / sqrt(2), 6), 0, least(abs(statistic - n * (n + 1) / 4.0::DOUBLE) / sqrt(var) / sqrt(2), 6), 0::DOUBLE FROM u WHERE var > 0
  UNION ALL SELECT {group}, x, k + 1, term * 2 * x * x / (2 * k + 3), total + term FROM erf WHERE k < 250),
tail AS (SELECT {group}, least(1, greatest(0, 1 - 2 / sqrt(pi()) * exp(-x * x) * total)) AS p FROM erf WHERE k = 250),
walsh AS (SELECT a.{group}, median((a.d + b.d) / 2) AS pseudomedian FROM r a JOIN r b ON a.{group} = b.{group} AND a.i <= b.i GROUP BY a.{group}),
test AS (SELECT u.{group}, u.n, n_positive, n_negative, n_zero, w_plus, w_minus, statistic, CASE WHEN u.n < 2 THEN NULL WHEN u.n <= 50 AND ties = 0 AND n_zero = 0 THEN least(1, 2 * list_sum(c[1 : floor(statistic)::INT + 1]) / list_sum(c)) WHEN var <= 0 THEN 1 ELSE p END AS p_value,
  (w_plus - w_minus) / (w_plus + w_minus) AS rank_biserial, mean_diff, median_diff, pseudomedian, CASE WHEN u.n < 2 AND n_zero = u.n THEN 'insufficient_pairs_all_zero' WHEN u.n < 2 THEN 'insufficient_pairs' WHEN n_zero = u.n THEN 'all_zero_differences' ELSE 'ok' END AS status
  FROM u LEFT JOIN law ON law.n = u.n LEFT JOIN tail ON tail.{group} = u.{group} JOIN walsh ON walsh.{group} = u.{group})"""


_TESTED = "n, n_positive, n_negative, n_zero, w_plus, w_minus, statistic, round(p_value, 6) AS p_value, round(rank_biserial, 6) AS rank_biserial, round(mean_diff, 6) AS mean_diff, round(median_diff, 6) AS median_diff, round(pseudomedian, 6) AS pseudomedian, status"


@query("WITH RECURSIVE $STREAMS, d AS (SELECT trial_id, value - heading AS d FROM e), " + _signed_rank_sql("d", "trial_id") + f" SELECT trial_id, {_TESTED} FROM test")
def signed_rank_tests(spark: SparkSession, d: str) -> DataFrame:
    return statistics.signed_rank_tests(own(spark, d), "value", "heading", ["trial_id"])


@query("""WITH d AS (SELECT l_suppkey, l_quantity - round(l_extendedprice / 2000, 0) AS d FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
w AS (SELECT l_suppkey, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0))::DOUBLE AS test_statistic FROM r GROUP BY l_suppkey), m AS (SELECT l_suppkey, count(*) AS n_pairs, median(d) AS median_diff FROM d GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN n_pairs >= 3 THEN 'success' ELSE 'insufficient_data' END AS status, n_pairs, CASE WHEN n_pairs >= 3 THEN median_diff END AS median_diff, CASE WHEN n_pairs >= 3 THEN test_statistic END AS test_statistic FROM m LEFT JOIN w USING (l_suppkey)""")
def compare_configurations(spark: SparkSession, d: str) -> DataFrame:
    """The test of two configurations for each supplier; p-values are tested on their own."""
    return statistics.compare_configurations(_paired(spark, d), "a", "b", ["l_suppkey"]).drop("p_value", "significant_05")


@query("""WITH $STREAMS, d AS (SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY source_row_index) AS i, value - heading AS d FROM e)
SELECT a.trial_id, round(median((a.d + b.d) / 2), 6) AS pseudomedian FROM d a JOIN d b ON a.trial_id = b.trial_id AND a.i <= b.i GROUP BY a.trial_id""")
def pseudomedian(spark: SparkSession, d: str) -> DataFrame:
    return statistics.pseudomedian(own(spark, d).withColumn("d", F.col("value") - F.col("heading")), "d", ["trial_id"])


_METHODS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_BLOCKS = """WITH m AS (SELECT c_nationkey AS block, o_orderpriority AS method, round(avg(o_totalprice), 0) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), k AS (SELECT block FROM m GROUP BY block HAVING count(*) = (SELECT count(DISTINCT method) FROM m)), w AS (SELECT m.* FROM m JOIN k USING (block))"""


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("block"), F.col("o_orderpriority").alias("method")).agg(F.round(F.avg("o_totalprice"), 0).alias("value"))
    # The methods are a handful of category names.
    return m, [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]


@query(_BLOCKS + " SELECT block, method, value FROM w")
def complete_blocks(spark: SparkSession, d: str) -> DataFrame:
    m, methods = _blocks(spark, d)
    return statistics.complete_blocks(m, methods, "block")


@query(_BLOCKS + """, r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY value) + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0 AS r FROM w), t AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*) AS c FROM w GROUP BY block, value)),
q AS (SELECT sum(s * s) AS q, max(n) AS n, count(*) AS k FROM (SELECT method, sum(r) AS s, count(*) AS n FROM r GROUP BY method)), f AS (SELECT n, k, (12.0 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))::DOUBLE) AS statistic FROM q, t)
SELECT n, round(statistic::DOUBLE, 6) AS statistic, round((statistic / (n * (k - 1)))::DOUBLE, 6) AS kendall_w FROM f""")
def friedman_statistic(spark: SparkSession, d: str) -> DataFrame:
    m, methods = _blocks(spark, d)
    return statistics.friedman_statistic(m, methods, "block")


@query(_BLOCKS + " SELECT a.block, a.method || ' - ' || b.method AS contrast, a.value AS a, b.value AS b FROM w a JOIN w b ON a.block = b.block AND a.method < b.method")
def method_contrasts(spark: SparkSession, d: str) -> DataFrame:
    m, methods = _blocks(spark, d)
    return statistics.contrasts(m, methods, "block")


@query("""WITH p AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE ((n_nationkey * 7) % 25 + 1) / 300.0::DOUBLE END AS p FROM nation), s AS (SELECT *, p * (count(p) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p NULLS LAST) + 1) AS x FROM p)
SELECT n_nationkey, n_regionkey, round(p, 6) AS p, CASE WHEN p IS NOT NULL THEN round(least(1, max(x) OVER (PARTITION BY n_regionkey ORDER BY p NULLS LAST ROWS UNBOUNDED PRECEDING)), 6) END AS p_adjusted FROM s""")
def holm_adjustment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.when(k % 6 != 5, ((k * 7) % 25 + 1) / 300.0).alias("p"))
    return statistics.holm(n, "p", family=["n_regionkey"])


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice, -3)) + (count(*) OVER (PARTITION BY o_orderpriority, round(o_totalprice, -3)) - 1) / 2.0::DOUBLE AS rank FROM orders")
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("v", F.round("o_totalprice", -3))
    return o.select("o_orderkey", statistics.average_rank(F.col("v"), "o_orderpriority").cast("double").alias("rank"))


# ------------------------------------------------------------------ gates and designs


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ids = c.select(F.col("c_custkey").alias("trial_id"), F.col("c_mktsegment").alias("dataset_tier"), F.lit("all").alias("analysis_set"), F.concat(F.lit("N"), "c_nationkey").alias("scenario_id"), F.when(F.col("c_acctbal") > 0, "paired").otherwise("missing_ev3").alias("pair_status"))
    rejected = c.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("trial_id"))
    degenerate = c.select(F.col("c_custkey").alias("trial_id"), F.when(F.col("c_nationkey") < 20, "ok").otherwise("degenerate").alias("degeneracy_status"))
    return gates.gate_ledger(ids, gates.gate_members(ids, {"quality_accepted": rejected, "calibration_non_degenerate": degenerate}))


_GATES = """WITH g AS (SELECT unnest(['discovered', 'paired', 'missing_required_stream', 'quality_accepted', 'calibration_non_degenerate', 'temporal_valid', 'clock_valid', 'final_alignment_valid', 'baseline_valid', 'H1_eligible', 'H2_all_four_arm_eligible', 'H3_both_arm_eligible']) AS gate),
l AS (SELECT c_custkey AS trial_id, c_mktsegment AS dataset_tier, gate, CASE gate WHEN 'discovered' THEN true WHEN 'paired' THEN c_acctbal > 0 WHEN 'missing_required_stream' THEN c_acctbal <= 0 WHEN 'quality_accepted' THEN c_acctbal > 0 AND c_acctbal <= 9000 WHEN 'calibration_non_degenerate' THEN c_nationkey < 20 ELSE false END AS ok,
  gate IN ('discovered', 'paired', 'missing_required_stream', 'quality_accepted', 'calibration_non_degenerate') AS known FROM customer, g)"""


@query(_GATES + " SELECT trial_id, dataset_tier, gate, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS gate_status, CASE WHEN ok THEN 'passed' WHEN known THEN 'gate_failed' ELSE 'evidence_unavailable' END AS reason FROM l", None)
def gate_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).drop("analysis_set", "scenario_id")


@query(_GATES + " SELECT gate, count(*) FILTER (WHERE dataset_tier = 'BUILDING') AS \"BUILDING\", count(*) FILTER (WHERE dataset_tier = 'MACHINERY') AS \"MACHINERY\", count(*) AS total FROM l WHERE ok GROUP BY gate", None)
def gate_pivot(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_pivot(_ledger(spark, d), ["BUILDING", "MACHINERY"])


@query("""WITH n AS (SELECT 'D' || a AS drive_id, 'T' || b AS route_id, r::INT AS repetition_id FROM range(1, 10) x(a), range(1, 10) y(b), range(1, 6) z(r)), f AS (SELECT DISTINCT 'D' || (c_custkey % 9 + 1) AS drive_id, 'T' || (c_nationkey % 9 + 1) AS route_id, (c_custkey % 4 + 1)::INT AS repetition_id FROM customer)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.drive_id = n.drive_id AND f.route_id = n.route_id AND f.repetition_id = n.repetition_id)""", None)
def missing_design_cells(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").select(F.concat(F.lit("D"), F.col("c_custkey") % 9 + 1).alias("drive_id"), F.concat(F.lit("T"), F.col("c_nationkey") % 9 + 1).alias("route_id"), (F.col("c_custkey") % 4 + 1).cast("int").alias("repetition_id"))
    return gates.missing_cells(gates.design_grid(spark), found)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS repetition_id FROM customer)
SELECT c_custkey AS trial_id, c_nationkey AS scenario_id, repetition_id::INT AS repetition_id, CASE WHEN repetition_id <= 5 THEN 'planned_405' ELSE 'extended_previous_paper' END AS dataset_tier FROM r""", None)
def repetition_numbers(spark: SparkSession, d: str) -> DataFrame:
    trials = table(spark, d, "customer").select(F.col("c_custkey").alias("trial_id"), F.col("c_nationkey").alias("scenario_id"))
    return logs.repetitions(trials, F.lit(True)).drop("candidate")


# ------------------------------------------------------------------ without an SQL equivalent


def _reference_sql(values: list[str]) -> str:
    """CTEs of all four reference operators: ref(trial_id, source_row_index, t, method, ref_*, valid) for queries q(trial_id, source_row_index, t) and knots
    k(trial_id, t, values). The splines' tridiagonal systems are eliminated and solved row by row, all trials at once."""
    each = lambda f: ", ".join(f(c) for c in values)
    steps = each(lambda c: f"(lead({c}) OVER w - {c}) / (lead(t) OVER w - t) AS s_{c}")
    sides = each(lambda c: f"lag(s_{c}) OVER w AS l_{c}, lead(s_{c}) OVER w AS n_{c}, lag(s_{c}, 2) OVER w AS p_{c}")

    def end(c: str, h0: str, h1: str, a: str, b: str) -> str:
        value = f"(((2 * {h0} + {h1}) * {a} - {h0} * {b}) / ({h0} + {h1}))"
        return f"CASE WHEN sign({value}) <> sign({a}) THEN 0 WHEN sign({a}) <> sign({b}) AND abs({value}) > 3 * abs({a}) THEN 3 * {a} ELSE {value} END"

    slope = each(lambda c: f"CASE WHEN n < 3 THEN NULL WHEN i = 1 THEN {end(c, 'h', 'hn', f's_{c}', f'n_{c}')} WHEN i = n THEN {end(c, 'hl', 'hp', f'l_{c}', f'p_{c}')} WHEN l_{c} * s_{c} > 0 THEN 3 * (hl + h) / ((2 * h + hl) / l_{c} + (h + 2 * hl) / s_{c}) ELSE 0 END AS d_{c}")
    forward = each(lambda c: f"(6 * (g.s_{c} - g.l_{c}) - g.hl * f.r_{c}) / (2 * (g.hl + g.h) - g.hl * f.c)")
    both = each(lambda c: f"p.{c} AS {c}0, x.{c} AS {c}1, p.d_{c} AS d{c}0, x.d_{c} AS d{c}1, p.m_{c} AS m{c}0, x.m_{c} AS m{c}1")
    line = lambda c: f"CASE WHEN h > 0 THEN {c}0 + ({c}1 - {c}0) * u ELSE {c}0 END"
    hermite = lambda c: f"CASE WHEN n < 3 OR NOT h > 0 THEN {line(c)} ELSE (1 + 2 * u) * (1 - u) * (1 - u) * {c}0 + u * (1 - u) * (1 - u) * h * d{c}0 + u * u * (3 - 2 * u) * {c}1 + u * u * (u - 1) * h * d{c}1 END"
    spline = lambda c: f"CASE WHEN n < 4 OR NOT h > 0 THEN {line(c)} ELSE (1 - u) * {c}0 + u * {c}1 + ((power(1 - u, 3) - (1 - u)) * m{c}0 + (power(u, 3) - u) * m{c}1) * h * h / 6 END"
    zoh = lambda c: f"{c}0"
    kinds = {"zoh": zoh, "linear": line, "pchip": hermite, "spline": spline}
    rows = " UNION ALL ".join(f"SELECT trial_id, source_row_index, t, '{m}' AS method, {each(lambda c, f=f: f'CASE WHEN valid THEN {f(c)} END AS ref_{c}')}, valid FROM between_knots" for m, f in kinds.items())
    return f"""i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY trial_id) AS n FROM k WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
j AS (SELECT *, lead(t) OVER w - t AS h, {steps} FROM i WINDOW w AS (PARTITION BY trial_id ORDER BY i)),
g AS MATERIALIZED (SELECT *, lag(h) OVER w AS hl, lead(h) OVER w AS hn, lag(h, 2) OVER w AS hp, {sides} FROM j WINDOW w AS (PARTITION BY trial_id ORDER BY i)),
f(trial_id, i, c, {each(lambda c: f'r_{c}')}) AS (SELECT trial_id, 1::BIGINT, 0::DOUBLE, {each(lambda c: '0::DOUBLE')} FROM g WHERE i = 1
  UNION ALL SELECT g.trial_id, g.i, g.h / (2 * (g.hl + g.h) - g.hl * f.c), {forward} FROM f JOIN g ON g.trial_id = f.trial_id AND g.i = f.i + 1 AND g.i < g.n),
fm AS MATERIALIZED (SELECT * FROM f),
b(trial_id, i, {each(lambda c: f'm_{c}')}) AS (SELECT trial_id, n, {each(lambda c: '0::DOUBLE')} FROM g WHERE i = n
  UNION ALL SELECT fm.trial_id, fm.i, {each(lambda c: f'CASE WHEN fm.i = 1 THEN 0 ELSE fm.r_{c} - fm.c * b.m_{c} END')} FROM b JOIN fm ON fm.trial_id = b.trial_id AND fm.i = b.i - 1),
z AS MATERIALIZED (SELECT g.*, {each(lambda c: f'b.m_{c}')}, {slope} FROM g JOIN b USING (trial_id, i)),
lo AS (SELECT q.trial_id, q.source_row_index, q.t, z.i FROM q ASOF LEFT JOIN z ON q.trial_id = z.trial_id AND q.t >= z.t), hi AS (SELECT q.source_row_index, z.i FROM q ASOF LEFT JOIN z ON q.trial_id = z.trial_id AND q.t <= z.t),
between_knots AS MATERIALIZED (SELECT lo.trial_id, lo.source_row_index, lo.t, p.n, x.t - p.t AS h, CASE WHEN x.t > p.t THEN (lo.t - p.t) / (x.t - p.t) ELSE 0 END AS u, coalesce(p.i IS NOT NULL AND x.i IS NOT NULL, false) AS valid, {both}
  FROM lo JOIN hi USING (source_row_index) LEFT JOIN z p ON p.trial_id = lo.trial_id AND p.i = lo.i LEFT JOIN z x ON x.trial_id = lo.trial_id AND x.i = hi.i),
ref AS ({rows})"""


_KNOTS = "WITH RECURSIVE $STREAMS, k AS (SELECT trial_id, t, arg_min(value, source_row_index) AS value FROM v GROUP BY trial_id, t), q AS (SELECT trial_id, source_row_index, t FROM e), " + _reference_sql(["value"])


@query(_KNOTS + " SELECT trial_id, source_row_index, round(t, 4) AS t, method, round(ref_value, 4) AS ref_value, valid FROM ref", 4)
def reference_methods(spark: SparkSession, d: str) -> DataFrame:
    """All four reference operators at every telemetry row."""
    return alignment.query_reference(own(spark, d), other(spark, d), ["value"])


@query(_KNOTS + """ SELECT r.trial_id, r.source_row_index, round(r.t, 4) AS t, CASE WHEN n >= 4 THEN round(ref_value, 4) END AS ref_value, coalesce(r.valid AND n >= 4, false) AS valid FROM ref r JOIN between_knots o ON o.source_row_index = r.source_row_index WHERE method = 'spline'""", 4)
def spline_reference(spark: SparkSession, d: str) -> DataFrame:
    knots = alignment.spline_knots(other(spark, d), ["value"])
    return alignment.query_knots(own(spark, d).select("trial_id", "source_row_index", "t"), knots, ["value"])


@query()
def temporal_and_clock_fit(spark: SparkSession, d: str) -> DataFrame:
    own_s, other_s = (cleaning.elapsed(f(spark, d), "t", "rel").withColumn("rel", F.col("rel") / 86400) for f in (own, other))
    return alignment.fit_time(own_s, other_s, Settings(), "value", "value", "rel", "rel")


@query()
def lag_correlation_curve(spark: SparkSession, d: str) -> DataFrame:
    own_s, other_s = (cleaning.elapsed(f(spark, d), "t", "rel").withColumn("rel", F.col("rel") / 86400) for f in (own, other))
    return alignment.correlation_curve(own_s, other_s, Settings(), "value", "value", "rel", "rel")


@query("""WITH $STREAMS, p AS (SELECT trial_id, value AS x, heading AS y, value * heading / 100 AS z FROM s),
m AS (SELECT trial_id, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(y, z) AS e, covar_pop(x, z) AS f FROM p GROUP BY trial_id),
q AS (SELECT *, (a + b + c) / 3 AS q FROM m), r AS (SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
t AS (SELECT *, ((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p) AS h FROM r)
SELECT trial_id, round(sqrt(greatest(0, q + 2 * p * cos(acos(greatest(-1, least(1, h))) / 3 + 2 * pi() / 3))), 3) AS planarity_residual FROM t""", 3)
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    """The distance to the least-squares plane, against the closed form of a symmetric matrix's least eigenvalue."""
    e = stream(spark, d).select("trial_id", F.col("value").alias("x"), F.col("heading").alias("y"), (F.col("value") * F.col("heading") / 100).alias("z"))
    return alignment.plane_fit(e).select("trial_id", "planarity_residual")


@query("""WITH $STREAMS, k AS (SELECT trial_id, t, arg_min(value, source_row_index) AS y FROM v GROUP BY trial_id, t),
h AS (SELECT *, lead(t) OVER w - t AS h, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS s, count(*) OVER (PARTITION BY trial_id) AS n, max(t) OVER (PARTITION BY trial_id) AS hi FROM k WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
g AS (SELECT *, lag(h) OVER w AS h0, lag(s) OVER w AS s0, lead(h) OVER w AS h1, lead(s) OVER w AS s1, lag(h, 2) OVER w AS h00, lag(s, 2) OVER w AS s00 FROM h WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
x AS (SELECT *, CASE WHEN h0 IS NULL THEN ((2 * h + h1) * s - h * s1) / (h + h1) WHEN h IS NULL THEN ((2 * h0 + h00) * s0 - h0 * s00) / (h0 + h00) END AS e, coalesce(s0, 0) AS sl, CASE WHEN h0 IS NULL THEN s ELSE s0 END AS own, CASE WHEN h0 IS NULL THEN s1 ELSE s00 END AS far FROM g),
d AS (SELECT trial_id, t, y, n, hi, CASE WHEN h0 IS NOT NULL AND h IS NOT NULL THEN CASE WHEN s0 * s > 0 THEN 3 * (h0 + h) / ((2 * h + h0) / s0 + (h + 2 * h0) / s) ELSE 0 END
  WHEN sign(e) <> sign(own) THEN 0 WHEN sign(own) <> sign(far) AND abs(e) > 3 * abs(own) THEN 3 * own ELSE e END AS d FROM x),
z AS (SELECT *, lead(t) OVER w AS t1, lead(y) OVER w AS y1, lead(d) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
j AS (SELECT e.trial_id, e.source_row_index, e.t AS q, z.*, t1 - z.t AS h, CASE WHEN t1 IS NULL THEN 0 ELSE (e.t - z.t) / (t1 - z.t) END AS u FROM e ASOF LEFT JOIN z ON e.trial_id = z.trial_id AND e.t >= z.t)
SELECT trial_id, source_row_index, round(CASE WHEN y IS NULL OR q > hi THEN NULL WHEN t1 IS NULL THEN y WHEN n < 3 THEN y + (y1 - y) * u
  ELSE (1 + 2 * u) * power(1 - u, 2) * y + u * power(1 - u, 2) * h * d + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * h * d1 END, 5) AS ref_value FROM j""", 5)
def monotone_reference(spark: SparkSession, d: str) -> DataFrame:
    """The monotone cubic at every telemetry row; it needs a sample's four neighbours only, so SQL can say it."""
    return alignment.query_reference(own(spark, d), other(spark, d), ["value"], ["pchip"]).select("trial_id", "source_row_index", "ref_value")


from gaugeline.plans import more_queries  # noqa: E402, F401 - registers its queries
