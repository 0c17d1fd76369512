"""Time joins without a cross product: queries and samples are united, sorted once within their trial, and each query takes
the last sample before it and the first after it from the sorted rows. One shuffle on the trial, cost n log n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(queries: DataFrame, samples: DataFrame, values: Sequence[str], key: str = "trial_id", query_time: str = "t", sample_time: str = "t", sample_order: str | None = None, at_equal: str = "before", slice_s: float | None = None) -> DataFrame:
    """Each query row with structs ``prev`` and ``next`` of (t, *values): the nearest samples on its two sides.

    ``at_equal``: whether a sample at the very time counts as before the query ("before": prev is backward inclusive, next
    strictly after) or after it ("after": prev strictly before, next inclusive). Samples of equal time are in the order of
    ``sample_order``. Rows with a NULL time match nothing.

    ``slice_s``: cut every trial into slices of so many seconds, each sorted on its own, so that a trial of any size goes to many tasks. What a slice
    can't see, the last sample before it and the first behind it, comes from a table with a row for each slice. Without it a trial is one slice.
    """
    order = F.col(sample_order) if sample_order else F.lit(0).cast("bigint")
    sample = F.struct(F.col(sample_time).alias("t"), *[F.col(v) for v in values])
    kept = F.struct(*[F.col(c) for c in queries.columns])
    side = {"before": (1, 0), "after": (0, 1)}[at_equal]
    kind = dict(queries.select(kept.alias("q")).dtypes)["q"]
    s_kind = dict(samples.select(sample.alias("s")).dtypes)["s"]
    q = queries.select(F.col(key), F.col(query_time).cast("double").alias("__t"), F.lit(side[0]).alias("__side"), F.lit(None).cast("bigint").alias("__order"), kept.alias("q"), F.lit(None).cast(s_kind).alias("s"))
    s = samples.filter(F.col(sample_time).isNotNull()).select(F.col(key), F.col(sample_time).cast("double").alias("__t"), F.lit(side[1]).alias("__side"), order.cast("bigint").alias("__order"), F.lit(None).cast(kind).alias("q"), sample.alias("s"))
    both = q.unionByName(s)
    place = [F.col("__t").asc_nulls_first(), "__side", "__order"]
    if not slice_s:
        found = _sides(both, [key], place)
    else:
        both = both.withColumn("__slice", F.struct(F.col(key).alias("key"), F.floor(F.col("__t") / float(slice_s)).alias("n")))
        at = F.when(F.col("s").isNotNull(), F.struct("__t", "__side", "__order"))
        ends = both.groupBy("__slice").agg(F.max_by("s", at).alias("last"), F.min_by("s", at).alias("first"))
        line = Window.partitionBy("__slice.key").orderBy("__slice.n")
        carried = ends.select(
            "__slice", F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
            F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
        )
        found = _sides(both, ["__slice"], place).join(carried, "__slice").withColumns({"prev": F.coalesce("prev", "__before"), "next": F.coalesce("next", "__after")})
    known = F.col("__t").isNotNull()
    return found.select("q.*", F.when(known, F.col("prev")).alias("prev"), F.when(known, F.col("next")).alias("next"))


def _sides(both: DataFrame, group: Sequence[str], place: list) -> DataFrame:
    """Query rows with the nearest samples on either side within their group."""
    line = Window.partitionBy(*group).orderBy(*place)
    return both.withColumns({
        "prev": F.last("s", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.first("s", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("q is not null")


def inclusive_bracket(queries: DataFrame, samples: DataFrame, values: Sequence[str], **options) -> DataFrame:
    """As bracket(), but a sample at the query's very time is both prev and next."""
    found = bracket(queries, samples, values, at_equal="before", **options)
    time = F.col(options.get("query_time", "t")).cast("double")
    return found.withColumn("next", F.when(F.col("prev.t") == time, F.col("prev")).otherwise(F.col("next")))


def zero_order_hold(queries: DataFrame, samples: DataFrame, values: Sequence[str], **options) -> DataFrame:
    """Values of the last sample at or before each query, within the samples' time span only; else NULL and valid = false."""
    found = inclusive_bracket(queries, samples, values, **options)
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    keep = [c for c in found.columns if c not in ("prev", "next")]
    return found.select(*keep, *[F.when(inside, F.col(f"prev.{v}")).alias(f"ref_{v}") for v in values], inside.alias("valid"))


def linear(queries: DataFrame, samples: DataFrame, values: Sequence[str], **options) -> DataFrame:
    """Linear interpolation between the two neighbouring samples, within their span only."""
    found = inclusive_bracket(queries, samples, values, **options)
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    time = F.col(options.get("query_time", "t")).cast("double")
    width = F.col("next.t") - F.col("prev.t")

    def between(v: str) -> Column:
        a, b = F.col(f"prev.{v}").cast("double"), F.col(f"next.{v}").cast("double")
        return F.when(inside, F.when(width > 0, a + (b - a) * (time - F.col("prev.t")) / width).otherwise(a))

    keep = [c for c in found.columns if c not in ("prev", "next")]
    return found.select(*keep, *[between(v).alias(f"ref_{v}") for v in values], inside.alias("valid"))


def nearest_gap(queries: DataFrame, samples: DataFrame, **options) -> DataFrame:
    """Distance in time to the nearest sample on either side, as column gap."""
    found = inclusive_bracket(queries, samples, [], **options)
    time = F.col(options.get("query_time", "t")).cast("double")
    gap = F.least(F.abs(time - F.col("prev.t")), F.abs(F.col("next.t") - time))
    return found.withColumn("gap", gap).drop("prev", "next")


def partner_after(df: DataFrame, values: Sequence[str], interval: float, tolerance: float, key: str = "trial_id", time: str = "t", identity: str = "source_row_index", slice_s: float | None = None) -> DataFrame:
    """A tolerance-band self join: each row with the struct ``partner`` of the sample nearest to t + interval.

    Only the last sample before that time and the first at or after it are candidates; of equally near ones that of the
    lower identity is taken. Rows without a candidate within the tolerance are left out.
    """
    source = df.filter(F.col(time).isNotNull())
    carried = [identity, *values]
    queries = source.withColumn("__target", F.col(time) + F.lit(float(interval)))
    found = bracket(queries, source, carried, key=key, query_time="__target", sample_time=time, sample_order=identity, at_equal="after", slice_s=slice_s)

    def candidate(side: str) -> Column:
        miss = F.abs(F.col(f"{side}.t") - F.col(time) - F.lit(float(interval)))
        ranked = F.struct(miss.alias("miss"), F.col(f"{side}.{identity}").alias("id"), F.col(side).alias("row"))
        return F.when((miss <= tolerance) & (F.col(f"{side}.t") > F.col(time)), ranked)

    best = F.array_min(F.array_compact(F.array(candidate("prev"), candidate("next"))))
    return found.withColumn("partner", best["row"]).filter("partner is not null").drop("prev", "next", "__target")


def gap_report(own: DataFrame, other: DataFrame, own_time: str = "local_time_s", other_time: str = "relative_time_s", key: str = "trial_id") -> DataFrame:
    """For each trial with samples in both streams: how many, and how far, in ms, the first stream's samples are from the nearest of the other."""
    samples = other.select(key, F.col(other_time).alias("t")).filter("t is not null")
    gaps = nearest_gap(own.select(key, F.col(own_time).alias("t")).filter("t is not null"), samples, key=key).withColumn("ms", F.col("gap") * 1000)
    # A sample outside the other stream's span has a neighbour on one side only, which is its nearest.
    each = gaps.groupBy(key).agg(F.count("*").alias("num_ev3_samples"), F.avg("ms").alias("mean_nearest_timestamp_gap_ms"), F.median("ms").alias("median_nearest_timestamp_gap_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_nearest_timestamp_gap_ms"), F.max("ms").alias("max_nearest_timestamp_gap_ms"))
    counts = samples.groupBy(key).agg(F.count("*").alias("num_vive_samples"))
    return each.join(counts, key).withColumn("asynchrony_status", F.lit("acceptable"))


def query_time_report(aligned: DataFrame, trials: DataFrame, time: str = "t_common_s", key: str = "trial_id") -> DataFrame:
    """For each of the trials: number, span and spacing of the times at which the reference was asked; fewer than two have none."""
    line = Window.partitionBy(key).orderBy(time)
    steps = aligned.select(key, time, (F.col(time) - F.lag(time).over(line)).alias("dt"))
    found = steps.groupBy(key).agg(
        F.count("*").alias("num_query_times"), F.min(time).alias("query_start_s"), F.max(time).alias("query_end_s"), F.avg("dt").alias("mean_query_dt_s"), F.median("dt").alias("median_query_dt_s"), F.stddev_pop("dt").alias("std_query_dt_s")
    ).filter("num_query_times > 1")
    out = trials.select(key).join(found, key, "left")
    status = F.when(F.col("num_query_times").isNull(), "failed_metric_computation").otherwise("success")
    return out.withColumns({"query_status": status, "num_query_times": F.coalesce("num_query_times", F.lit(0)), "strategy_id": F.lit("ct_query"), "query_time_source": F.lit("ev3")})
