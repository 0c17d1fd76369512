"""Residual metrics, robust summaries and grouped descriptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions.columns import finite, huber, is_evaluation
from gaugeline.operators import ordered
from gaugeline.operators.asof import partner_after
from gaugeline.sources.kept import kept


def ate(residual: Column) -> list[Column]:
    """Root mean square, mean, spread and count of residual norms."""
    r = finite(residual)
    return [F.sqrt(F.avg(r * r)).alias("ate_rmse"), F.avg(r).alias("ate_mean"), F.stddev_pop(r).alias("ate_std"), F.count(r).alias("num_samples")]


def rmse_mm(dx: Column, dy: Column) -> Column:
    return F.sqrt(F.avg(dx * dx + dy * dy)) * 1000


def robust(df: DataFrame, residual: str, s: Settings, key: str = "trial_id") -> DataFrame:
    """Median absolute error, Huber mean, RMSE without both tails, outliers and percentiles of each trial's residuals."""
    e = df.filter(finite(F.col(residual)).isNotNull())
    ratio = (1 - s.trimmed_percentile / 100) / 2
    line = Window.partitionBy(key)
    place = e.withColumns({"__k": F.row_number().over(line.orderBy(residual)), "__n": F.count("*").over(line)})
    cut = F.floor(F.col("__n") * ratio + 1e-9)
    kept = (cut == 0) | (F.col("__n") <= 2 * cut) | ((F.col("__k") > cut) & (F.col("__k") <= F.col("__n") - cut))
    r, a = F.col(residual), F.abs(F.col(residual))
    return place.groupBy(key).agg(
        F.median(a).alias("median_abs"), F.avg(huber(r, s.huber_delta)).alias("huber_loss"), F.sqrt(F.avg(F.when(kept, r * r))).alias("trimmed_rmse"), F.count_if(a > s.outlier_m).alias("outlier_count"),
        F.avg(a).alias("mean_abs"), F.percentile(a, F.lit(0.75)).alias("p75"), F.percentile(a, F.lit(0.95)).alias("p95"), F.max(a).alias("max_abs"), F.min(a).alias("min_abs"),
    )


def by_phase(df: DataFrame, residual: str, phase: str = "phase", key: str = "trial_id") -> DataFrame:
    """RMSE and count for each phase that is present."""
    return df.filter(finite(F.col(residual)).isNotNull()).groupBy(key, phase).agg(F.sqrt(F.avg(F.col(residual) * F.col(residual))).alias("phase_rmse"), F.count("*").alias("phase_count"))


def rpe_by_time(df: DataFrame, s: Settings, own: Sequence[str] = ("odometry_x", "odometry_y"), reference: Sequence[str] = ("vrmt_aligned_x", "vrmt_aligned_y"), key: str = "trial_id", time: str = "t", identity: str = "source_row_index") -> DataFrame:
    """Error of the displacement over the interval, for each row with a partner."""
    good = df.filter(" and ".join(f"{c} is not null" for c in (time, *own, *reference)))
    pairs = partner_after(good, [*own, *reference], s.rpe_interval_s, s.rpe_tolerance_s, key, time, identity)
    parts = [(F.col(f"partner.{o}") - F.col(o)) - (F.col(f"partner.{r}") - F.col(r)) for o, r in zip(own, reference, strict=True)]
    return pairs.withColumn("rpe", F.sqrt(sum((p * p for p in parts), F.lit(0.0))))


def rpe_by_index(df: DataFrame, delta: int = 1, own: Sequence[str] = ("odometry_x", "odometry_y"), reference: Sequence[str] = ("vrmt_aligned_x", "vrmt_aligned_y"), key: str = "trial_id", order: Sequence[str] = ("t", "source_row_index")) -> DataFrame:
    line = Window.partitionBy(key).orderBy(*order)
    step = lambda c: F.lead(c, delta).over(line) - F.col(c)
    parts = [step(o) - step(r) for o, r in zip(own, reference, strict=True)]
    return df.withColumn("rpe", F.sqrt(sum((p * p for p in parts), F.lit(0.0)))).filter("rpe is not null")


def describe_errors(df: DataFrame, column: str, prefix: str, key: str = "trial_id") -> DataFrame:
    e = F.col(column)
    return df.groupBy(key).agg(F.sqrt(F.avg(e * e)).alias(f"{prefix}_rmse"), F.avg(e).alias(f"{prefix}_mean"), F.stddev_pop(e).alias(f"{prefix}_std"), F.median(e).alias(f"{prefix}_median"), F.count(e).alias(f"{prefix}_count"))


def robust_statistics(df: DataFrame, column: str) -> DataFrame:
    """Median, MAD, quartile range and extremes over trials; zeros without any. Medians are looked up in order, not gathered."""
    counts = kept(ordered.counted(df, (), column))
    middle = ordered.quantiles_of_counts(counts, (), {"median": 0.5, "q1": 0.25, "q3": 0.75})
    deviations = counts.crossJoin(middle.select("median")).groupBy(F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("n").alias("n"))  # one row beside each
    mad = ordered.quantiles_of_counts(deviations, (), {"mad": 0.5}).select("mad")
    ends = counts.agg(F.min("v").alias("min"), F.max("v").alias("max"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    every = ends.crossJoin(middle).crossJoin(mad).withColumn("iqr", F.col("q3") - F.col("q1"))  # one row each
    return every.select(*[zero(c) for c in ("median", "mad", "iqr", "min", "max")])


def summary(columns: Sequence[str]) -> list[Column]:
    """n, mean, sample spread, median, quartile range, extremes and the 95 % interval's half width of each column."""
    out: list[Column] = []
    for c in columns:
        v = F.col(c)
        out += [F.count(v).alias(f"{c}_n"), F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std"), F.median(v).alias(f"{c}_median"), (F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))).alias(f"{c}_iqr"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), (1.96 * F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{c}_ci95")]
    return out


def outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows whose z score is beyond the limit."""
    moments = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.crossJoin(moments).filter(F.col("__s") > 0).withColumn("z", (F.col(column) - F.col("__m")) / F.col("__s")).filter(F.abs("z") > limit).drop("__m", "__s")


def repeatability(df: DataFrame, column: str, group: str = "scenario_id", limit: float = 50.0) -> DataFrame:
    v = F.col(column)
    out = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))).alias("iqr"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean"))
    return out.withColumns({"cv": cv, "status": F.when(F.col("n") < 2, "insufficient_repetitions").when(F.col("std") <= limit, "repeatable").otherwise("variable")})


def _parameters(df: DataFrame) -> DataFrame:
    """Rotation in degrees and the translation's length in mm beside a trial's parameters."""
    return df.withColumns({"rotation_deg": F.degrees("theta_rad"), "translation_mm": F.hypot("tx", "ty") * 1000})


def scenario_repeatability(df: DataFrame, expected: int = 5, limit: float = 50.0) -> DataFrame:
    """For each scenario: repetitions, spread of the error, and spreads of offset, rotation and translation (0 for a single one).

    ``df``: scenario_id, rmse_mm, ate_mm, rpe_mm, offset_s, theta_rad, tx, ty.
    """
    spread = lambda c: F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0)
    both = [x for c in ("ate_mm", "rpe_mm") for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    both += [x for c in ("offset_s", "rotation_deg", "translation_mm") for x in (F.avg(c).alias(f"mean_{c}"), spread(c).alias(f"std_{c}"))]
    quartiles = F.percentile("rmse_mm", F.lit(0.75)) - F.percentile("rmse_mm", F.lit(0.25))
    out = _parameters(df).groupBy("scenario_id").agg(F.count("*").alias("repetitions"), F.avg("rmse_mm").alias("mean_rmse_mm"), F.stddev_samp("rmse_mm").alias("std_rmse_mm"), F.median("rmse_mm").alias("median_rmse_mm"), quartiles.alias("iqr_rmse_mm"), *both)
    # Without a spread, as of one repetition, nothing is below the limit.
    status = F.when(F.col("std_rmse_mm") < limit, "acceptable").otherwise("high_variance")
    return out.withColumns({"missing_repetitions": F.lit(expected) - F.col("repetitions"), "cv_rmse": F.when(F.col("mean_rmse_mm") > 0, F.col("std_rmse_mm") / F.col("mean_rmse_mm")).otherwise(0.0), "status": status})


def parameter_stability(df: DataFrame) -> DataFrame:
    """Parameters and errors of every trial side by side."""
    return _parameters(df).select("scenario_id", "trial_id", "offset_s", "rotation_deg", "tx", "ty", "translation_mm", "fit_rmse_mm", "rmse_mm", "ate_mm", "rpe_mm", F.lit("stable").alias("status"))


def scenario_robustness(df: DataFrame, limit: float = 50.0) -> DataFrame:
    """For each scenario: error, what makes it hard, and its place from the least error on.

    ``df``: scenario_id, rmse_mm, ate_mm, rpe_mm, peak_ratio, irregularity, temporal_status. Scenarios are as many as a design has cells.
    """
    mean = F.avg("rmse_mm")
    out = df.groupBy("scenario_id").agg(
        F.count("*").alias("repetitions"), mean.alias("mean_rmse_mm"), F.median("rmse_mm").alias("median_rmse_mm"), F.percentile("rmse_mm", F.lit(0.95)).alias("p95_rmse_mm"), F.avg("ate_mm").alias("mean_ate_mm"), F.avg("rpe_mm").alias("mean_rpe_mm"),
        F.avg("irregularity").alias("mean_irregularity"), F.avg(finite(F.col("peak_ratio"))).alias("mean_peak_ratio"), F.avg(F.when(F.col("temporal_status").isNotNull(), (F.col("temporal_status") != "ok").cast("int"))).alias("temporal_ambiguity_rate"),
        F.when(mean < limit, "robust").otherwise("brittle").alias("status"), (mean / 100).alias("difficulty_score"), F.when(mean > limit, "hard").otherwise("easy").alias("difficulty"),
    )
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_rmse_mm").asc_nulls_last(), "scenario_id")))


def group_summary(df: DataFrame, group: Sequence[str], columns: Sequence[str] = ("rmse_mm",)) -> DataFrame:
    """summary() over all rows, by each of the grouping columns and by all of them: a column is NULL where it isn't grouped by, and level says which are.

    Equal values are counted before the groups are formed, so all sets are made from one pass over the rows, and no group's values are gathered:
    medians and quartiles are looked up in order.
    """
    sets = [[], *[[F.col(g)] for g in group], *([[F.col(g) for g in group]] if len(group) > 1 else [])]
    items = F.array(*[F.struct(F.lit(c).alias("name"), finite(F.col(c)).alias("v")) for c in columns])
    long = df.select(*group, F.inline(items)).filter("v is not null").groupBy(*group, "name", "v").agg(F.count("*").alias("n"))
    by_set = kept(long.groupingSets([[*s, F.col("name"), F.col("v")] for s in sets], *[F.col(g) for g in group], F.col("name"), F.col("v")).agg((F.grouping_id() / 4).cast("long").alias("level"), F.sum("n").alias("n")))
    keys = [*group, "level", "name"]
    key = F.struct(*keys)
    n, v = F.col("n").cast("double"), F.col("v")
    means = by_set.groupBy(*keys).agg(F.sum("n").alias("n_rows"), (F.sum(n * v) / F.sum(n)).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).withColumn("__key", key)
    # Deviations from the mean, as sums of squares would cancel for values far from 0.
    apart = by_set.withColumn("__key", key).join(means.select("__key", "mean"), "__key").groupBy("__key").agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"))
    places = ordered.quantiles_of_counts(by_set, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(key.alias("__key"), "q1", "median", "q3")
    std = F.when(F.col("n_rows") > 1, F.sqrt(F.col("squares") / (F.col("n_rows") - 1)))
    each = means.join(apart, "__key").join(places, "__key").withColumns({"std": std, "iqr": F.col("q3") - F.col("q1")}).withColumn("ci95", 1.96 * F.col("std") / F.sqrt("n_rows"))
    part = lambda c, x: F.max(F.when(F.col("name") == c, F.col(x)))
    wide = [part(c, x).alias(f"{c}_{out}") for c in columns for x, out in (("n_rows", "n"), ("mean", "mean"), ("std", "std"), ("median", "median"), ("iqr", "iqr"), ("min", "min"), ("max", "max"), ("ci95", "ci95"))]
    return each.groupBy(*group, "level").agg(*wide)


def variance_decomposition(df: DataFrame, column: str, group: str = "scenario_id") -> DataFrame:
    """Overall variance, that of the group means, and what is left, at least 0."""
    # Moments are merged from groups' own, as sums of squares would cancel for values far from 0.
    v = F.col(column)
    groups = df.filter(v.isNotNull()).groupBy(group).agg(F.avg(v).alias("m"))
    overall = df.agg(F.var_samp(v).alias("overall"))
    out = overall.crossJoin(groups.agg(F.var_samp("m").alias("between")))  # one row each
    return out.withColumn("within", F.greatest(F.lit(0.0), F.col("overall") - F.col("between")))


#: Sizes of a difference that are counted as exceeded, by the names they are reported under.
EXCEEDED: dict[str, float] = {"0.0": 0.0, "1e-12": 1e-12, "1e-09": 1e-9, "1e-06": 1e-6, "0.001": 0.001, "0.01": 0.01, "0.1": 0.1}
PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def describe_delta(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """What a paired difference looks like: how many there are, are exactly 0 and aren't, how many exceed each size in EXCEEDED (a map from its name), mean,
    median, spread, quartile range, percentiles and extremes, the largest size among them.

    A spread needs two values. Percentiles are exact, for a group of any size. Without a group an empty table has a row of zeros and NULLs.
    """
    v = finite(F.col(column))
    over = F.create_map(*[x for name, limit in EXCEEDED.items() for x in (F.lit(name), F.count_if(F.abs(v) > limit))])
    out = df.groupBy(*group).agg(
        F.count(v).alias("paired_n"), F.count_if(v == 0).alias("exact_equality_count"), F.count_if(v != 0).alias("nonzero_count"), over.alias("threshold_counts"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.max(F.abs(v)).alias("max_abs"),
    )
    places = ordered.quantiles(df, group, [column], {f"p{p:02d}": p / 100 for p in PERCENTS}).drop("name", "total")
    keyed = lambda x: x.withColumn("__at", F.struct(*group, F.lit(0).alias("__one")))  # noqa: E731 - NULL groups are groups, too
    both = keyed(out).join(keyed(places).drop(*group), "__at", "left").drop("__at")
    return both.withColumnRenamed("p50", "median").withColumn("iqr", F.col("p75") - F.col("p25"))


def most_common(df: DataFrame, group: Sequence[str], column: str, out: str = "most_common") -> DataFrame:
    """The value that each group has most often; of equally frequent ones the least."""
    counts = df.groupBy(*group, column).agg(F.count("*").alias("__n"))
    return counts.groupBy(*group).agg(F.min_by(column, F.struct(-F.col("__n"), column)).alias(out))


def populations(df: DataFrame, tier: str, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows once for each overlapping population that their tier belongs to."""
    names = F.array_compact(F.array(*[F.when(F.col(tier).isin(*tiers), F.lit(name)) for name, tiers in sets.items()]))
    return df.withColumn("population", F.explode(names))


def primary_support(df: DataFrame, partition: str = "partition") -> DataFrame:
    """Rows of the held-out metric: evaluation partition and all coordinates known."""
    return df.filter(is_evaluation(F.col(partition)) & F.expr("odometry_x is not null and odometry_y is not null and vrmt_aligned_x is not null and vrmt_aligned_y is not null"))
