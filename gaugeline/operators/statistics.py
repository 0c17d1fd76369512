"""Paired rank statistics over trials. Rank sums are windows and aggregates; p-values come from one row for each test."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import inference
from gaugeline.functions.columns import finite
from gaugeline.operators import ordered
from gaugeline.sources.kept import kept


def average_rank(value: Column, *group: str) -> Column:
    """Rank in ascending order, ties sharing their mean."""
    line = Window.partitionBy(*group).orderBy(value)
    peers = Window.partitionBy(*group, value)
    return F.rank().over(line) + (F.count(F.lit(1)).over(peers) - 1) / 2


def _difference(a: str, b: str) -> Column:
    return finite(F.col(a).cast("double") - F.col(b).cast("double"))


def _sizes(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each distinct size of a difference (v) with how many are positive, negative and zero, and its mean rank. df: group columns, diff."""
    v = F.abs(F.col("diff"))
    counts = df.filter("diff is not null").groupBy(*group, v.alias("v")).agg(
        F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("positive"), F.count_if(F.col("diff") < 0).alias("negative"), F.count_if(F.col("diff") == 0).alias("zero")
    )
    return ordered.mean_ranks(counts, group)


def signed_rank_rows(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Each pair's difference, sign, rank and share of the two rank sums; zeros share their rank between both. The audit of a test."""
    rows = df.withColumn("diff", _difference(a, b)).filter("diff is not null")
    ranks = _sizes(rows.select(*group, "diff"), group).select(F.struct(*group, "v").alias("__at"), "rank")
    rows = rows.withColumn("__at", F.struct(*group, F.abs(F.col("diff")).alias("v"))).join(ranks, "__at").drop("__at")
    zero = F.col("diff") == 0
    return rows.withColumns({
        "sign": F.when(F.col("diff") > 0, "positive").when(F.col("diff") < 0, "negative").otherwise("zero"),
        "plus": F.when(F.col("diff") > 0, F.col("rank")).when(zero, F.col("rank") / 2).otherwise(0.0), "minus": F.when(F.col("diff") < 0, F.col("rank")).when(zero, F.col("rank") / 2).otherwise(0.0),
    })


def _rank_sums(sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    share = F.col("rank") * F.col("zero") / 2
    return sizes.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("positive").alias("n_positive"), F.sum("negative").alias("n_negative"), F.sum("zero").alias("n_zero"),
        F.sum(F.col("rank") * F.col("positive") + share).alias("w_plus"), F.sum(F.col("rank") * F.col("negative") + share).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"),
    )


def signed_rank_sums(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Counts by sign, both rank sums, the lesser of them and the rank-biserial correlation, from one row for each distinct size of a difference."""
    out = _rank_sums(_sizes(df.select(*group, _difference(a, b).alias("diff")), group), group).drop("ties")
    total = F.col("w_plus") + F.col("w_minus")
    return out.withColumns({"reported_w": F.least("w_plus", "w_minus"), "rank_biserial": F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0)})


@F.pandas_udf(T.DoubleType())
def _signed_rank_tail(statistic: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([inference.signed_rank_tail(*row) for row in zip(statistic, n, ties, zeros, strict=True)], dtype=float)


def signed_rank_tests(df: DataFrame, a: str, b: str, group: Sequence[str]) -> DataFrame:
    """The full test for each group: n, counts by sign, rank sums, statistic, p-value, mean and median difference, pseudomedian and status.

    Ranks, sums and medians come from the distinct sizes of differences, dealt by ranges: a population of any size goes to many tasks. Only
    one row for each test meets the functions that have no expression, the tails of the distributions. Group columns aren't NULL.
    """
    every = df.select(*group, _difference(a, b).alias("diff"))
    diffs = every.filter("diff is not null")
    sums = _rank_sums(_sizes(diffs, group), group)
    means = every.groupBy(*group).agg(F.avg("diff").alias("mean_diff"), F.count("diff").alias("__n"))
    middle = ordered.quantiles(diffs, group, ["diff"], {"median_diff": 0.5}).drop("name", "total")
    out = means.join(sums, list(group), "left").join(middle, list(group), "left").join(pseudomedian(diffs, "diff", group), list(group), "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "n_positive", "n_negative", "n_zero")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("w_plus", "w_minus")}
    out = out.withColumns(zero)
    total, enough = F.col("w_plus") + F.col("w_minus"), F.col("n") >= 2
    all_zero = F.col("n_zero") == F.col("n")
    status = F.when(F.col("n") == 0, "no_finite_pairs").when(~enough & all_zero, "insufficient_pairs_all_zero").when(~enough, "insufficient_pairs").when(all_zero, "all_zero_differences").otherwise("ok")
    statistic = F.when(F.col("n") > 0, F.least("w_plus", "w_minus"))
    out = out.withColumns({"statistic": statistic, "rank_biserial": F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0), "status": status})
    # Python functions see all rows, whatever stands around them: without a statistic they give NaN.
    p = F.when(enough, finite(_signed_rank_tail("statistic", "n", F.coalesce("ties", F.lit(0.0)), "n_zero")))
    return out.select(*group, "n", "n_positive", "n_negative", "n_zero", "w_plus", "w_minus", "statistic", p.alias("p_value"), "rank_biserial", "mean_diff", "median_diff", "pseudomedian", "status")


def delta_only_tests(df: DataFrame, delta: str, group: Sequence[str]) -> DataFrame:
    """signed_rank_tests() of differences that are given as such."""
    return signed_rank_tests(df.withColumn("__zero", F.lit(0.0)), delta, "__zero", group)


def complete_blocks(df: DataFrame, methods: Sequence[str], block: str | Sequence[str] = "trial_id", method: str = "method", value: str = "value", support: str | None = None) -> DataFrame:
    """Rows of the blocks that have every method exactly once with a finite value, and one support hash if that is asked for."""
    checks = [F.count("*") == len(methods), F.count_distinct(F.when(F.col(method).isin(*methods), F.col(method))) == len(methods), F.count(value) == len(methods)]
    if support:
        checks += [F.count_distinct(support) == 1, F.count(support) == len(methods)]
    keys = [block] if isinstance(block, str) else list(block)
    whole = df.groupBy(*keys).agg(*[c.alias(f"c{k}") for k, c in enumerate(checks)]).filter(" and ".join(f"c{k}" for k in range(len(checks))))
    return df.join(whole.select(*keys), keys, "left_semi")


def friedman_statistic(df: DataFrame, methods: Sequence[str], block: str = "trial_id", method: str = "method", value: str = "value") -> DataFrame:
    """n, tie-corrected Friedman statistic and Kendall's W of complete blocks, by windows and two aggregates."""
    k = len(methods)
    ranked = complete_blocks(df, methods, block, method, value).withColumn("r", average_rank(F.col(value), block))
    ties = ranked.groupBy(block, value).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")), F.lit(0)).alias("ties"))
    sums = ranked.groupBy(method).agg(F.sum("r").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    raw = 12 / (F.col("n") * k * (k + 1)) * F.col("q") - 3 * F.col("n") * (k + 1)
    statistic = raw / (1 - F.col("ties") / (F.col("n") * k * (k * k - 1)))
    return sums.crossJoin(ties).select(F.coalesce("n", F.lit(0)).alias("n"), statistic.alias("statistic")).withColumn("kendall_w", F.col("statistic") / (F.col("n") * (k - 1)))


def friedman_tests(df: DataFrame, methods: Sequence[str], group: Sequence[str], block: str = "trial_id", method: str = "method", value: str = "value", support: str | None = None) -> DataFrame:
    """n, statistic, Kendall's W, p-value and status of each group's complete blocks; a block may be in several groups."""
    k = len(methods)
    ranked = complete_blocks(df, methods, [*group, block], method, value, support).withColumn("r", average_rank(F.col(value), *group, block))
    tied = ranked.groupBy(*group, block, value).agg(F.count("*").alias("c")).groupBy(*group).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    sums = ranked.groupBy(*group, method).agg(F.sum("r").alias("s"), F.count("*").alias("m")).groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("m").alias("n"))
    raw = 12 / (F.col("n") * k * (k + 1)) * F.col("q") - 3 * F.col("n") * (k + 1)
    left = 1 - F.col("ties") / (F.col("n") * k * (k * k - 1))
    out = sums.join(tied, list(group)).withColumn("statistic", F.when(left > 0, raw / left).otherwise(0.0))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: inference.chi2_tail(v, k - 1))

    enough = F.col("n") >= 2
    return out.select(*group, "n", F.when(enough, F.col("statistic")).alias("statistic"), F.when(enough, F.col("statistic") / (F.col("n") * (k - 1))).alias("kendall_w"), F.when(enough, tail("statistic")).alias("p_value"), F.when(enough, "ok").otherwise("insufficient_complete_blocks").alias("status"))


def paired_values(df: DataFrame, arm: str, arms: tuple[str, str], value: str, key: str = "trial_id") -> DataFrame:
    """trial, a, b: mean values of two arms, for trials that have both."""
    wide = df.filter(F.col(arm).isin(*arms)).groupBy(key).agg(*[F.avg(F.when(F.col(arm) == x, F.col(value))).alias(n) for x, n in zip(arms, "ab", strict=True)])
    return wide.filter("a is not null and b is not null")


def compare_configurations(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """The Wilcoxon test of two configurations for each group: status, n_pairs, median_diff, test_statistic, p_value, significant_05.

    Differences of zero are dropped before ranks are given; fewer than three pairs are insufficient_data; where all differences are zero there
    is no statistic and no p-value, and nothing is significant. Ranks come by ranges, as in signed_rank_tests().
    """
    every = df.select(*group, _difference(a, b).alias("diff")).filter("diff is not null")
    sums = _rank_sums(_sizes(every.filter("diff <> 0"), group), group).select(*group, F.least("w_plus", "w_minus").alias("test_statistic"), F.col("n").alias("__m"), "ties")
    median = ordered.quantiles(every, group, ["diff"], {"median_diff": 0.5}).drop("name").withColumnRenamed("total", "n_pairs")
    out = median.join(sums, list(group), "left") if group else median.crossJoin(sums)
    enough = F.col("n_pairs") >= 3
    p = F.when(enough, finite(_signed_rank_tail("test_statistic", F.coalesce("__m", F.lit(0)), F.coalesce("ties", F.lit(0.0)), F.lit(0))))
    out = out.withColumns({"p_value": p, "test_statistic": F.when(enough, F.col("test_statistic"))})
    return out.select(*group, F.when(enough, "success").otherwise("insufficient_data").alias("status"), "n_pairs", F.when(enough, F.col("median_diff")).alias("median_diff"), "test_statistic", "p_value", F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant_05"))


def comparator_tests(df: DataFrame, a: str, b: str, group: Sequence[str]) -> DataFrame:
    """Whether the differences look normal, and then a paired t test, else a Wilcoxon test, for each group.

    normality_test_name, normality_statistic, normality_p_value, paired_test_name, paired_test_statistic, paired_test_p_value; fewer
    than two pairs are not_computable, fewer than three have no normality test and so a t test. The t test and the rank sums are aggregates; the
    normality statistic is one, too, over values in order with the weights of their places.
    """
    pairs = df.select(*group, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))
    moments = pairs.groupBy(*group).agg(F.count("*").alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("s"), F.var_pop("diff").alias("v"))
    normal = _normality(pairs, group)
    wilcoxon = compare_configurations(pairs, "a", "b", group).select(*group, F.col("test_statistic").alias("__w"), F.col("p_value").alias("__wp"))
    out = moments.join(normal, list(group), "left").join(wilcoxon, list(group), "left")
    t = F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n")))
    ranked = F.coalesce(F.col("normality_p_value") < 0.05, F.lit(False)) & (F.col("n") >= 2)
    out = out.withColumns({"__t": t, "paired_test_name": F.when(F.col("n") < 2, "not_computable").when(ranked, "wilcoxon").otherwise("ttest_rel")})
    is_t = F.col("paired_test_name") == "ttest_rel"
    return out.select(
        *group, "n", F.lit("shapiro").alias("normality_test_name"), "normality_statistic", "normality_p_value", "paired_test_name",
        F.when(ranked, F.col("__w")).when(is_t, F.col("__t")).alias("paired_test_statistic"), F.when(ranked, F.col("__wp")).when(is_t, finite(_t_tail("__t", "n"))).alias("paired_test_p_value"),
    )


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([inference.t_tail(x, k - 1) for x, k in zip(t, n, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _normal_score(p: pd.Series) -> pd.Series:
    return pd.Series([inference.normal_quantile(x) for x in p], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def _shapiro(n: pd.Series, total: pd.Series, spread: pd.Series, inner: pd.Series, ends: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inference.shapiro_from_sums(int(k), m, v, x, e) for k, m, v, x, e in zip(n, total, spread, inner, ends, strict=True)], columns=["w", "p"], dtype=float)


def _normality(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """normality_statistic and normality_p_value of each group's diff: sums over its values in order, and its two outermost values on either side.

    Equal values take the sum of their places' normal scores, so that a value is one row however often it occurs.
    """
    placed = ordered.cumulated(ordered.counted(pairs, group, "diff"), group, ["v"])
    each = placed.select(*group, "v", "total", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("place"))
    scored = each.withColumn("score", _normal_score((F.col("place") - 0.375) / (F.col("total") + 0.25)))
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("v")))
    sums = scored.groupBy(*group).agg(
        F.max("total").cast("long").alias("n"), F.sum(F.col("score") * F.col("score")).alias("total"), (F.var_pop("v") * F.max("total")).alias("spread"),
        F.sum(F.when((F.col("place") > 2) & (F.col("place") < F.col("total") - 1), F.col("score") * F.col("v")).otherwise(0.0)).alias("inner"),
        F.array(at(1), at(2), at(F.col("total") - 1), at(F.col("total"))).alias("ends"),
    )
    tested = sums.filter("n >= 3").withColumn("t", _shapiro("n", "total", "spread", "inner", "ends"))
    return tested.select(*group, finite(F.col("t.w")).alias("normality_statistic"), finite(F.col("t.p")).alias("normality_p_value"))


def contrasts(df: DataFrame, methods: Sequence[str], block: str = "trial_id", method: str = "method", value: str = "value") -> DataFrame:
    """Differences of every pair of methods within each block, in the order of the methods. One pivot; no self join."""
    wide = complete_blocks(df, methods, block, method, value).groupBy(block).pivot(method, list(methods)).agg(F.first(value))
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    items = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])
    return wide.select(block, F.explode(items).alias("c")).select(block, "c.*")


def holm(df: DataFrame, p: str = "p_value", out: str = "p_adjusted", family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjustment within a family; NULL p-values don't count and stay NULL. A family is a handful of tests."""
    line = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*family))
    scaled = F.col(p) * (m - F.row_number().over(line) + 1)
    ranked = df.withColumn("__scaled", scaled)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__scaled").over(line.rowsBetween(Window.unboundedPreceding, 0))))).drop("__scaled")


def decide(n: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when((n < 2) | p.isNull(), "inconclusive").when(p < alpha, "supported").otherwise("not_supported")


#: Populations of up to so many differences have their Walsh median worked out in one task; larger ones by passes over ranges.
DIRECT = 200_000


def pseudomedian(df: DataFrame, diff: str, group: Sequence[str], direct: int = DIRECT) -> DataFrame:
    """Median of all averages of two of a group's differences; the averages are counted, not listed. Group columns aren't NULL."""
    kinds = dict(df.dtypes)

    def middle(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, inference.walsh_median(f["d"].to_numpy(float))]], columns=[*group, "pseudomedian"])

    known = df.select(*group, F.col(diff).cast("double").alias("d")).filter("d is not null")
    small = lambda rows: rows.groupBy(*group).applyInPandas(middle, ", ".join([*(f"{g} {kinds[g]}" for g in group), "pseudomedian double"]))
    if not group:
        return ordered.walsh_medians(known, (), "d") if known.count() > direct else small(known)
    large = kept(known.groupBy(*group).count().filter(F.col("count") > direct).select(*group))
    if large.isEmpty():
        return small(known)
    own = small(known.join(F.broadcast(large), list(group), "left_anti"))
    return own.unionByName(ordered.walsh_medians(known.join(F.broadcast(large), list(group), "left_semi"), group, "d"))
