"""Order statistics by ranges, and the tests that rest on them, against NumPy and against whole groups in memory."""

import math
import random

import numpy as np
import pytest

from gaugeline.functions import inference
from gaugeline.operators import comparisons, metrics, ordered, statistics

SCHEMA = "g string, a double, b double"


def groups(seed=2):
    rng = np.random.default_rng(seed)
    return {
        "ties": (np.round(rng.normal(size=120), 1), np.zeros(120)), "exact": (rng.normal(0.3, 1, 30), rng.normal(size=30)), "many": (rng.exponential(size=400), rng.normal(size=400)),
        "zeros": (np.zeros(5), np.zeros(5)), "one": (np.array([2.0]), np.array([1.0])), "two": (np.array([2.0, 3.0]), np.array([1.0, 5.0])), "three": (np.array([2.0, 3.0, 9.0]), np.array([1.0, 5.0, 2.0])),
    }


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(g, float(x), float(y)) for g, (a, b) in groups().items() for x, y in zip(a, b, strict=True)]
    rows += [("none", None, 1.0), ("none", math.nan, 1.0), ("many", math.inf, 1.0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_quantiles_of_columns_and_groups(spark, frame):
    got = {(r["g"], r["name"]): r for r in ordered.quantiles(frame, ["g"], ["a", "b"], {"low": 0.01, "q": 0.25, "m": 0.5, "high": 0.95}).collect()}
    for g, (a, b) in groups().items():
        for name, x in (("a", a), ("b", b)):
            r = got[g, name]
            if (g, name) != ("many", "b"):
                assert r["total"] == len(x)
                assert [r["low"], r["q"], r["m"], r["high"]] == pytest.approx(np.quantile(x, [0.01, 0.25, 0.5, 0.95]).tolist())
    whole = ordered.quantiles(frame, [], ["a"], {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(np.median(np.concatenate([a for a, _ in groups().values()])))
    assert ordered.quantiles(frame.limit(0), ["g"], ["a"], {"m": 0.5}).count() == 0


def test_one_value_or_group_is_spread_over_tasks(spark):
    df = spark.range(20_000).selectExpr("id % 7000 as v", "if(id < 19000, 'hot', 'cold') as g").groupBy("g", "v").count().withColumnRenamed("count", "n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = df.repartitionByRange("g", "v")
        from pyspark.sql import functions as F

        assert dealt.filter("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0, 0.0), (None, 3.0, 0.0), ("x", 5.0, 0.0)], SCHEMA)
    got = {r["g"]: r for r in metrics.describe_delta(df, "a", ["g"]).collect()}
    assert (got[None]["median"], got[None]["paired_n"], got["x"]["p99"]) == (2.0, 2, 5.0)


def test_tests_equal_those_of_whole_groups(spark, frame):
    got = {r["g"]: r for r in statistics.signed_rank_tests(frame, "a", "b", ["g"]).collect()}
    assert set(got) == {*groups(), "none"} and got["none"]["status"] == "no_finite_pairs" and got["none"]["n"] == 0 and got["none"]["p_value"] is None
    for g, (a, b) in groups().items():
        want, r = inference.signed_rank(a - b), got[g]
        assert [r[c] for c in ("n", "n_positive", "n_negative", "n_zero", "status")] == [want.n, want.positive, want.negative, want.zero, want.status]
        assert [r["w_plus"], r["w_minus"], r["statistic"], r["rank_biserial"], r["pseudomedian"]] == pytest.approx([want.w_plus, want.w_minus, want.statistic, want.rank_biserial, want.pseudomedian])
        assert (r["mean_diff"], r["median_diff"]) == pytest.approx((np.mean(a - b), np.median(a - b)), abs=1e-12)
        assert (r["p_value"] is None) if math.isnan(want.p) else r["p_value"] == pytest.approx(want.p)


def test_walsh_medians_by_ranges_are_exact(spark, frame):
    some = frame.filter("g <> 'none' and a < 1e300").selectExpr("g", "a - b as d")
    got = {r["g"]: r["pseudomedian"] for r in statistics.pseudomedian(some, "d", ["g"], direct=0).collect()}
    assert got == pytest.approx({g: inference.walsh_median(a - b) for g, (a, b) in groups().items()}, abs=1e-12)


def test_audit_rows_add_up(spark, frame):
    rows = statistics.signed_rank_rows(frame, "a", "b", ["g"]).collect()
    for g, (a, b) in groups().items():
        own = [r for r in rows if r["g"] == g]
        want = inference.signed_rank(a - b)
        assert (len(own), sum(r["plus"] for r in own), sum(r["minus"] for r in own)) == pytest.approx((want.n, want.w_plus, want.w_minus))


def test_two_configurations(spark, frame):
    got = {r["g"]: r for r in statistics.compare_configurations(frame, "a", "b", ["g"]).collect()}
    for g, (a, b) in groups().items():
        r, d = got[g], a - b
        assert r["n_pairs"] == len(d) and r["status"] == ("success" if len(d) >= 3 else "insufficient_data")
        if len(d) < 3 or not d.any():
            assert (r["test_statistic"], r["p_value"], r["significant_05"]) == (None, None, False)
        else:
            statistic, p = inference.signed_rank_p(d, "wilcox")
            assert (r["test_statistic"], r["p_value"], r["median_diff"]) == pytest.approx((statistic, p, np.median(d)), abs=1e-12) and r["significant_05"] == (p < 0.05)


def test_comparator_equals_that_of_whole_groups(spark, frame):
    got = {r["g"]: r for r in statistics.comparator_tests(frame.filter("a < 1e300"), "a", "b", ["g"]).collect()}
    seen = set()
    for g, (a, b) in groups().items():
        r = got[g]
        if len(a) < 2:
            assert (r["paired_test_name"], r["paired_test_statistic"], r["normality_p_value"]) == ("not_computable", None, None)
            continue
        w, p = inference.shapiro(a - b)
        assert (r["normality_p_value"] is None) if math.isnan(p) else (r["normality_statistic"], r["normality_p_value"]) == pytest.approx((w, p), rel=1e-9)
        want = inference.comparator(a, b)
        seen.add(want["test"])
        assert r["paired_test_name"] == {"wilcoxon": "wilcoxon", "paired_t": "ttest_rel"}[want["test"]]
        if not math.isnan(want["statistic"]):
            assert (r["paired_test_statistic"], r["paired_test_p_value"]) == pytest.approx((want["statistic"], want["p_value"]), rel=1e-9)
    assert seen == {"wilcoxon", "paired_t"}


def test_normality_against_published_figures():
    # Weights of 11 men, the worked example of the approximation's papers.
    w, p = inference.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == (pytest.approx(0.79, abs=0.005), pytest.approx(0.0067, abs=0.0005))


def test_differences_are_counted_by_size(spark):
    values = [0.0, 0.0, -0.0, 1e-13, -5e-10, 2e-7, -0.005, 0.05, 3.0, -4.0]
    r = metrics.describe_delta(spark.createDataFrame([("x", v, 0.0) for v in values], SCHEMA), "a").first()
    assert (r["paired_n"], r["exact_equality_count"], r["nonzero_count"]) == (10, 3, 7)
    assert r["threshold_counts"] == {"0.0": 7, "1e-12": 6, "1e-09": 5, "1e-06": 4, "0.001": 4, "0.01": 3, "0.1": 2}
    assert [r[c] for c in ("mean", "median", "sd", "iqr", "p01", "p99", "min", "max", "max_abs")] == pytest.approx(
        [np.mean(values), np.median(values), np.std(values, ddof=1), np.subtract(*np.percentile(values, [75, 25])), *np.percentile(values, [1, 99]), -4, 3, 4]
    )
    none = metrics.describe_delta(spark.createDataFrame([], SCHEMA), "a").first()
    assert (none["paired_n"], none["threshold_counts"]["0.0"], none["median"], none["sd"]) == (0, 0, None, None)


def test_every_population_of_the_baseline_has_a_row(spark):
    rows = [("planned_405", 5.0 + k, 4.0 + k * 0.5, 1.0 + k * 0.5) for k in range(12)]
    got = {r["population"]: r for r in comparisons.baseline_summary(spark.createDataFrame(rows, "dataset_tier string, baseline_rmse_mm double, final_rmse_mm double, delta_rmse_mm double")).collect()}
    assert [got[p]["paired_n"] for p in comparisons.BASELINE_POPULATIONS] == [12, 0, 12]
    none = got["extended_only_population"]
    assert (none["threshold_counts"]["0.1"], none["mean_delta_mm"], none["paired_test_name"]) == (0, None, None)
    assert got["planned_population"]["paired_test_name"] == "ttest_rel" and got["planned_population"]["median_baseline_rmse_mm"] == 10.5
    empty = comparisons.baseline_summary(spark.createDataFrame([], "dataset_tier string, baseline_rmse_mm double, final_rmse_mm double, delta_rmse_mm double")).collect()
    assert {r["population"]: r["paired_test_name"] for r in empty} == {"planned_population": "not_computable", "extended_only_population": None, "combined_compatible_population": "not_computable"}
