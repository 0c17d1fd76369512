"""Operators against hand-computed values, golden facts and invariants."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions import columns, inference, signals
from gaugeline.operators import comparisons, metrics, quality, statistics, support
from gaugeline.sources import sinks
from gaugeline.streaming import streams


def test_golden_rmse(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 1.1, 0.0), (2, 2.0, 0.0, 2.1, 0.0)], "k long, a double, b double, c double, d double")
    assert df.agg(metrics.rmse_mm(F.col("a") - F.col("c"), F.col("b") - F.col("d"))).first()[0] == pytest.approx(81.64965809277268, abs=1e-9)


def test_golden_support_hash(spark):
    arms = {n: spark.createDataFrame([("t", k) for k in keys], "trial_id string, source_row_index long") for n, keys in (("a", (13, 10, 12, 11, 9)), ("b", (10, 11, 12, 13, 100)))}
    row = support.common_support(arms, ["source_row_index"], ["trial_id"]).first()
    assert row["common_support_count"] == 4 and row["common_support_hash"] == hashlib.sha256(b"10\n11\n12\n13").hexdigest() and row["support_status"] == "valid"
    arms["b"] = arms["b"].union(arms["b"])
    row = support.common_support(arms, ["source_row_index"], ["trial_id"]).first()
    assert row["support_status"] == "duplicate_key" and row["common_support_count"] == 0 and row["common_support_hash"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("kind", "value", "want"), [
    ("string", " 12 ", ("12", None)), ("string", "1e3", ("1000", None)), ("string", "1.50", (None, "non_integral")), ("string", "NaN", (None, "non_finite")), ("string", "", (None, "non_finite")), ("string", "abc", ("abc", None)),
    ("string", "99999999999999999999", (None, "unsafe_integer")), ("double", 3.0, ("3", None)), ("double", 3.5, (None, "non_integral")), ("double", float("nan"), (None, "non_finite")), ("double", 2.0**60, (None, "unsafe_integer")), ("bigint", None, (None, "non_finite")), ("bigint", 7, ("7", None)),
])
def test_canonical_keys(spark, kind, value, want):
    df = spark.createDataFrame([(value,)], f"k {kind}")
    assert tuple(support.with_token(df, ["k"]).select("support_key", "key_reason").first()) == want


def test_keys_sort_by_value(spark):
    df = spark.createDataFrame([(["10", "9", "b", "a", "-1"],)], "k array<string>")
    assert df.select(columns.sort_keys(F.col("k"))).first()[0] == ["-1", "9", "10", "a", "b"]


def test_arms_score_on_shared_rows(spark):
    make = lambda r: spark.createDataFrame([("t", k, "evaluation", x) for k, x in r], "trial_id string, source_row_index long, partition string, residual_norm double")
    arms = {"onset": make([(10, 2.0), (11, 2.0), (12, 2.0), (13, 2.0), (14, None)]), "refined": make([(10, 1.0), (11, 1.0), (12, 1.0), (13, 1.0), (15, 9.0)])}
    row = comparisons.paired(arms, "onset", "refined").first()
    assert (row["common_support_count"], row["onset_rmse_mm"], row["refined_rmse_mm"], row["delta_rmse_mm"], row["valid_for_paper"]) == (4, 2000.0, 1000.0, 1000.0, True)
    assert row["common_support_hash"] == hashlib.sha256(b"10\n11\n12\n13").hexdigest()


def test_partition_boundary(spark):
    df = spark.createDataFrame([("a", k, 100.0 + k) for k in range(11)] + [("b", 0, 0.0), ("b", 1, 4.0), ("c", 0, None)], "trial_id string, source_row_index long, t double")
    rows = {r["trial_id"]: r for r in quality.boundaries(df, Settings(), "t").collect()}
    assert (rows["a"]["t_total_s"], rows["a"]["t_cal_s"], rows["a"]["partition_status"]) == (10.0, 5.0, "success")
    assert rows["b"]["partition_status"] == "insufficient_evaluation_duration" and rows["c"]["partition_status"] == "missing_ev3_time"


# ------------------------------------------------------------------ kernels


@given(st.lists(st.integers(-50, 50), min_size=4, max_size=12, unique=True), st.lists(st.integers(-9, 9), min_size=2, max_size=2))
@hyp(max_examples=40, deadline=None)
def test_linear_functions_are_kept(knots, line):
    t = np.sort(np.array(knots, float))
    y = line[0] + line[1] * t
    q = np.linspace(t[0], t[-1], 17)
    for m in ("linear", "pchip", "spline"):
        assert np.allclose(signals.query(m, t, y, q), line[0] + line[1] * q)
    assert np.isnan(signals.query("spline", t, y, np.array([t[0] - 1, t[-1] + 1, np.nan]))).all()


def dense_moments(t, y):
    """Of the natural cubic spline, from the full matrix."""
    n = len(t)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        h0, h1 = t[i] - t[i - 1], t[i + 1] - t[i]
        a[i, i - 1 : i + 2] = h0, 2 * (h0 + h1), h1
        r[i] = 6 * ((y[i + 1] - y[i]) / h1 - (y[i] - y[i - 1]) / h0)
    return np.linalg.solve(a, r)


def test_splines_of_many_trials_side_by_side():
    rng = np.random.default_rng(8)
    sizes = [1, 2, 3, 4, 5, 9, 40, 3, 1, 257, 64]
    t = [np.cumsum(rng.uniform(0.1, 2, n)) for n in sizes]
    y = [rng.normal(size=n) for n in sizes]
    knots = signals.Knots(np.concatenate(t), np.stack([np.concatenate(y), -2 * np.concatenate(y)]), np.repeat(np.arange(3, 3 + len(sizes)), sizes))
    want = np.concatenate([dense_moments(a, b) for a, b in zip(t, y, strict=True)])
    assert np.allclose(knots.moments(), [want, -2 * want], atol=1e-9)
    for m in signals.METHODS:
        at = 0
        for k, (a, b) in enumerate(zip(t, y, strict=True)):
            q = np.concatenate([a, rng.uniform(a[0] - 1, a[-1] + 1, 20)])
            found = knots.at(m, at + np.searchsorted(a, q, "right") - 1, np.full(len(q), 3 + k), q)
            assert np.allclose(found[0], signals.query(m, a, b, q), equal_nan=True) and np.allclose(found[1], -2 * found[0], equal_nan=True)
            assert (found[0][: len(a)] == b).all() and np.isnan(found[0][(q < a[0]) | (q > a[-1])]).all()
            at += len(a)


def test_natural_spline_ends_and_smoothness():
    t, y = np.array([0.0, 1, 2.5, 3, 5]), np.array([1.0, -2, 0, 4, 1])
    m = signals.Knots(t, y[None, :], np.zeros(5, int)).moments()[0]
    assert m[0] == m[-1] == 0
    e = 1e-4
    slope = lambda x: np.diff(signals.query("spline", t, y, np.array([x - e, x + e])))[0] / (2 * e)
    for knot in t[1:-1]:
        assert slope(knot - 2 * e) == pytest.approx(slope(knot + 2 * e), abs=0.02)
        assert signals.query("spline", t, y, np.array([knot]))[0] == pytest.approx(y[list(t).index(knot)])


def test_monotone_cubic_stays_between_samples():
    t, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 0, 1, 1, 5, 6])
    q = signals.query("pchip", t, y, np.linspace(0, 5, 200))
    assert (np.diff(q) >= -1e-12).all() and q.min() >= 0 and q.max() <= 6


@given(st.floats(-3, 3), st.floats(-5, 5), st.floats(-5, 5))
@hyp(max_examples=40, deadline=None)
def test_rigid_fit_recovers_motion(theta, x, y):
    p = np.random.default_rng(1).normal(size=(20, 2))
    r = np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])
    found, shift = signals.rigid(p, p @ r.T + [x, y])
    assert math.isclose(math.cos(found - theta), 1, abs_tol=1e-9) and np.allclose(shift, [x, y])


def test_lag_and_clock_recovered():
    t = np.arange(0, 40, 0.05)
    x = np.sin(t) + np.sin(2.7 * t) + np.sin(0.31 * t)
    _, peak = signals.lag_correlation(signals.Signal(t, x), signals.Signal(t + 1.5, x), Settings())
    assert peak.status == "ok" and peak.lag == pytest.approx(1.5)
    fit = signals.clock_fit(signals.Signal(t, x), signals.Signal(1.02 * t + 0.3, x), 0.3, Settings())
    assert fit.model == "affine" and fit.a == pytest.approx(1.02, abs=1e-3) and fit.b == pytest.approx(0.3, abs=0.02)
    same = signals.clock_fit(signals.Signal(t, x), signals.Signal(t + 0.3, x), 0.3, Settings())
    assert same.model == "constant_offset" and same.a == 1.0


def test_lag_grids():
    assert len(signals.lag_grid(5.0, 0.05)) == 201 and np.allclose(signals.lag_grid(5.0, 0.05), np.linspace(-5, 5, 201))
    assert signals.lag_grid(0.12, 0.05).tolist() == pytest.approx([-0.12, -0.1, -0.05, 0, 0.05, 0.1, 0.12])
    assert signals.lag_grid(0.0, 0.05).tolist() == [0] and not len(signals.lag_grid(math.nan, 1)) and not len(signals.lag_grid(1, 0))


def test_correlations_against_one_lag_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    a = signals.Signal(np.cumsum(rng.uniform(0.02, 0.2, 200)), rng.normal(size=200).cumsum())
    b = signals.Signal(np.cumsum(rng.uniform(0.02, 0.2, 150)) + 1, rng.normal(size=150).cumsum())
    lags = signals.lag_grid(3.0, 0.25)
    want = []
    for lag in lags:
        low, high = max(a.t[0], b.t[0] - lag), min(a.t[-1], b.t[-1] - lag)
        q = low + 0.25 * np.arange(int((high - low) / 0.25) + 1)
        q = q[(q >= a.t[0]) & (q <= a.t[-1]) & (q + lag >= b.t[0]) & (q + lag <= b.t[-1])]  # rounding may leave an end out
        want.append(np.corrcoef(np.interp(q, *a), np.interp(q + lag, *b))[0, 1])
    for points in (1 << 20, 50):
        monkeypatch.setattr(signals, "POINTS", points)
        assert np.allclose(signals.correlations(a, b, lags, 0.25, 5.0).scores, want)
    assert np.isnan(signals.correlations(a, b, lags, 0.25, 1e6).scores).all()


def test_choice_of_lags():
    s = Settings()
    lags = np.arange(-5, 6.0)
    curve = lambda **high: signals.Curve(lags, np.array([high.get(f"m{-int(x)}" if x < 0 else f"p{int(x)}", 0.0) for x in lags]), lags * 0)
    assert signals.choose(curve(m2=0.9, p2=0.9), s)[:3] == (-2.0, 0.9, 0.9)
    assert signals.choose(curve(p1=0.9, m2=0.9, p4=0.3), s).lag == 1.0
    assert signals.choose(signals.Curve(lags, lags * math.nan, lags), s) == signals.Peak()
    assert signals.choose(curve(p5=0.9), s).status == "boundary_limit"
    assert signals.choose(curve(p1=s.min_correlation / 2), s).status == "low_correlation"
    assert signals.choose(curve(p1=0.9, m3=0.9 / s.min_peak_ratio + 0.01), s).status == "ambiguous"
    assert signals.choose(curve(p1=0.9), s).status == "ok"


def test_peaks_of_plateaus():
    assert signals.peaks(np.array([0, 1, 1, 0, 2, 1, 3, 3.0])).tolist() == [1, 4]


def test_onset_falls_back():
    assert signals.Signal(np.array([1.0, 2, 3]), np.array([0, 0.6, 1])).onset(0.5) == 2.0
    assert signals.Signal(np.array([1.0, 2]), np.array([0, 0.1])).onset(0.5) == 1.0
    assert math.isnan(signals.Signal(np.array([]), np.array([])).onset())


# ------------------------------------------------------------------ inference


def test_signed_rank_exact_values():
    r = inference.signed_rank([1.1, 2.2, 3.3, 4.4, 5.5])
    assert (r.w_plus, r.w_minus, r.p, r.status) == (15.0, 0.0, 0.0625, "ok") and r.pseudomedian == pytest.approx(3.3)
    assert inference.signed_rank([0.0, 0.0]).status == "all_zero_differences"
    assert inference.signed_rank([1.0]).status == "insufficient_pairs" and inference.signed_rank([math.nan]).status == "no_finite_pairs"
    assert inference.signed_rank([1, -2, 3, 0]).w_plus == pytest.approx(2 + 4 + 0.5)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_walsh_median_by_bisection(n):
    d = np.random.default_rng(n).normal(size=n).round(1)
    assert inference.walsh_median(d, direct=0) == pytest.approx(inference.walsh_median(d), abs=1e-9)


def test_tails():
    assert inference.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert inference.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    t, p = inference.paired_t(np.array([1.0, 2, 3, 4, 6]), np.array([0.0, 1, 1, 2, 2]))
    assert t == pytest.approx(3.6515, abs=1e-4) and p == pytest.approx(0.0217, abs=2e-4)


def test_friedman_against_the_textbook():
    blocks = np.array([[1.0, 2, 3], [1, 3, 2], [1, 2, 3], [2, 1, 3]])
    statistic, p, w = inference.friedman(blocks)
    assert statistic == pytest.approx(4.5) and p == pytest.approx(math.exp(-2.25)) and w == pytest.approx(4.5 / 8)


def test_shapiro_separates():
    rng = np.random.default_rng(3)
    assert inference.shapiro(rng.normal(size=60))[1] > 0.05 > inference.shapiro(rng.exponential(size=60) ** 2)[1]
    assert math.isnan(inference.shapiro([1.0, 1.0, 1.0])[0])
    assert inference.shapiro([1.0, 2.0, 3.0])[0] == pytest.approx(1.0)
    # Royston's example data: men's weights, W = 0.79.
    w, p = inference.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01


@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_holm_is_monotone_and_capped(p):
    a = inference.holm(p)
    order = np.argsort(p, kind="stable")
    assert (np.diff(a[order]) >= 0).all() and (a <= 1).all() and (a >= np.array(p) - 1e-15).all()


def test_decisions(spark):
    df = spark.createDataFrame([(1, 0.01), (5, None), (5, 0.01), (5, 0.2)], "n int, p double")
    assert [r[0] for r in df.select(statistics.decide(F.col("n"), F.col("p"))).collect()] == ["inconclusive", "inconclusive", "supported", "not_supported"]
    assert inference.decision(5, 0.01) == "supported" and inference.decision(1, 0.01) == "inconclusive"


# ------------------------------------------------------------------ sinks and streams


def test_schema_report_and_cells(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in sinks.schema_report(df).collect()] == [("a", "int", 2, 0), ("b", "string", 2, 1)]
    cells = sinks.cells(df, "fig", "src").collect()
    assert len(cells) == 4 and {r["value_type"] for r in cells} == {"integer", "null", "string"} and len({r["row_sha256"] for r in cells}) == 2


def test_strict_json_and_paths(spark):
    df = spark.createDataFrame([(float("nan"), 1, "/run/a/b")], "x double, y int, p string")
    assert df.select(columns.json_text(df, ["x", "y"])).first()[0] == '{"x":null,"y":1}'
    assert df.select(sinks.normalise_path(F.col("p"), "/run/a/")).first()[0] == "<RUN_ROOT>/b"


def test_clock_export_contract(spark):
    row = ("t", "affine", 1.0, 0.0, *[None] * 8)
    schema = ", ".join(f"{c} {'string' if c in ('trial_id', 'selected_model', 'reason') else 'double'}" for c in sinks.CLOCK_FIELDS)
    df = spark.createDataFrame([row], schema)
    assert sinks.clock_export(df).count() == 1
    with pytest.raises(ValueError):
        sinks.clock_export(df.union(df))
    with pytest.raises(ValueError):
        sinks.clock_export(df.drop("reason"))


def test_files_are_hashed_by_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"x,\xff\r\n")
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r["file"]: (r["bytes"], r["sha256"]) for r in sinks.file_hashes(spark, f"file://{tmp_path}").collect()}
    assert got == {"in/a.csv": (5, hashlib.sha256(b"x,\xff\r\n").hexdigest())}


def test_content_is_that_of_the_rows(spark):
    df = spark.createDataFrame([(k, None if k == 3 else f"v{k}", [k]) for k in range(20)], "a int, b string, c array<int>")
    one, other = sinks.content_hash(df).first(), sinks.content_hash(df.orderBy(F.desc("a")).repartition(5)).first()
    assert one == other and one["rows"] == 20
    for changed in (df.filter("a < 19"), df.union(df), df.withColumn("b", F.lit("v1")), df.withColumn("b", F.coalesce("b", F.lit("")))):
        assert sinks.content_hash(changed).first()["content"] != one["content"]


def test_gap_sessions_on_a_stream(spark, tmp_path):
    rows = [("a", f"2026-01-01 00:00:{s}") for s in ("00.0", "00.2", "00.4", "02.0", "02.1")] + [("a", "2026-01-01 00:05:00.0")]
    df = spark.createDataFrame(rows, "trial_id string, at string").select("trial_id", F.to_timestamp("at").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = streams.tracking_sessions(source).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["rows"] for r in spark.table("sessions").collect()) == [2, 3]


def _run_stream(spark, df, name, folder):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint-{name}").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_streams_are_paired_and_counted(spark, tmp_path):
    from gaugeline.streaming import streams

    schema = "trial_id string, ts timestamp, v double"
    rows = {"left": [("a", 0, 1.0), ("a", 10, 2.0), ("b", 0, 3.0), ("a", 500, 0.0)], "right": [("a", 0.5, 1.5), ("a", 11.5, 2.5), ("b", 30, 3.5), ("a", 500, 0.5)]}
    sources = {}
    for side, some in rows.items():
        frame = spark.createDataFrame([(k, 1e9 + t, v) for k, t, v in some], "trial_id string, t double, v double").select("trial_id", F.timestamp_seconds("t").alias("ts"), "v")
        frame.write.parquet(f"{tmp_path}/{side}")
        sources[side] = lambda side=side: spark.readStream.schema(schema).parquet(f"{tmp_path}/{side}")
    paired = _run_stream(spark, streams.paired_samples(sources["left"](), sources["right"]()), "paired", tmp_path)
    assert sorted((r["trial_id"], r["left"]["v"], r["right"]["v"]) for r in paired) == [("a", 0.0, 0.5), ("a", 1.0, 1.5)]
    # Windows behind the watermark are out; the last one is still open.
    rates = _run_stream(spark, streams.windowed_rates(sources["left"]()), "rates", tmp_path)
    assert sorted((r["trial_id"], r["start"].timestamp() - 1e9, r["rows"]) for r in rates) == [("a", 0.0, 1), ("a", 10.0, 1), ("b", 0.0, 1)]
