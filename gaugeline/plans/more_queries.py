"""Further registered queries: predicates, comparisons, cascade, design, presentation and export operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions import columns as C
from gaugeline.operators import alignment, asof, cleaning, comparisons, gates, keysets, metrics, quality, statistics
from gaugeline.plans import presentation
from gaugeline.plans.registry import _TESTED, _reference_sql, _signed_rank_sql, query
from gaugeline.plans.stand_ins import other, own, stream, table
from gaugeline.sources import sinks
from gaugeline.sources.kept import kept


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 1, 2) AS truth, c_custkey % 3 IN (0, 1) AS evaluation, c_custkey % 5 IN (0, 1) AS upstream FROM customer""", None)
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (k % n + 1).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", C.truthy(pick(4, " TRUE", "1", "yes ", "no")).alias("truth"), C.is_evaluation(pick(3, "Evaluation ", "held-out", "calibration")).alias("evaluation"),
        C.upstream_reason(pick(5, "missing_input", "Fit FAILED here", "ok", "ambiguous", None)).alias("upstream"),
    )


@query("""WITH $STREAMS SELECT trial_id, source_row_index, CASE WHEN value < 1 AND heading < 0.05 THEN 'stationary' WHEN value >= 1 AND heading >= 0.05 AND abs(heading - value) > 5 THEN 'turning' WHEN value >= 1 AND heading >= 0.05 THEN 'straight' ELSE 'uncertain' END AS phase FROM e""", None)
def aligned_phases(spark: SparkSession, d: str) -> DataFrame:
    e = own(spark, d)
    return e.select("trial_id", "source_row_index", C.aligned_phase(F.col("value"), F.col("heading"), F.col("heading") - F.col("value")).alias("phase"))


_ARMS = """WITH $STREAMS, a AS (SELECT trial_id, source_row_index, abs(value - 50) AS r FROM e WHERE value < 200), b AS (SELECT trial_id, source_row_index, abs(value - 60) AS r FROM e WHERE value > 5),
j AS (SELECT a.trial_id, a.source_row_index, a.r AS ra, b.r AS rb FROM a JOIN b USING (trial_id, source_row_index))"""


def _arms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e = own(spark, d).withColumn("partition", F.lit("evaluation"))
    return {"first": e.withColumn("residual_norm", F.when(F.col("value") < 200, F.abs(F.col("value") - 50))), "second": e.withColumn("residual_norm", F.when(F.col("value") > 5, F.abs(F.col("value") - 60)))}


@query(_ARMS + """ SELECT trial_id, count(*) AS common_support_count, sha256(string_agg(source_row_index::VARCHAR, chr(10) ORDER BY source_row_index)) AS common_support_hash, 'valid' AS support_status,
round(sqrt(avg(ra * ra)) * 1000, 4) AS first_rmse_mm, round(sqrt(avg(rb * rb)) * 1000, 4) AS second_rmse_mm, round(sqrt(avg(ra * ra)) * 1000 - sqrt(avg(rb * rb)) * 1000, 4) AS delta_rmse_mm, 'ok' AS fit_status, true AS valid_for_paper, NULL::VARCHAR AS reason FROM j GROUP BY trial_id""", 4)
def paired_arms(spark: SparkSession, d: str) -> DataFrame:
    return comparisons.paired(_arms(spark, d), "first", "second")


@query("""WITH m AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey)
SELECT count(*) AS n, round(avg(a - b), 4) AS mean_delta, round(median(a - b), 4) AS median_delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL""", 4)
def configuration_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two configurations' values on the trials that have both, as differences."""
    pairs = statistics.paired_values(table(spark, d, "orders"), "o_orderstatus", ("F", "O"), "o_totalprice", "o_custkey")
    return metrics.describe_delta(pairs.withColumn("delta", F.col("a") - F.col("b")), "delta").select(F.col("paired_n").alias("n"), F.col("mean").alias("mean_delta"), F.col("median").alias("median_delta"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND count(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag END) = 2 AND bool_and(l_quantity > 5)", None)
def both_modes_eligible(spark: SparkSession, d: str) -> DataFrame:
    return gates.having_all(table(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 5), "l_orderkey", "l_returnflag", ("A", "R"), "ok")


_CASCADE = """WITH k AS (SELECT c_custkey AS trial_id, CASE WHEN c_custkey % 7 <> 6 THEN CASE c_custkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'maybe' ELSE 'passed' END END AS gate, c_acctbal AS rmse,
  CASE WHEN c_custkey % 5 <> 0 THEN 'h' END AS h, CASE WHEN c_custkey % 5 = 1 THEN 'g' ELSE 'h' END AS x, CASE WHEN c_custkey % 5 = 2 THEN 'empty' ELSE 'valid' END AS support, CASE WHEN c_custkey % 11 = 0 THEN 'no_common_samples' ELSE 'success' END AS status FROM customer),
w AS (SELECT *, CASE WHEN gate IS NULL THEN 'missing_trial_gate_record' WHEN gate = 'failed' THEN 'final_gate_failed' WHEN gate <> 'passed' THEN 'gate_status_unrecognized' WHEN h IS NULL THEN 'support_hash_unavailable' WHEN support <> 'valid' THEN 'support_validation_failed'
  WHEN h <> x THEN 'support_hash_mismatch' WHEN status <> 'success' THEN status END AS why FROM k),
c AS (SELECT trial_id, 'planned_405' AS dataset_tier, stage, CASE WHEN stage = 'S4' AND why IS NULL THEN rmse END AS score_mm, stage = 'S4' AND why IS NULL AS valid, CASE WHEN stage <> 'S4' THEN 'stage_not_persisted' ELSE why END AS reason FROM w, (SELECT unnest(['S0', 'S1', 'S2', 'S3', 'S4']) AS stage))"""


@query(_CASCADE + " SELECT * FROM c", None)
def cascade_rows(spark: SparkSession, d: str) -> DataFrame:
    """Gates, hashes and statuses of all kinds: every reason has rows."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    gate = F.when(k % 7 == 6, "paired").otherwise("final_alignment_valid")
    ledger = c.select(k.alias("trial_id"), F.lit("planned_405").alias("dataset_tier"), gate.alias("gate"), F.when(k % 7 == 0, "failed").when(k % 7 == 1, "maybe").otherwise("passed").alias("gate_status"))
    scores = c.select(k.alias("trial_id"), F.col("c_acctbal").alias("rmse_mm"), F.when(k % 11 == 0, "no_common_samples").otherwise("success").alias("status"))
    known = c.select(k.alias("trial_id"), F.when(k % 5 != 0, "h").alias("support_hash"), F.when(k % 5 == 1, "g").otherwise("h").alias("expected_hash"), F.when(k % 5 == 2, "empty").otherwise("valid").alias("support_status"))
    return gates.cascade(ledger, scores, known)


@query("""WITH c AS (SELECT 'S' || (o_orderkey % 4 + (CASE WHEN o_orderkey % 4 > 2 THEN 1 ELSE 0 END)) AS stage, o_custkey, o_totalprice AS s FROM orders), g AS (SELECT stage, avg(s) AS m, median(s) AS d, count(DISTINCT o_custkey) AS n FROM c GROUP BY stage)
SELECT stage, round(m, 4) AS mean_mm, round(d, 4) AS median_mm, n AS n_trials, round(CASE WHEN substr(stage, 2)::INT = substr(lag(stage) OVER w, 2)::INT + 1 THEN lag(m) OVER w - m END, 4) AS reduction_mm FROM g WINDOW w AS (ORDER BY stage)""", 4)
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select(F.concat(F.lit("S"), k + F.when(k > 2, 1).otherwise(0)).alias("stage"), F.col("o_custkey").alias("trial_id"), F.col("o_totalprice").alias("score_mm"), F.lit(True).alias("valid"))
    return gates.stage_summary(rows)


@query("""WITH f AS (SELECT 'D' || (c_custkey % 9 + 1) AS drive_id, 'T' || (c_nationkey % 9 + 1) AS route_id, c_acctbal > 0 AS ok FROM customer), n AS (SELECT 'D' || a AS drive_id, 'T' || b AS route_id, 5 AS k FROM range(1, 10) x(a), range(1, 10) y(b)), g AS (SELECT drive_id, route_id, count(*) AS found, count(*) FILTER (WHERE ok) AS good FROM f GROUP BY ALL)
SELECT n.drive_id, n.route_id, k::BIGINT AS nominal, coalesce(found, 0) AS discovered, coalesce(good, 0) AS accepted, coalesce(good, 0) >= 5 AS complete FROM n LEFT JOIN g USING (drive_id, route_id)""", None)
def design_balance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    found = c.select(F.concat(F.lit("D"), F.col("c_custkey") % 9 + 1).alias("drive_id"), F.concat(F.lit("T"), F.col("c_nationkey") % 9 + 1).alias("route_id"), "c_acctbal")
    return gates.balance(gates.design_grid(spark), found, found.filter("c_acctbal > 0"))


@query("""SELECT u.column, u.dtype, count(*) AS row_count, count(*) FILTER (WHERE u.v IS NULL) AS null_count FROM (SELECT unnest([{'column': 'event_id', 'dtype': 'bigint', 'v': event_id::VARCHAR}, {'column': 'value', 'dtype': 'double', 'v': CASE WHEN event_type <> 'error' THEN value::VARCHAR END}]) AS u FROM events) GROUP BY ALL""", None)
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.schema_report(table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")))


@query("""SELECT 'nations' AS figure_id, 'nation' AS source, u.* FROM (SELECT unnest([{'column_name': 'n_nationkey', 'column_index': 0, 'value_text': n_nationkey::VARCHAR, 'value_type': 'integer'}, {'column_name': 'n_name', 'column_index': 1, 'value_text': n_name, 'value_type': 'string'}]) AS u FROM nation)""", None)
def figure_cells(spark: SparkSession, d: str) -> DataFrame:
    return sinks.cells(table(spark, d, "nation").select("n_nationkey", "n_name"), "nations", "nation").drop("row_sha256")


@query("""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderstatus, least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM orders, m GROUP BY ALL""", None)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return presentation.histogram(table(spark, d, "orders"), "o_totalprice", 20, ["o_orderstatus"]).drop("low")


@query("SELECT c_custkey AS trial_id FROM customer, (SELECT median(c_acctbal) AS m FROM customer) WHERE c_acctbal IS NOT NULL ORDER BY abs(c_acctbal - m), c_custkey LIMIT 1", None)
def closest_to_median(spark: SparkSession, d: str) -> DataFrame:
    return presentation.closest_to_median(table(spark, d, "customer").withColumnRenamed("c_custkey", "trial_id"), "c_acctbal").select("trial_id")


@query("""WITH p AS (SELECT o_orderpriority AS hypothesis_id, 'all' AS population, o_totalprice FROM orders UNION ALL SELECT o_orderpriority, 'planned', o_totalprice FROM orders WHERE o_orderkey % 40 = 0),
s AS (SELECT hypothesis_id, population, count(*) AS n, CASE WHEN avg(o_totalprice) > 150000 THEN 'supported' ELSE 'not_supported' END AS decision FROM p GROUP BY ALL)
SELECT hypothesis_id, max(n) FILTER (WHERE population = 'planned') AS planned_n, max(decision) FILTER (WHERE population = 'planned') AS planned_decision, max(n) FILTER (WHERE population = 'all') AS all_n, max(decision) FILTER (WHERE population = 'all') AS all_decision,
max(decision) FILTER (WHERE population = 'planned') = max(decision) FILTER (WHERE population = 'all') AS stable FROM s GROUP BY hypothesis_id""", None)
def stability_of_conclusions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("tier", F.when(F.col("o_orderkey") % 40 == 0, "planned").otherwise("more"))
    rows = metrics.populations(o, "tier", {"planned": ["planned"], "all": ["planned", "more"]})
    decision = F.when(F.avg("o_totalprice") > 150000, "supported").otherwise("not_supported")
    return comparisons.conclusion_stability(rows.groupBy(F.col("o_orderpriority").alias("hypothesis_id"), "population").agg(F.count("*").alias("n"), decision.alias("decision")))


@query("""WITH $STREAMS, r AS (SELECT trial_id, count(*) AS n FROM s GROUP BY trial_id) SELECT e.trial_id, e.source_row_index, CASE WHEN n > 66 THEN 'long' ELSE 'short' END AS tier FROM e LEFT JOIN r USING (trial_id)""", None)
def tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    tiers = stream(spark, d).groupBy("trial_id").agg(F.when(F.count("*") > 66, "long").otherwise("short").alias("tier"))
    return gates.looked_up(own(spark, d), tiers, "tier").select("trial_id", "source_row_index", "tier")


@query("""WITH $STREAMS, k AS (SELECT trial_id, source_row_index, row_number() OVER (PARTITION BY trial_id ORDER BY t, source_row_index) AS n FROM e) SELECT trial_id, source_row_index FROM k WHERE n % 10 = 1""", None)
def every_tenth_row(spark: SparkSession, d: str) -> DataFrame:
    """The thinned series of a plot: here the sample is the feature."""
    return presentation.thinned(own(spark, d)).select("trial_id", "source_row_index")


@query("""WITH $STREAMS, a AS (SELECT trial_id, t, arg_min(value, source_row_index) AS value FROM v GROUP BY ALL), j AS (SELECT e.trial_id, e.value AS y, a0.value AS v0, e.heading AS h FROM e ASOF JOIN a a0 ON e.trial_id = a0.trial_id AND e.t >= a0.t JOIN (SELECT trial_id, max(t) AS hi FROM a GROUP BY 1) m ON m.trial_id = e.trial_id AND e.t <= m.hi)
SELECT trial_id, count(*) AS n, round(atan2(covar_pop(v0, h) - covar_pop(v0 / 2, y), covar_pop(v0, y) + covar_pop(v0 / 2, h)), 6) AS theta_rad FROM j GROUP BY trial_id HAVING count(*) >= 3""")
def matched_rigid_fit(spark: SparkSession, d: str) -> DataFrame:
    """As-of matched samples, then the closed-form rigid fit: two shuffles on the same key, the second reused from the first."""
    samples = other(spark, d).groupBy("trial_id", "t").agg(F.min_by("value", "source_row_index").alias("value"))
    m = asof.zero_order_hold(own(spark, d), samples, ["value"]).filter("valid").withColumn("half", F.col("ref_value") / 2)
    return alignment.rigid_fit(m, ("ref_value", "half"), ("value", "heading")).select("trial_id", "n", "theta_rad")


@query("""SELECT n_nationkey, n < 2 OR p IS NULL AS open, CASE WHEN n < 2 OR p IS NULL THEN 'inconclusive' WHEN p < 0.05 THEN 'supported' ELSE 'not_supported' END AS decision FROM (SELECT n_nationkey, n_nationkey % 7 AS n, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey / 200.0 END AS p FROM nation)""", None)
def decision_rule(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n, p = k % 7, F.when(k % 5 != 0, k / 200.0)
    return table(spark, d, "nation").select("n_nationkey", ((n < 2) | p.isNull()).alias("open"), statistics.decide(n, p).alias("decision"))


@query("WITH RECURSIVE $STREAMS, k AS (SELECT trial_id, (t - min(t0) OVER (PARTITION BY trial_id)) / 86400 AS t, value, heading FROM (SELECT *, first_value(t) OVER (PARTITION BY trial_id ORDER BY source_row_index) AS t0, row_number() OVER (PARTITION BY trial_id, t ORDER BY source_row_index) AS one FROM v) WHERE one = 1), q AS (SELECT trial_id, source_row_index, (t - first_value(t) OVER (PARTITION BY trial_id ORDER BY source_row_index)) / 86400 AS t FROM e), "
       + _reference_sql(["value", "heading"]) + """, c AS (SELECT r.trial_id, r.source_row_index, method, sqrt(power(e.value - ref_value, 2) + power(e.heading + ref_heading, 2)) AS r FROM ref r JOIN e ON e.source_row_index = r.source_row_index WHERE r.valid),
o AS (SELECT trial_id, method, round(sqrt(avg(r * r)) * 1000, 1) AS rmse_mm, count(*) AS common_support_count, sha256(string_agg(source_row_index::VARCHAR, chr(10) ORDER BY source_row_index)) AS common_support_hash FROM c GROUP BY ALL)
SELECT d.trial_id, m.method, rmse_mm, common_support_count, common_support_hash, CASE WHEN rmse_mm IS NULL THEN 'no_common_support' ELSE 'success' END AS status FROM (SELECT DISTINCT trial_id FROM e) d CROSS JOIN (SELECT unnest(['zoh', 'linear', 'pchip', 'spline']) AS method) m LEFT JOIN o ON o.trial_id = d.trial_id AND o.method = m.method""", 1)
def held_out_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The four reference operators on held-out rows of the stand-in streams, with an identity motion."""
    day = lambda df: cleaning.elapsed(df, "t", "rel").withColumn("rel", F.col("rel") / 86400)
    e = day(own(spark, d)).withColumnsRenamed({"rel": "local_time_s", "value": "odometry_x", "heading": "odometry_y"}).withColumn("partition", F.lit("evaluation")).drop("t")
    v = day(other(spark, d)).withColumnsRenamed({"rel": "relative_time_s", "value": "planar_x", "heading": "planar_y"}).drop("t")
    zero = F.lit(0.0)
    params = e.select("trial_id").distinct().select("trial_id", F.lit(1.0).alias("scale_a"), zero.alias("offset_b"), zero.alias("theta_rad"), zero.alias("tx"), zero.alias("ty"))
    return comparisons.h2(e, v, params, Settings())


_FAMILY = """, f AS (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST) AS k, count(p_value) OVER () AS m FROM test), h AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1, max(p_value * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) END AS p_adjusted FROM f)"""


@query("WITH RECURSIVE $STREAMS, m AS (SELECT trial_id, event_type, avg(value) - avg(heading) / 2 AS d FROM s GROUP BY ALL), " + _signed_rank_sql("m", "event_type") + _FAMILY + f" SELECT event_type, {_TESTED}, round(p_adjusted, 6) AS p_adjusted, CASE WHEN n < 2 OR p_adjusted IS NULL THEN 'inconclusive' WHEN p_adjusted < 0.05 THEN 'supported' ELSE 'not_supported' END AS decision FROM h")
def rank_test_family(spark: SparkSession, d: str) -> DataFrame:
    """A signed-rank test for each event type over trials' mean values, with Holm adjustment and decisions."""
    means = stream(spark, d).groupBy("trial_id", "event_type").agg(F.avg("value").alias("a"), (F.avg("heading") / 2).alias("b"))
    tests = statistics.signed_rank_tests(means, "a", "b", ["event_type"])
    return statistics.holm(tests).withColumn("decision", statistics.decide(F.col("n"), F.col("p_adjusted")))


@query("""WITH $STREAMS SELECT event_type, count(value) AS value_n, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(median(value), 6) AS value_median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value_iqr, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS value_ci95 FROM s GROUP BY event_type""")
def summary_by_phase(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d).groupBy("event_type").agg(*metrics.summary(["value"]))


_SCENARIOS = """k AS (SELECT c_custkey AS trial_id, c_nationkey::VARCHAR AS scenario_id, (c_acctbal + 1000) / 100 AS rmse_mm, c_acctbal / 50 AS ate_mm, (c_custkey % 10)::DOUBLE AS rpe_mm, (c_custkey % 3)::DOUBLE AS offset_s, (c_custkey % 4) / 10 AS theta_rad, (c_custkey % 6) / 100 AS tx, (c_custkey % 8) / 100 AS ty,
  1 + (c_custkey % 5) / 10 AS peak_ratio, (c_custkey % 7) / 10 AS irregularity, CASE WHEN c_custkey % 3 = 0 THEN 'ambiguous' ELSE 'ok' END AS temporal_status, (c_custkey % 11)::DOUBLE AS fit_rmse_mm FROM customer)"""


def _scenario_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("trial_id"), F.col("c_nationkey").cast("string").alias("scenario_id"), ((F.col("c_acctbal") + 1000) / 100).alias("rmse_mm"), (F.col("c_acctbal") / 50).alias("ate_mm"), (k % 10).cast("double").alias("rpe_mm"), (k % 3).cast("double").alias("offset_s"),
        (k % 4 / 10).alias("theta_rad"), (k % 6 / 100).alias("tx"), (k % 8 / 100).alias("ty"), (1 + k % 5 / 10).alias("peak_ratio"), (k % 7 / 10).alias("irregularity"), F.when(k % 3 == 0, "ambiguous").otherwise("ok").alias("temporal_status"), (k % 11).cast("double").alias("fit_rmse_mm"),
    )


@query("WITH " + _SCENARIOS + """ SELECT scenario_id, count(*) AS repetitions, round(avg(rmse_mm), 6) AS mean_rmse_mm, round(median(rmse_mm), 6) AS median_rmse_mm, round(quantile_cont(rmse_mm, 0.95), 6) AS p95_rmse_mm, round(avg(ate_mm), 6) AS mean_ate_mm, round(avg(rpe_mm), 6) AS mean_rpe_mm, round(avg(irregularity), 6) AS mean_irregularity,
round(avg(peak_ratio), 6) AS mean_peak_ratio, round(avg((temporal_status <> 'ok')::INT), 6) AS temporal_ambiguity_rate, CASE WHEN avg(rmse_mm) < 50 THEN 'robust' ELSE 'brittle' END AS status, round(avg(rmse_mm) / 100, 6) AS difficulty_score, CASE WHEN avg(rmse_mm) > 50 THEN 'hard' ELSE 'easy' END AS difficulty,
row_number() OVER (ORDER BY avg(rmse_mm), scenario_id)::INT AS place FROM k GROUP BY scenario_id""")
def scenario_robustness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scenario_robustness(_scenario_rows(spark, d))


@query("WITH " + _SCENARIOS + """, p AS (SELECT *, degrees(theta_rad) AS rotation_deg, sqrt(tx * tx + ty * ty) * 1000 AS translation_mm FROM k) SELECT scenario_id, count(*) AS repetitions, round(avg(rmse_mm), 5) AS mean_rmse_mm, round(stddev_samp(rmse_mm), 5) AS std_rmse_mm, round(median(rmse_mm), 5) AS median_rmse_mm,
round(quantile_cont(rmse_mm, 0.75) - quantile_cont(rmse_mm, 0.25), 5) AS iqr_rmse_mm, round(avg(ate_mm), 5) AS mean_ate_mm, round(stddev_samp(ate_mm), 5) AS std_ate_mm, round(avg(rpe_mm), 5) AS mean_rpe_mm, round(stddev_samp(rpe_mm), 5) AS std_rpe_mm, round(avg(offset_s), 5) AS mean_offset_s,
round(CASE WHEN count(*) > 1 THEN stddev_samp(offset_s) ELSE 0 END, 5) AS std_offset_s, round(avg(rotation_deg), 5) AS mean_rotation_deg, round(CASE WHEN count(*) > 1 THEN stddev_samp(rotation_deg) ELSE 0 END, 5) AS std_rotation_deg, round(avg(translation_mm), 5) AS mean_translation_mm,
round(CASE WHEN count(*) > 1 THEN stddev_samp(translation_mm) ELSE 0 END, 5) AS std_translation_mm, 5 - count(*) AS missing_repetitions, round(CASE WHEN avg(rmse_mm) > 0 THEN stddev_samp(rmse_mm) / avg(rmse_mm) ELSE 0 END, 5) AS cv_rmse, CASE WHEN stddev_samp(rmse_mm) < 50 THEN 'acceptable' ELSE 'high_variance' END AS status
FROM p GROUP BY scenario_id""", 5)
def scenario_repeatability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scenario_repeatability(_scenario_rows(spark, d))


@query("WITH " + _SCENARIOS + " SELECT scenario_id, trial_id, offset_s, round(degrees(theta_rad), 6) AS rotation_deg, round(tx, 6) AS tx, round(ty, 6) AS ty, round(sqrt(tx * tx + ty * ty) * 1000, 6) AS translation_mm, fit_rmse_mm, round(rmse_mm, 6) AS rmse_mm, round(ate_mm, 6) AS ate_mm, rpe_mm, 'stable' AS status FROM k")
def parameter_stability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.parameter_stability(_scenario_rows(spark, d))


@query("""WITH v AS (SELECT l_orderkey AS b, CASE l_linenumber WHEN 1 THEN 'zoh' WHEN 2 THEN 'linear' WHEN 3 THEN 'pchip' ELSE 'spline' END AS m, floor(l_quantity / 10) AS x FROM lineitem WHERE l_linenumber <= 4),
w AS (SELECT b FROM v GROUP BY b HAVING count(*) = 4 AND count(DISTINCT m) = 4), q AS (SELECT v.*, unnest(CASE WHEN b % 3 = 0 THEN ['planned', 'all'] ELSE ['all'] END) AS population FROM v JOIN w USING (b)),
r AS (SELECT *, rank() OVER (PARTITION BY population, b ORDER BY x) + (count(*) OVER (PARTITION BY population, b, x) - 1) / 2.0 AS r FROM q),
t AS (SELECT population, sum(c * c * c - c) AS ties FROM (SELECT population, b, x, count(*) AS c FROM r GROUP BY ALL) GROUP BY population), s AS (SELECT population, sum(z * z) AS q, max(n) AS n FROM (SELECT population, m, sum(r) AS z, count(*) AS n FROM r GROUP BY ALL) GROUP BY population),
f AS (SELECT population, n, (12 / (n * 20.0) * q - 15.0 * n) / (1 - ties / (n * 60.0)) AS statistic FROM s JOIN t USING (population))
SELECT population, n, round(statistic, 6) AS statistic, round(statistic / (n * 3), 6) AS kendall_w, 'ok' AS status FROM f""")
def friedman_by_population(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping populations of complete blocks; p-values are tested on their own."""
    k = F.col("l_linenumber")
    v = table(spark, d, "lineitem").filter(k <= 4).select(F.col("l_orderkey").alias("trial_id"), F.when(k == 1, "zoh").when(k == 2, "linear").when(k == 3, "pchip").otherwise("spline").alias("method"), F.floor(F.col("l_quantity") / 10).cast("double").alias("value"))
    rows = v.withColumn("population", F.explode(F.when(F.col("trial_id") % 3 == 0, F.array(F.lit("planned"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    return statistics.friedman_tests(rows, ("zoh", "linear", "pchip", "spline"), ["population"]).drop("p_value")


@query("""WITH $STREAMS, u AS (SELECT trial_id, t, arg_min(value, source_row_index) AS vx, arg_min(heading, source_row_index) AS vy FROM v GROUP BY ALL), q AS (SELECT *, 1.0001 * t - 150000 AS m FROM e),
a AS (SELECT q.*, u.t AS t0, u.vx AS x0, u.vy AS y0 FROM q ASOF JOIN u ON q.trial_id = u.trial_id AND q.m >= u.t), b AS (SELECT a.*, u.t AS t1, u.vx AS x1, u.vy AS y1 FROM a ASOF JOIN u ON a.trial_id = u.trial_id AND a.m <= u.t),
p AS (SELECT trial_id, source_row_index, t, value AS ex, heading AS ey, CASE WHEN t1 > t0 THEN x0 + (x1 - x0) * (m - t0) / (t1 - t0) ELSE x0 END AS vx, CASE WHEN t1 > t0 THEN y0 + (y1 - y0) * (m - t0) / (t1 - t0) ELSE y0 END AS vy FROM b),
d AS (SELECT *, coalesce(sqrt(power(ex - lag(ex) OVER w, 2) + power(ey - lag(ey) OVER w, 2)), 0) AS de, coalesce(sqrt(power(vx - lag(vx) OVER w, 2) + power(vy - lag(vy) OVER w, 2)), 0) AS dv, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY trial_id ORDER BY t, source_row_index)),
c AS (SELECT *, sum(de) OVER w AS se, sum(dv) OVER w AS sv FROM d WINDOW w AS (PARTITION BY trial_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
g AS (SELECT trial_id, count(*) AS n, coalesce(min(k) FILTER (WHERE se >= 2000), max(k)) AS ke, coalesce(min(k) FILTER (WHERE sv >= 2000), max(k)) AS kv FROM c GROUP BY trial_id),
z AS (SELECT g.trial_id, n, ke > 1 AND kv > 1 AS good, o.ex AS ex0, o.ey AS ey0, o.vx AS vx0, o.vy AS vy0, i.ex - o.ex AS ax, i.ey - o.ey AS ay, j.vx - o.vx AS bx, j.vy - o.vy AS bz FROM g JOIN c o ON o.trial_id = g.trial_id AND o.k = 1 JOIN c i ON i.trial_id = g.trial_id AND i.k = ke JOIN c j ON j.trial_id = g.trial_id AND j.k = kv),
h AS (SELECT *, CASE WHEN good THEN atan2(ay, ax) - atan2(bz, bx) ELSE 0 END AS theta FROM z)
SELECT r.trial_id, coalesce(n, 0) AS n, round(coalesce(theta, 0), 5) AS theta_rad, round(CASE WHEN good THEN sqrt(power(cos(theta) * bx - sin(theta) * bz - ax, 2) + power(sin(theta) * bx + cos(theta) * bz - ay, 2)) END, 5) AS start_residual,
round(ex0, 5) AS ex0, round(ey0, 5) AS ey0, round(vx0, 5) AS vx0, round(vy0, 5) AS vy0 FROM (SELECT DISTINCT trial_id FROM e) r LEFT JOIN h USING (trial_id)""", 5)
def heading_fit(spark: SparkSession, d: str) -> DataFrame:
    """Directions of both streams' paths over their first 2000 units, on a clock of scale 1.0001; some paths are shorter."""
    e = own(spark, d)
    times = e.select("trial_id").distinct().select("trial_id", F.lit(1.0001).alias("scale_a"), F.lit(-150000.0).alias("offset_b"))
    return alignment.heading_fit(e, other(spark, d), times, Settings(heading_distance_m=2000.0), ("value", "heading"), ("value", "heading"), "t", "t")


@query("""WITH k AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'planned_405' WHEN 1 THEN 'extended_previous_paper' ELSE 'unknown' END AS tier, o_totalprice / 1000 AS b, o_totalprice / 1000 - (o_custkey % 11 - 3) / 50 AS f FROM orders),
p AS (SELECT 'planned_population' AS population, * FROM k WHERE tier = 'planned_405' UNION ALL SELECT 'extended_only_population', * FROM k WHERE tier = 'extended_previous_paper' UNION ALL SELECT 'combined_compatible_population', * FROM k WHERE tier <> 'unknown')
SELECT population, count(*) AS paired_n, count(*) FILTER (WHERE abs(b - f) > 0.1) AS over_tenth, round(avg(b - f), 6) AS mean_delta_mm, round(median(b - f), 6) AS median_delta_mm, round(stddev_samp(b - f), 6) AS sd_delta_mm, round(quantile_cont(b - f, 0.95), 6) AS p95_delta_mm, round(max(abs(b - f)), 6) AS max_abs_delta_mm,
round(avg(b), 6) AS mean_baseline_rmse_mm, round(median(b), 6) AS median_baseline_rmse_mm, round(avg(f), 6) AS mean_final_rmse_mm, round(median(f), 6) AS median_final_rmse_mm, CASE WHEN population = 'extended_only_population' THEN NULL ELSE 'shapiro' END AS normality_test_name FROM p GROUP BY population""")
def baseline_summary(spark: SparkSession, d: str) -> DataFrame:
    """The populations' summary of two arms; the tests' figures are tested on their own."""
    k = F.col("o_orderkey") % 4
    arms = table(spark, d, "orders").select(F.when(k == 0, "planned_405").when(k == 1, "extended_previous_paper").otherwise("unknown").alias("dataset_tier"), (F.col("o_totalprice") / 1000).alias("baseline_rmse_mm"), (F.col("o_totalprice") / 1000 - (F.col("o_custkey") % 11 - 3) / 50).alias("final_rmse_mm"))
    out = comparisons.baseline_summary(arms.withColumn("delta_rmse_mm", F.col("baseline_rmse_mm") - F.col("final_rmse_mm"))).withColumn("over_tenth", F.element_at("threshold_counts", F.lit("0.1")))
    return out.select("population", "paired_n", "over_tenth", *[f"{c}_delta_mm" for c in ("mean", "median", "sd", "p95", "max_abs")], *[f"{c}_{a}_rmse_mm" for a in ("baseline", "final") for c in ("mean", "median")], "normality_test_name")


@query("""WITH $STREAMS, d AS (SELECT trial_id, t, t - lag(t) OVER (PARTITION BY trial_id ORDER BY t) AS dt FROM e), g AS (SELECT trial_id, count(*) AS n, min(t) AS a, max(t) AS b, avg(dt) AS m, median(dt) AS h, stddev_pop(dt) AS s FROM d GROUP BY trial_id HAVING count(*) > 1)
SELECT c_custkey AS trial_id, coalesce(n, 0) AS num_query_times, round(a, 4) AS query_start_s, round(b, 4) AS query_end_s, round(m, 4) AS mean_query_dt_s, round(h, 4) AS median_query_dt_s, round(s, 4) AS std_query_dt_s, CASE WHEN n IS NULL THEN 'failed_metric_computation' ELSE 'success' END AS query_status, 'ct_query' AS strategy_id, 'ev3' AS query_time_source
FROM customer LEFT JOIN g ON g.trial_id = c_custkey""", 4)
def query_time_report(spark: SparkSession, d: str) -> DataFrame:
    """Times at which trials ask; customers without events have none."""
    return asof.query_time_report(own(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("trial_id")), "t")


@query("""WITH $STREAMS, g AS (SELECT e.source_row_index, e.trial_id, min(abs(e.t - v.t)) * 1000 AS ms FROM e JOIN v ON e.trial_id = v.trial_id GROUP BY ALL), n AS (SELECT trial_id, count(*) AS num_vive_samples FROM v GROUP BY trial_id)
SELECT trial_id, count(*) AS num_ev3_samples, any_value(num_vive_samples) AS num_vive_samples, round(avg(ms), 2) AS mean_nearest_timestamp_gap_ms, round(median(ms), 2) AS median_nearest_timestamp_gap_ms, round(quantile_cont(ms, 0.95), 2) AS p95_nearest_timestamp_gap_ms, round(max(ms), 2) AS max_nearest_timestamp_gap_ms, 'acceptable' AS asynchrony_status FROM g JOIN n USING (trial_id) GROUP BY trial_id""", 2)
def timestamp_gap_report(spark: SparkSession, d: str) -> DataFrame:
    return asof.gap_report(own(spark, d), other(spark, d), "t", "t")


@query("""SELECT round(avg(l_discount) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_delta_rmse, count(*) FILTER (WHERE l_returnflag = 'R') AS accepted_for_h1, count(*) FILTER (WHERE l_linestatus = 'O') AS excluded_ambiguous_count FROM lineitem""")
def h1_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("valid_for_paper"), F.col("l_discount").alias("delta_rmse_mm"), F.when(F.col("l_linestatus") == "O", "ambiguous").otherwise("ok").alias("fit_status"))
    return comparisons.h1_summary(rows)


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) > 10 AS much FROM lineitem GROUP BY ALL),
g AS (SELECT k, bool_or(n = 1) AS one, bool_or(n = 2) AS two, count(*) FILTER (WHERE n <= 2) AS n_calibration, count(*) FILTER (WHERE n > 2) AS e, count(*) FILTER (WHERE n > 2 AND much) AS m, count(*) AS full_count,
  sha256('[' || string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (WHERE n <= 2) || ']') AS split_hash, sha256('[' || string_agg(n::VARCHAR, ',' ORDER BY n) || ']') AS full_hash,
  concat_ws(',', string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (WHERE n > 2 AND much), CASE WHEN k % 13 = 0 AND bool_or(n = 1) THEN '99' END) AS may FROM l GROUP BY k),
h AS (SELECT *, e + (k % 17 = 0 AND one)::INT AS n_evaluation, m + (k % 13 = 0 AND one)::INT AS eligible_count FROM g)
SELECT k AS trial_id, n_calibration, n_evaluation, eligible_count, n_calibration AS split_count, full_count, true AS split_excludes, m > 0 AS full_includes, split_hash, full_hash, CASE WHEN may <> '' THEN sha256('[' || may || ']') END AS eligible_hash,
CASE WHEN n_calibration = 0 OR n_evaluation = 0 OR eligible_count = 0 THEN 'missing_persisted_h3_keys_or_partition_hash' WHEN k % 17 = 0 AND one THEN 'persisted_calibration_evaluation_overlap' WHEN k % 23 = 0 AND one THEN 'persisted_vive_calibration_evaluation_overlap'
  WHEN k % 19 = 0 THEN 'partition_hash_mismatch' WHEN k % 13 = 0 AND one THEN 'invalid_eligible_evaluation_fitting_keys' WHEN (k % 11 = 0 AND one) OR (k % 29 = 0 AND two) OR e = 0 THEN 'missing_persisted_stream_ids' END AS reason FROM h""", None)
def leakage_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trials and lines as keys, with overlaps, changed hashes, foreign, lost and repeated keys in some of them."""
    k, n = F.col("trial_id"), F.col("source_row_index")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("source_row_index"), F.when(F.col("l_linenumber") <= 2, "calibration").otherwise("evaluation").alias("partition"), (F.col("l_quantity") > 10).alias("much"))
    lines = kept(lines.groupBy("trial_id", "source_row_index", "partition").agg(F.max("much").alias("much")))
    also = lambda every: lines.filter((k % every == 0) & (n == 1)).withColumn("partition", F.lit("evaluation"))
    stored = lines.unionByName(also(17)).withColumn("stream", F.lit("ev3")).unionByName(lines.unionByName(also(23)).withColumn("stream", F.lit("vrmt")))
    changed = (k % 19 == 0) & (F.col("stream") == "ev3") & (F.col("partition") == "calibration")
    ledger = kept(quality.ledger(stored)).withColumn("identity_hash", F.when(changed, "other").otherwise(F.col("identity_hash")))
    telemetry = lines.filter(~((k % 11 == 0) & (n == 1))).unionByName(lines.filter((k % 29 == 0) & (n == 2)))
    foreign = lines.filter((k % 13 == 0) & (n == 1)).select("trial_id", F.lit(99).alias("source_row_index"))
    eligible = lines.filter("partition = 'evaluation' and much").select("trial_id", "source_row_index").unionByName(foreign)
    return keysets.leakage(telemetry, lines, ledger, eligible).drop("partition_hash")


_SLICED = """WITH $STREAMS, u AS (SELECT trial_id, t, arg_min(value, source_row_index) AS value FROM v GROUP BY trial_id, t), a AS (SELECT e.trial_id, e.source_row_index, e.t, u.t AS t0, u.value AS v0 FROM e ASOF LEFT JOIN u ON e.trial_id = u.trial_id AND e.t >= u.t),
b AS (SELECT e.source_row_index, u.t AS t1, u.value AS v1 FROM e ASOF LEFT JOIN u ON e.trial_id = u.trial_id AND e.t <= u.t)"""


@query(_SLICED + " SELECT trial_id, source_row_index, round(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) WHEN t1 = t0 THEN v0 END, 6) AS ref_value, coalesce(t0 IS NOT NULL AND t1 IS NOT NULL, false) AS valid FROM a JOIN b USING (source_row_index)")
def sliced_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Interpolation with every trial cut into days, as for a trial that is too large for one task."""
    samples = other(spark, d).groupBy("trial_id", "t").agg(F.min_by("value", "source_row_index").alias("value"))
    return asof.linear(own(spark, d), samples, ["value"], slice_s=86400.0).select("trial_id", "source_row_index", "ref_value", "valid")
