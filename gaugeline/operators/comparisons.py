"""Paired scoring of alignment arms on exactly shared held-out rows, and the three comparisons with their reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions.signals import METHODS
from gaugeline.operators import alignment, keysets, metrics, ordered, quality, statistics, support
from gaugeline.operators.digests import ordered_digests
from gaugeline.functions.columns import finite, is_evaluation, rotate_translate

KEY = ["source_row_index"]


#: What the arms of a comparison are made by: offset, scale, rows of the fit, reference operator.
POLICIES: dict[str, dict[str, tuple[str, str, str, str]]] = {
    "H1": {"onset": ("onset", "constant", "calibration", "spline"), "refined": ("refined", "constant", "calibration", "spline")},
    "H2": {m: ("refined", "selected", "calibration", m) for m in METHODS},
    "H3": {"split": ("refined", "selected", "calibration", "spline"), "full": ("refined", "selected", "all", "spline")},
    "baseline": {"baseline": ("onset", "constant", "all", "zoh"), "final": ("refined", "selected", "calibration", "spline")},
}


def check_policies(policies: Mapping[str, Mapping[str, Sequence[str]]] = POLICIES) -> None:
    """Arms of a hypothesis differ in one thing only, those of the baseline in every one; else their difference says nothing."""
    for name, arms in policies.items():
        differing = [len(set(column)) > 1 for column in zip(*arms.values(), strict=True)]
        wanted = 4 if name == "baseline" else 1
        if sum(differing) != wanted:
            raise ValueError(f"the arms of {name} differ in {sum(differing)} policies, not in {wanted}")


def held_out(aligned: DataFrame) -> DataFrame:
    """Evaluation rows with a finite residual."""
    return aligned.filter(is_evaluation(F.col("partition")) & finite(F.col("residual_norm")).isNotNull())


def stacked(arms: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all arms with the arm's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("arm", F.lit(name)) for name, df in arms.items()])


def score(arms: Mapping[str, DataFrame]) -> DataFrame:
    """One row a trial: RMSE of each arm in mm on the common support, its count, hash and status.

    Only keys and residuals go into the joins; an arm's other columns stay where they are.
    """
    rows = {name: held_out(df).select("trial_id", "source_row_index", "residual_norm") for name, df in arms.items()}
    common = support.common_support(rows, KEY, ["trial_id"])
    kept = stacked(support.filter_common(rows, KEY, ["trial_id"]))
    names = sorted(arms)
    rmse = kept.groupBy("trial_id").agg(*[(F.sqrt(F.avg(F.when(F.col("arm") == n, F.col("residual_norm") * F.col("residual_norm")))) * 1000).alias(f"{n}_rmse_mm") for n in names])
    valid = F.col("support_status") == "valid"
    out = common.join(rmse, "trial_id", "left")
    return out.withColumns({f"{n}_rmse_mm": F.when(valid, F.col(f"{n}_rmse_mm")) for n in names})


def paired(arms: Mapping[str, DataFrame], first: str, second: str, fits: DataFrame | None = None) -> DataFrame:
    """score() of two arms with delta = first - second, validity and reason. ``fits``: trial_id, fit_status ('ok' or why not)."""
    out = score({first: arms[first], second: arms[second]})
    out = out.withColumn("delta_rmse_mm", F.col(f"{first}_rmse_mm") - F.col(f"{second}_rmse_mm"))
    if fits is None:
        out = out.withColumn("fit_status", F.lit("ok"))
    else:
        out = fits.select("trial_id", "fit_status").join(out, "trial_id", "left")
    ok = (F.col("fit_status") == "ok") & F.col("delta_rmse_mm").isNotNull()
    reason = F.when(ok, F.lit(None)).when(F.col("fit_status") != "ok", F.col("fit_status")).when(F.coalesce(F.col("support_status"), F.lit("empty")) != "valid", F.coalesce("support_status", F.lit("empty"))).otherwise("insufficient_overlap")
    return out.withColumns({"valid_for_paper": F.coalesce(ok, F.lit(False)), "reason": reason})


def _parameters(times: DataFrame, spatial: DataFrame) -> DataFrame:
    return times.select("trial_id", "scale_a", "offset_b").join(spatial.select("trial_id", "theta_rad", "tx", "ty"), "trial_id")


def fit_arm(telemetry: DataFrame, tracking: DataFrame, rows: DataFrame, others: DataFrame, times: DataFrame, s: Settings, method: str = "spline") -> DataFrame:
    """Align ``rows`` with a spatial fit on (telemetry, tracking) at the given clock (trial_id, scale_a, offset_b)."""
    spatial = alignment.spatial_fit(telemetry, tracking, times, s)
    return alignment.align(rows, others, _parameters(times, spatial), s, method)


def h1(telemetry: DataFrame, tracking: DataFrame, times: DataFrame, s: Settings) -> DataFrame:
    """Onset offset against refined offset: both fitted on calibration rows only, scored on the same evaluation rows."""
    cal = [df.filter("partition = 'calibration'") for df in (telemetry, tracking)]
    held = telemetry.filter("partition = 'evaluation'")
    arms = {}
    for name, column in (("onset", "b_onset"), ("refined", "b_final")):
        clock = times.select("trial_id", F.lit(1.0).alias("scale_a"), F.col(column).alias("offset_b"))
        arms[name] = fit_arm(*cal, held, tracking, clock, s)
    out = paired(arms, "onset", "refined", times.select("trial_id", F.col("temporal_status").alias("fit_status")))
    return out.join(times.select("trial_id", F.col("b_onset").alias("b_onset_s"), F.col("b_final").alias("b_refined_s"), (F.col("b_final") - F.col("b_onset")).alias("delta_b_s"), F.col("ratio").alias("peak_ratio")), "trial_id", "left")


def h2(telemetry: DataFrame, tracking: DataFrame, params: DataFrame, s: Settings, methods: Sequence[str] = METHODS) -> DataFrame:
    """One row for each trial and reference operator: RMSE on the rows where all operators are finite, count and hash.

    Only the reference operator differs between the arms; clock and plane are those of the trial.
    """
    if tuple(methods) != METHODS:
        raise ValueError(f"methods must be {METHODS}")
    held = telemetry.filter(is_evaluation(F.col("partition"))).join(params, "trial_id").withColumn("t", F.col("scale_a") * F.col("local_time_s") + F.col("offset_b"))
    samples = tracking.select("trial_id", "source_row_index", F.col("relative_time_s").alias("t"), "planar_x", "planar_y")
    reference = alignment.query_reference(held, samples, ["planar_x", "planar_y"], methods).filter("valid").drop("t", "valid")
    rows = reference.join(held.select("trial_id", "source_row_index", "odometry_x", "odometry_y", "theta_rad", "tx", "ty"), ["trial_id", "source_row_index"])
    zero = F.lit(0.0)
    x, y = rotate_translate(F.col("ref_planar_x"), -F.col("ref_planar_y") if s.flip_y else F.col("ref_planar_y"), F.col("theta_rad"), zero, zero, F.col("tx"), F.col("ty"))
    rows = rows.select("trial_id", "source_row_index", "method", F.hypot(F.col("odometry_x") - x, F.col("odometry_y") - y).alias("r")).filter("r is not null")
    # A row counts if every method has it: one aggregate on the row's key, and no intersection of four tables.
    by_key = rows.groupBy("trial_id", "source_row_index").agg(F.count("*").alias("n"), F.collect_list(F.struct("method", "r")).alias("each")).filter(F.col("n") == len(methods))
    hashed = ordered_digests(by_key, ["trial_id"], "source_row_index", "common_support_count", "common_support_hash")
    rmse = by_key.select("trial_id", F.inline("each")).groupBy("trial_id", "method").agg((F.sqrt(F.avg(F.col("r") * F.col("r"))) * 1000).alias("rmse_mm"))
    grid = params.select("trial_id", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    out = grid.join(rmse, ["trial_id", "method"], "left").join(hashed, "trial_id", "left")
    return out.withColumn("status", F.when(F.col("rmse_mm").isNotNull(), "success").otherwise("no_common_support"))


def h3(telemetry: DataFrame, tracking: DataFrame, bounds: DataFrame, ledger: DataFrame, s: Settings, eligible: DataFrame | None = None) -> DataFrame:
    """Fit on calibration rows only against fit on all rows: two rows for each trial, with what each arm was fitted on, or the reason why not.

    The full arm is meant to leak: it shows what a fit gains from the rows that it is scored on. Which keys are whose is checked against
    the ledger first (``keysets.leakage``). ``eligible`` (trial_id, source_row_index): evaluation rows that may be fitted, by default all.
    """
    held = telemetry.filter("partition = 'evaluation'")
    arms, fits = {}, None
    for mode, kept in (("split", "partition = 'calibration'"), ("full", "partition in ('calibration', 'evaluation')")):
        a, b = telemetry.filter(kept), tracking.filter(kept)
        times = alignment.fit_time(a, b, s)
        arms[mode] = fit_arm(a, b, held, tracking, times.select("trial_id", "scale_a", "offset_b"), s)
        status = times.select("trial_id", F.when(F.col("temporal_status").isin("missing_input", "invalid_data"), F.concat(F.lit("invalid_temporal_status:"), "temporal_status")).otherwise("ok").alias(mode))
        fits = status if fits is None else fits.join(status, "trial_id", "full")
    sets = keysets.leakage(telemetry, tracking, ledger, eligible)
    known = sets.withColumnRenamed("reason", "key_reason")
    gate = bounds.select("trial_id", "partition_status", "evaluation_duration_s").join(known, "trial_id", "left").join(fits, "trial_id", "left")
    unfit = lambda mode: F.coalesce(mode, F.lit("missing_or_empty_fitting_partition"))
    status = (
        F.when(F.col("partition_hash").isNull(), "missing_persisted_h3_keys_or_partition_hash").when(F.col("key_reason").isNotNull(), F.col("key_reason"))
        .when(F.col("partition_status") == "insufficient_evaluation_duration", "insufficient_evaluation_duration")
        .when(unfit("split") != "ok", unfit("split")).when(unfit("full") != "ok", unfit("full")).otherwise("ok")
    )
    wide = paired(arms, "split", "full", gate.withColumn("fit_status", status)).join(known.drop("key_reason"), "trial_id", "left")
    of_mode = lambda m: F.struct(
        F.lit(m).alias("calibration_mode"), F.col(f"{m}_rmse_mm").alias("heldout_rmse_mm"), F.col(f"{m}_count").alias("fit_source_key_count"), F.col(f"{m}_hash").alias("fit_source_key_hash"),
        (F.col("split_excludes") if m == "split" else F.lit(None).cast("boolean")).alias("split_excludes_evaluation_fitting"), (F.col("full_includes") if m == "full" else F.lit(None).cast("boolean")).alias("full_includes_evaluation_fitting"),
        F.lit(keysets.LEAKAGE[m]).alias("leakage_status"),
    )
    shared = ["delta_rmse_mm", "common_support_count", "common_support_hash", "support_status", "valid_for_paper", "reason", "partition_hash"]
    return wide.select("trial_id", F.inline(F.array(*map(of_mode, MODES))), *shared, F.col("eligible_count").alias("eligible_evaluation_fitting_key_count"), F.col("eligible_hash").alias("eligible_evaluation_fitting_key_hash"))


def baseline(telemetry: DataFrame, tracking: DataFrame, times: DataFrame, final: DataFrame, tiers: DataFrame, s: Settings) -> DataFrame:
    """The engineering baseline (onset offset, no clock scale, fit on the whole trajectory, zero-order hold) against the final arm.

    A row for each trial of ``tiers``, with a reason where it isn't scored: a baseline that doesn't cover every row of the final arm's
    support isn't scored on fewer rows instead.
    """
    clock = times.select("trial_id", F.lit(1.0).alias("scale_a"), F.col("b_onset").alias("offset_b"))
    spatial = alignment.spatial_fit(telemetry, tracking, clock, s)
    arm = alignment.align(telemetry, tracking, _parameters(clock, spatial), s, "zoh")
    both = score({"baseline": arm, "final": final})
    expected = held_out(final).groupBy("trial_id").agg(F.count_distinct("source_row_index").alias("canonical_support_count"))
    fits = spatial.select("trial_id", F.col("theta_rad").alias("baseline_theta_rad"), F.col("tx").alias("baseline_tx"), F.col("ty").alias("baseline_ty"))
    rows = tiers.select("trial_id", "dataset_tier")
    for side in (expected, both, fits):
        rows = rows.join(side, "trial_id", "left")
    rows = rows.withColumns({"delta_rmse_mm": F.col("baseline_rmse_mm") - F.col("final_rmse_mm"), "common_support_count": F.coalesce("common_support_count", F.lit(0))})
    reason = (
        F.when(F.col("canonical_support_count").isNull(), "canonical_support_missing").when(F.col("baseline_theta_rad").isNull(), "baseline_spatial_fit_invalid")
        .when(F.col("common_support_count") != F.col("canonical_support_count"), "baseline_common_support_does_not_cover_canonical_support").when(finite(F.col("delta_rmse_mm")).isNull(), "paired_score_metrics_non_finite")
    )
    return rows.select("trial_id", "dataset_tier", "baseline_rmse_mm", "final_rmse_mm", "delta_rmse_mm", "common_support_count", "common_support_hash", "baseline_theta_rad", "baseline_tx", "baseline_ty", "canonical_support_count", reason.alias("reason"))


def h1_summary(rows: DataFrame) -> DataFrame:
    """Of h1() rows: the mean difference of the valid ones, how many these are, and how many were left out as ambiguous."""
    valid = F.coalesce("valid_for_paper", F.lit(False))
    return rows.agg(F.avg(F.when(valid, F.col("delta_rmse_mm"))).alias("mean_delta_rmse"), F.count_if(valid).alias("accepted_for_h1"), F.count_if(F.col("fit_status") == "ambiguous").alias("excluded_ambiguous_count"))


#: The baseline's populations, and the tiers of their trials; those with True are tested.
BASELINE_POPULATIONS = {
    "planned_population": (("planned_405",), True),
    "extended_only_population": (("extended_previous_paper",), False),
    "combined_compatible_population": (("planned_405", "extended_previous_paper"), True),
}


def baseline_summary(rows: DataFrame) -> DataFrame:
    """Of baseline() rows that are scored: a row for each population, also an empty one, with what the difference looks like, both arms' means and
    medians, and the paired test."""
    members = metrics.populations(rows, "dataset_tier", {p: tiers for p, (tiers, _) in BASELINE_POPULATIONS.items()})
    described = metrics.describe_delta(members, "delta_rmse_mm", ["population"])
    described = described.withColumnsRenamed({c: f"{c}_delta_mm" for c in described.columns if c not in ("population", "paired_n", "exact_equality_count", "nonzero_count", "threshold_counts")})
    arms = members.groupBy("population").agg(*[F.avg(f"{a}_rmse_mm").alias(f"mean_{a}_rmse_mm") for a in ("baseline", "final")])
    middle = ordered.quantiles(members, ["population"], ["baseline_rmse_mm", "final_rmse_mm"], {"m": 0.5})
    middle = middle.groupBy("population").agg(*[F.max(F.when(F.col("name") == f"{a}_rmse_mm", F.col("m"))).alias(f"median_{a}_rmse_mm") for a in ("baseline", "final")])
    tested = [p for p, (_, wanted) in BASELINE_POPULATIONS.items() if wanted]
    tests = statistics.comparator_tests(members.filter(F.col("population").isin(tested)), "baseline_rmse_mm", "final_rmse_mm", ["population"]).drop("n")
    out = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BASELINE_POPULATIONS))).alias("population"))
    for side in (described, arms, middle, tests):
        out = out.join(side, "population", "left")
    none = F.create_map(*[x for name in metrics.EXCEEDED for x in (F.lit(name), F.lit(0).cast("long"))])
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("paired_n", "exact_equality_count", "nonzero_count")}
    untested = F.col("population").isin(tested) & F.col("paired_test_name").isNull()
    return out.withColumns(counts | {"threshold_counts": F.coalesce("threshold_counts", none), "paired_test_name": F.when(untested, "not_computable").otherwise(F.col("paired_test_name"))})


#: Populations of tests, and the tiers of their trials.
POPULATIONS = {"planned": ("planned_405",), "all": ("planned_405", "extended_previous_paper")}
MODES = ("split", "full")


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-9 + 1e-7 * F.abs(b)


def h1_eligible(rows: DataFrame) -> DataFrame:
    """h1() rows with ``why_not``: the first check that fails, or NULL. Only such rows are tested whose difference follows from their arms."""
    refused = (
        F.when(~F.coalesce("valid_for_paper", F.lit(False)), "not_valid").when(finite(F.col("delta_rmse_mm")).isNull(), "delta_not_finite").when(F.coalesce("common_support_count", F.lit(0)) <= 0, "support_empty")
        .when(F.length(F.coalesce("common_support_hash", F.lit(""))) == 0, "support_hash_missing").when(F.coalesce("fit_status", F.lit("")) != "ok", "fit_not_ok")
        .when(~F.coalesce(_near(F.col("onset_rmse_mm") - F.col("refined_rmse_mm"), F.col("delta_rmse_mm")), F.lit(False)), "delta_differs_from_arms")
    )
    return rows.withColumn("why_not", refused)


def h3_eligible(rows: DataFrame) -> DataFrame:
    """One row for each trial of h3(): both arms side by side, and ``why_not``, the first check that fails, or NULL."""
    one = lambda c: [F.min(c).alias(c), F.max(c).alias(f"{c}_b"), F.count(c).alias(f"n_{c}")]
    of = lambda m, c, out: F.max(F.when(F.col("calibration_mode") == m, F.col(c))).alias(out)
    wide = rows.groupBy("trial_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.when(F.col("calibration_mode").isin(*MODES), F.col("calibration_mode"))).alias("n_modes"), F.bool_and(F.coalesce("valid_for_paper", F.lit(False))).alias("valid"),
        F.bool_and(F.col("support_status") == "valid").alias("support_valid"), *[of(m, "heldout_rmse_mm", m) for m in MODES],
        *[x for c in ("delta_rmse_mm", "common_support_count", "common_support_hash", "partition_hash", "eligible_evaluation_fitting_key_count", "eligible_evaluation_fitting_key_hash") for x in one(c)],
        *[of(m, c, f"{m}_{out}") for m in MODES for c, out in (("fit_source_key_count", "fit_count"), ("fit_source_key_hash", "fit_hash"), ("leakage_status", "leakage"))],
        of("split", "split_excludes_evaluation_fitting", "excludes"), of("full", "full_includes_evaluation_fitting", "includes"),
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    agree = lambda c: (F.col(f"n_{c}") == 2) & (F.col(c) == F.col(f"{c}_b"))
    said = lambda c: F.length(F.trim(F.col(c))) > 0
    refused = (
        F.when((F.col("n_rows") != 2) | (F.col("n_modes") != 2), "not_one_row_for_each_mode").when(no(F.col("valid")), "not_valid").when((F.col("n_delta_rmse_mm") != 2) | finite(F.col("delta_rmse_mm")).isNull(), "delta_not_finite")
        .when(finite(F.col("split")).isNull() | finite(F.col("full")).isNull(), "score_not_finite").when(F.coalesce("common_support_count", F.lit(0)) <= 0, "support_empty").when(no(agree("common_support_count")), "support_counts_differ")
        .when(no(said("common_support_hash")) | (F.col("n_common_support_hash") != 2), "support_hash_missing").when(no(agree("common_support_hash")), "support_hashes_differ").when(no(F.col("support_valid")), "support_not_valid")
        .when(no(agree("partition_hash") & said("partition_hash")), "partition_hash_missing_or_different").when(no(_near(F.col("split") - F.col("full"), F.col("delta_rmse_mm"))), "delta_differs_from_arms").when(no(_near(F.col("delta_rmse_mm"), F.col("delta_rmse_mm_b"))), "deltas_differ")
        .when(no(F.col("excludes")), "split_fit_holds_evaluation_keys").when(no(F.col("includes")), "full_fit_without_evaluation_keys")
        .when(no((F.col("split_fit_count") > 0) & (F.col("full_fit_count") > F.col("split_fit_count"))), "fit_counts_not_nested").when(no(said("split_fit_hash") & said("full_fit_hash")), "fit_hash_missing")
        .when(no((F.col("split_leakage") == keysets.LEAKAGE["split"]) & (F.col("full_leakage") == keysets.LEAKAGE["full"])), "leakage_status_wrong")
        .when(no(agree("eligible_evaluation_fitting_key_count") & (F.col("eligible_evaluation_fitting_key_count") > 0)), "eligible_counts_differ_or_empty").when(no(said("eligible_evaluation_fitting_key_hash") & (F.col("n_eligible_evaluation_fitting_key_hash") == 2)), "eligible_hash_missing")
    )
    return wide.withColumn("why_not", refused)


def populations(tiers: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.col("dataset_tier").isin(*t), F.lit(p)) for p, t in POPULATIONS.items()]))
    return tiers.select("trial_id", F.explode(names).alias("population"))


def h2_friedman(h2_rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """The Friedman test over trials with all four operators on one shared support, for both populations."""
    rows = h2_rows.filter("status = 'success'").select("trial_id", "method", F.col("rmse_mm").alias("value"), "common_support_hash").join(populations(tiers), "trial_id")
    return statistics.friedman_tests(rows, METHODS, ["population"], support="common_support_hash")


def h2_posthoc(h2_rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """Signed rank tests of all pairs of operators, Holm-adjusted within each population."""
    whole = statistics.complete_blocks(h2_rows.filter("status = 'success'"), METHODS, value="rmse_mm", support="common_support_hash")
    rows = statistics.contrasts(whole, METHODS, value="rmse_mm").join(populations(tiers), "trial_id")
    return statistics.holm(statistics.signed_rank_tests(rows, "a", "b", ["population", "contrast"]), family=["population"])


def inference(h1_rows: DataFrame, h2_rows: DataFrame, h3_rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """H1, H2 and H3 over the planned and all populations, Holm-adjusted within the planned one, with decisions.

    A hypothesis that has no eligible trial in a population has a row too, with n = 0 and the commonest reason why not.
    """
    members = populations(tiers)
    one, three = h1_eligible(h1_rows), h3_eligible(h3_rows)
    pairs = one.filter("why_not is null").select("trial_id", F.lit("H1").alias("hypothesis_id"), F.col("onset_rmse_mm").alias("a"), F.col("refined_rmse_mm").alias("b"))
    pairs = pairs.unionByName(three.filter("why_not is null").select("trial_id", F.lit("H3").alias("hypothesis_id"), F.col("split").alias("a"), F.col("full").alias("b")))
    signed = statistics.signed_rank_tests(pairs.join(members, "trial_id"), "a", "b", ["hypothesis_id", "population"])
    joint = h2_friedman(h2_rows, tiers).select(F.lit("H2").alias("hypothesis_id"), "population", "n", "statistic", "p_value", "kendall_w", "status")
    tests = signed.unionByName(joint, allowMissingColumns=True)
    refused = one.select("trial_id", F.lit("H1").alias("hypothesis_id"), "why_not").unionByName(three.select("trial_id", F.lit("H3").alias("hypothesis_id"), "why_not")).filter("why_not is not null").join(members, "trial_id")
    commonest = metrics.most_common(refused, ["hypothesis_id", "population"], "why_not", "reason")
    names = F.array(*[F.struct(F.lit(h).alias("hypothesis_id"), F.lit(p).alias("population")) for h in ("H1", "H2", "H3") for p in POPULATIONS])
    every = tests.sparkSession.range(1).select(F.inline(names))
    tests = every.join(tests, ["hypothesis_id", "population"], "left").join(commonest, ["hypothesis_id", "population"], "left")
    tests = tests.withColumns({"n": F.coalesce("n", F.lit(0)), "reason": F.when(F.coalesce("n", F.lit(0)) == 0, F.coalesce("reason", F.lit("no_rows"))), "status": F.coalesce("status", F.lit("insufficient_or_no_eligible_rows"))})
    family = tests.withColumn("p_family", F.when(F.col("population") == "planned", F.col("p_value")))
    adjusted = statistics.holm(family, "p_family", "p_adjusted", ["population"])
    return adjusted.drop("p_family").withColumn("decision", statistics.decide(F.col("n"), F.coalesce("p_adjusted", "p_value")))


def conclusion_stability(decisions: DataFrame) -> DataFrame:
    """Whether each hypothesis is decided alike over the planned and over all trials."""
    wide = decisions.groupBy("hypothesis_id").agg(*[F.max(F.when(F.col("population") == p, F.col(c))).alias(f"{p}_{c}") for p in POPULATIONS for c in ("n", "decision")])
    return wide.withColumn("stable", F.col("planned_decision") == F.col("all_decision"))


def ledger_of(telemetry: DataFrame, tracking: DataFrame) -> DataFrame:
    return quality.ledger(telemetry.unionByName(tracking, allowMissingColumns=True))
