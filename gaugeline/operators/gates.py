"""Population gates, the cascade of stages, and the dataset design: small grids of trials joined with evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions.columns import finite, truthy

GATES = ("discovered", "paired", "missing_required_stream", "quality_accepted", "calibration_non_degenerate", "temporal_valid", "clock_valid", "final_alignment_valid", "baseline_valid", "H1_eligible", "H2_all_four_arm_eligible", "H3_both_arm_eligible")
MANIFEST_GATES = ("discovered", "paired", "missing_required_stream")
STAGES = ("S0", "S1", "S2", "S3", "S4")


def having_all(df: DataFrame, key: str, member: str, members: Sequence[str], ok: str) -> DataFrame:
    """Keys with exactly these members, one row each, all of them ok."""
    wanted = F.when(F.col(member).isin(*members), F.col(member))
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(wanted).alias("d"), F.bool_and(F.coalesce(F.col(ok), F.lit(False))).alias("ok"))
    return out.filter((F.col("n") == len(members)) & (F.col("d") == len(members)) & F.col("ok")).select(key)


def looked_up(df: DataFrame, known: DataFrame, column: str, default: str = "unknown", key: str = "trial_id") -> DataFrame:
    """Every row with its trial's entry of a table, or the default."""
    entries = known.groupBy(key).agg(F.min(column).alias(column))
    return df.join(entries, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def gate_members(manifest: DataFrame, evidence: Mapping[str, DataFrame | None]) -> dict[str, DataFrame | None]:
    """Trials that pass each gate; None where the evidence is missing. Gates without an entry in ``evidence`` follow from the manifest."""
    ids = manifest.select("trial_id").distinct()
    paired = manifest.filter("pair_status = 'paired'").select("trial_id").distinct()
    out: dict[str, DataFrame | None] = {"discovered": ids, "paired": paired, "missing_required_stream": ids.join(paired, "trial_id", "left_anti")}
    rules = {
        "quality_accepted": lambda d: paired.join(d.select("trial_id"), "trial_id", "left_anti"),
        "calibration_non_degenerate": lambda d: d.filter(F.lower("degeneracy_status") == "ok"),
        "temporal_valid": lambda d: d.filter(F.lower("status").isin("ok", "success")),
        "clock_valid": lambda d: d.filter(finite(F.col("scale_a")).isNotNull() & finite(F.col("offset_b")).isNotNull() & F.col("selected_model").isin("constant_offset", "affine")),
        "final_alignment_valid": lambda d: d.filter(truthy(F.col("accepted_for_hypothesis_tests")) & finite(F.col("ate_rmse")).isNotNull()),
        "baseline_valid": lambda d: d.filter(finite(F.col("baseline_rmse_mm")).isNotNull() & finite(F.col("final_rmse_mm")).isNotNull() & finite(F.col("delta_rmse_mm")).isNotNull()),
        "H1_eligible": lambda d: d.filter(truthy(F.col("valid_for_paper"))),
        "H2_all_four_arm_eligible": lambda d: having_all(d.withColumn("ok", (F.col("status") == "success") & finite(F.col("rmse_mm")).isNotNull()), "trial_id", "method", ("zoh", "linear", "pchip", "spline"), "ok"),
        "H3_both_arm_eligible": lambda d: having_all(d.withColumn("ok", truthy(F.col("valid_for_paper")) & finite(F.col("heldout_rmse_mm")).isNotNull()), "trial_id", "calibration_mode", ("split", "full"), "ok"),
    }
    for gate, rule in rules.items():
        table = evidence.get(gate)
        out[gate] = None if table is None else rule(table).select("trial_id").distinct()
    return out


def gate_ledger(manifest: DataFrame, members: Mapping[str, DataFrame | None]) -> DataFrame:
    """A row for every trial at every gate: passed, or why not.

    Passed gates are gathered as one small set for each trial, and the grid is the trial's row exploded over the gates, so
    trials meet the evidence in one aggregate and one join, whatever the number of gates.
    """
    passed = None
    for gate, df in members.items():
        if df is not None:
            rows = df.select("trial_id", F.lit(gate).alias("gate"))
            passed = rows if passed is None else passed.unionByName(rows)
    sets = passed.groupBy("trial_id").agg(F.collect_set("gate").alias("gates"))
    meta = manifest.groupBy("trial_id").agg(*[F.min(c).alias(c) for c in ("dataset_tier", "analysis_set", "scenario_id")])
    grid = meta.join(sets, "trial_id", "left").select("trial_id", "dataset_tier", "analysis_set", "scenario_id", F.explode(F.array(*[F.lit(g) for g in GATES])).alias("gate"), "gates")
    ok = F.coalesce(F.array_contains("gates", F.col("gate")), F.lit(False))
    absent = F.col("gate").isin(*[g for g in GATES if members.get(g) is None]) if any(members.get(g) is None for g in GATES) else F.lit(False)
    reason = F.when(ok, "passed").when(absent, "evidence_unavailable").otherwise("gate_failed")
    return grid.select("trial_id", "dataset_tier", "analysis_set", "scenario_id", "gate", F.when(ok, "passed").otherwise("failed").alias("gate_status"), reason.alias("reason"))


def gate_pivot(ledger: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Distinct trials that passed each gate by tier, and in all."""
    passed = ledger.filter("gate_status = 'passed'").select("gate", "dataset_tier", "trial_id").distinct()
    known = F.when(F.col("dataset_tier").isin(*tiers), F.col("dataset_tier"))
    return passed.groupBy("gate").agg(*[F.count_if(known == t).alias(t) for t in tiers], F.count_distinct("trial_id").alias("total"))


def cascade(ledger: DataFrame, metrics: DataFrame, support: DataFrame) -> DataFrame:
    """Five stages of every trial. Only the last has a score; it counts if the trial passed the final gate and its support holds.

    ``metrics``: trial_id, rmse_mm, status; ``support``: trial_id, support_hash, expected_hash, support_status.
    """
    final = ledger.filter("gate = 'final_alignment_valid'").select("trial_id", F.col("gate_status").alias("final_gate"))
    rows = ledger.select("trial_id", "dataset_tier").distinct().join(final, "trial_id", "left").join(metrics, "trial_id", "left").join(support, "trial_id", "left")
    # What is wrong with the gate comes before anything about the support.
    reason = (
        F.when(F.col("final_gate").isNull(), "missing_trial_gate_record").when(F.col("final_gate") == "failed", "final_gate_failed").when(F.col("final_gate") != "passed", "gate_status_unrecognized")
        .when(F.col("support_hash").isNull(), "support_hash_unavailable").when(F.col("support_status") != "valid", "support_validation_failed").when(F.col("support_hash") != F.col("expected_hash"), "support_hash_mismatch")
        .when(F.col("status").isNull(), "missing_canonical_provenance_artifact").when(F.col("status") != "success", F.col("status"))
    )
    grid = rows.select("trial_id", "dataset_tier", "rmse_mm", reason.alias("why"), F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    last = F.col("stage") == STAGES[-1]
    valid = last & F.col("why").isNull() & finite(F.col("rmse_mm")).isNotNull()
    return grid.select("trial_id", "dataset_tier", "stage", F.when(valid, F.col("rmse_mm")).alias("score_mm"), valid.alias("valid"), F.when(~last, "stage_not_persisted").when(valid, F.lit(None)).otherwise(F.coalesce("why", F.lit("non_finite_score"))).alias("reason"))


def stage_summary(cascade_rows: DataFrame) -> DataFrame:
    """Mean, median and trials of each stage, and its reduction against the stage right before, where that has a score."""
    good = cascade_rows.filter(F.col("valid") & F.col("score_mm").isNotNull())
    out = good.groupBy("stage").agg(F.avg("score_mm").alias("mean_mm"), F.median("score_mm").alias("median_mm"), F.count_distinct("trial_id").alias("n_trials"))
    line = Window.orderBy("stage")
    adjacent = F.substring("stage", 2, 2).cast("int") == F.lag(F.substring("stage", 2, 2).cast("int")).over(line) + 1
    return out.withColumn("reduction_mm", F.when(adjacent, F.lag("mean_mm").over(line) - F.col("mean_mm")))


def design_grid(spark: SparkSession, drives: int = 9, routes: int = 9, repetitions: int = 5) -> DataFrame:
    """The nominal cells."""
    n = spark.range(drives * routes * repetitions)
    d, r = F.floor(F.col("id") / (routes * repetitions)) + 1, F.floor(F.col("id") / repetitions) % routes + 1
    return n.select(F.concat(F.lit("D"), d).alias("drive_id"), F.concat(F.lit("T"), r).alias("route_id"), (F.col("id") % repetitions + 1).cast("int").alias("repetition_id"))


def missing_cells(nominal: DataFrame, found: DataFrame, on: Sequence[str] = ("drive_id", "route_id", "repetition_id")) -> DataFrame:
    return nominal.join(found, list(on), "left_anti")


def balance(nominal: DataFrame, found: DataFrame, accepted: DataFrame, on: Sequence[str] = ("drive_id", "route_id")) -> DataFrame:
    """Nominal, discovered and accepted trials of each scenario."""
    rows = [df.select(*on, *[F.lit(int(k == j)).alias(c) for j, c in enumerate(("nominal", "discovered", "accepted"))]) for k, df in enumerate((nominal, found, accepted))]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(*on).agg(*[F.sum(c).alias(c) for c in ("nominal", "discovered", "accepted")])
    return out.withColumn("complete", F.col("accepted") >= F.col("nominal"))


#: Profiles of the design's drives and routes, by their place in it: three degrees of one property for each three of the other.
DRIVE_PROFILES = (("Low", "Medium", "High"), ("Low", "Medium", "High"))
ROUTE_PROFILES = (("Simple", "Moderate", "Complex"), ("Low", "Medium", "High"))
#: The order in which a trial's checks are made; the last one that it fails is its reason.
CHECKS = ("too_few_ev3_rows", "too_few_vrmt_rows", "insufficient_ev3_duration", "insufficient_vrmt_duration", "excessive_ev3_gap", "excessive_vrmt_gap", "excessive_ev3_irregularity", "excessive_vrmt_irregularity")


def design_trials(pairs: DataFrame, rejected: DataFrame, scored: DataFrame) -> DataFrame:
    """The discovered trials and what became of them: a row for each pair with its cell, tier, final acceptance and reason.

    Accepted is a trial that no check rejects and that has a score; one that has none without a reason is pipeline_crash_or_missing_metric.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, CHECKS)), F.col("reason")), F.lit(0))
    last = rejected.groupBy("trial_id").agg(F.max_by("reason", F.struct(order, "reason")).alias("rejected_for"))
    out = pairs.select("trial_id", "drive_id", "route_id", "scenario_id", "repetition_id", "pair_status", "dataset_tier").join(last, "trial_id", "left").join(scored.select("trial_id", F.lit(True).alias("__scored")).distinct(), "trial_id", "left")
    ok = F.col("rejected_for").isNull() & F.col("__scored").isNotNull()
    reason = F.when(ok, "none").otherwise(F.coalesce("rejected_for", F.lit("pipeline_crash_or_missing_metric")))
    return out.withColumns({"final_acceptance_status": ok, "final_rejection_reason": reason}).drop("rejected_for", "__scored")


def design_missing(nominal: DataFrame, trials: DataFrame) -> DataFrame:
    """Cells of the design without a discovered trial."""
    return missing_cells(nominal, trials.select("drive_id", "route_id", F.col("repetition_id").cast("int").alias("repetition_id")))


def design_overview(nominal: DataFrame, trials: DataFrame) -> DataFrame:
    """Expected, discovered, accepted and rejected trials of the whole design and their rates."""
    counts = trials.agg(F.count("*").alias("discovered_count"), F.count_if("final_acceptance_status").alias("accepted_count"))
    out = nominal.agg(F.count("*").alias("expected_count")).crossJoin(counts).withColumn("rejected_count", F.col("discovered_count") - F.col("accepted_count"))  # one row each
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return out.withColumns({
        "acceptance_rate": rate("accepted_count", "discovered_count"), "missing_rate": (F.col("expected_count") - F.col("discovered_count")) / F.greatest(F.lit(1), F.col("expected_count")), "rejection_rate": rate("rejected_count", "discovered_count"),
    })


def scenario_catalog(nominal: DataFrame) -> DataFrame:
    """The design's scenarios, with the place of their drive and route in the table of profiles."""
    number = lambda c: F.substring(c, 2, 4).cast("int") - 1
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    d, r = number("drive_id"), number("route_id")
    return nominal.select("drive_id", "route_id").distinct().select(
        F.concat_ws("_", "drive_id", "route_id").alias("scenario_id"), "drive_id", "route_id",
        pick(DRIVE_PROFILES[0], F.floor(d / 3).cast("int")).alias("motion_dynamics_profile"), pick(DRIVE_PROFILES[1], (d % 3).cast("int")).alias("rotational_dynamics_profile"),
        pick(ROUTE_PROFILES[0], F.floor(r / 3).cast("int")).alias("route_geometric_complexity"), pick(ROUTE_PROFILES[1], (r % 3).cast("int")).alias("route_maneuver_alternation"),
    )
