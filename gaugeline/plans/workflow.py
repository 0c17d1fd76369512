"""From a folder of logs to results: a graph of products, each written once and read by those that need it.

RESULTS says which products a result consists of, READS which products each of them reads; a selection is what can be reached
from its results. Every product is an ordinary DataFrame program over all trials at once; nothing loops over trials.

Tables and status files are written through Spark, to any folder that Spark can write and the executors share.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import platform
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import Settings, check_frozen
from gaugeline.functions.columns import finite, is_evaluation
from gaugeline.operators import alignment, asof, cleaning, comparisons, gates, metrics, quality, statistics, support
from gaugeline.plans.presentation import PER_TRIAL, chart, figures, reported, tables
from gaugeline.sources import logs, sinks

class RunError(RuntimeError):
    """A run that can't go on; the reason is in its status file."""


def check_folders(inputs: list[Path], output: Path) -> None:
    """Inputs are different folders; the output is neither inside one of them nor around it."""
    resolved = [p.resolve() for p in inputs]
    if len(set(resolved)) < len(resolved):
        raise ValueError("two inputs are the same folder")
    for folder in resolved:
        if folder.is_relative_to(output.resolve()) or output.resolve().is_relative_to(folder):
            raise ValueError(f"{output} overlaps the input {folder}")


@dataclass
class Run:
    """Products of one run, made when first asked for and kept as Parquet below ``folder``."""

    spark: SparkSession
    inputs: dict[str, str]
    folder: str
    settings: Settings = field(default_factory=Settings)
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            df = PRODUCTS[name](self)
            path = f"{self.folder}/{name}"
            df.write.parquet(path)
            self.made[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.made[name]

    def empty(self, name: str) -> bool:
        return self[name].isEmpty()


def _logs(run: Run, stream: str) -> DataFrame:
    column = {"ev3": "ev3_file", "vrmt": "vrmt_file"}[stream]
    files = run["pairs"].filter("pair_status = 'paired'").select(F.col(column).alias("file_path"), "trial_id")
    return logs.read_stream(run.spark, files, sniff=stream == "vrmt")


def _telemetry(run: Run) -> DataFrame:
    raw = _logs(run, "ev3")
    return cleaning.clean_telemetry(raw, run.settings) if len(raw.columns) > 2 else _nothing(run, "trial_id string, source_row_index long, local_time_s double")


def _tracking(run: Run) -> DataFrame:
    raw = _logs(run, "vrmt")
    return cleaning.clean_tracking(raw, run.settings) if len(raw.columns) > 2 else _nothing(run, "trial_id string, source_row_index long, relative_time_s double")


def _nothing(run: Run, schema: str) -> DataFrame:
    return run.spark.createDataFrame([], schema)


def _diagnostics(run: Run) -> DataFrame:
    both = [quality.diagnostics(run[p], t).withColumn("stream", F.lit(n)) for p, t, n in (("telemetry", "local_time_s", "ev3"), ("tracking", "relative_time_s", "vrmt"))]
    return both[0].unionByName(both[1])


def _rejections(run: Run) -> DataFrame:
    e, v = (run["diagnostics"].filter(F.col("stream") == n).drop("stream") for n in ("ev3", "vrmt"))
    known = run["pairs"].filter("pair_status = 'paired'").select("trial_id")
    return quality.rejections(known.join(e, "trial_id", "left"), v, run.settings)


def _accepted(run: Run) -> DataFrame:
    return quality.accepted(run["pairs"], run["rejections"]).select("trial_id", "dataset_tier", "analysis_set", "scenario_id")


def _split(run: Run, name: str) -> DataFrame:
    s = run.settings
    rows = run[name].join(run["accepted"].select("trial_id"), "trial_id", "left_semi")
    if name == "telemetry":
        rows = cleaning.telemetry_signals(rows, s)
        return quality.partition(rows, run["bounds"], "local_time_s", "ev3")
    rows = cleaning.planar(cleaning.tracking_signals(rows, s), s)
    if s.planar_mode == "fitted_plane":
        rows = alignment.plane_residual(rows)
    return quality.partition(rows, run["bounds"], "relative_time_s", "vrmt")


def _bounds(run: Run) -> DataFrame:
    return quality.boundaries(run["telemetry"].join(run["accepted"].select("trial_id"), "trial_id", "left_semi"), run.settings)


def _degeneracy(run: Run) -> DataFrame:
    s = run.settings
    e = quality.telemetry_degeneracy(run["telemetry_rows"].filter("partition = 'calibration'"), s)
    v = quality.tracking_degeneracy(run["tracking_rows"].filter("partition = 'calibration'"), s)
    both = run["bounds"].join(e.select("trial_id", F.col("degenerate").alias("e"), F.col("distance").alias("ev3_distance"), F.col("angular_change").alias("ev3_angular_change")), "trial_id", "left")
    both = both.join(v.select("trial_id", F.col("degenerate").alias("v"), F.col("distance").alias("vrmt_distance")), "trial_id", "left")
    status = F.when(F.col("partition_status") != "success", "rejected").when(F.coalesce("e", F.lit(True)) | F.coalesce("v", F.lit(True)), "degenerate").otherwise("ok")
    return both.withColumn("degeneracy_status", status).drop("e", "v")


def _good(run: Run, name: str) -> DataFrame:
    """Rows of trials that can be fitted."""
    return run[name].join(run["degeneracy"].filter("degeneracy_status = 'ok'").select("trial_id"), "trial_id", "left_semi")


def _times(run: Run) -> DataFrame:
    cal = [_good(run, n).filter("partition = 'calibration'") for n in ("telemetry_rows", "tracking_rows")]
    return alignment.fit_time(*cal, run.settings)


def _spatial(run: Run) -> DataFrame:
    cal = [_good(run, n).filter("partition = 'calibration'") for n in ("telemetry_rows", "tracking_rows")]
    return alignment.spatial(*cal, run["times"], run.settings)


def _params(run: Run) -> DataFrame:
    return run["times"].select("trial_id", "scale_a", "offset_b").join(run["spatial"].select("trial_id", "theta_rad", "tx", "ty"), "trial_id")


def _aligned(run: Run) -> DataFrame:
    return alignment.align(_good(run, "telemetry_rows"), _good(run, "tracking_rows"), run["params"], run.settings)


def _metrics(run: Run) -> DataFrame:
    s = run.settings
    held = comparisons.held_out(run["aligned"])
    base = held.groupBy("trial_id").agg(*metrics.ate(F.col("residual_norm")))
    robust = metrics.robust(held, "residual_norm", s)
    rpe = metrics.describe_errors(metrics.rpe_by_time(held, s, time="t_common_s"), "rpe", "rpe")
    trials = run["accepted"].join(run["degeneracy"].select("trial_id", "degeneracy_status"), "trial_id", "left").join(run["times"].select("trial_id", "temporal_status", F.col("b_final").alias("temporal_offset_s"), "clock_model", "scale_a"), "trial_id", "left")
    out = trials.join(base, "trial_id", "left").join(robust, "trial_id", "left").join(rpe, "trial_id", "left").join(run["spatial"].select("trial_id", F.col("trajectory_residual").alias("spatial_fit_residual")), "trial_id", "left")
    status = F.when(F.col("degeneracy_status") != "ok", F.col("degeneracy_status")).when(F.coalesce("num_samples", F.lit(0)) == 0, "no_common_samples").when(finite(F.col("ate_rmse")).isNull(), "failed_metric_computation").otherwise("success")
    scored = support.common_support({"final": held}, comparisons.KEY, ["trial_id"]).select("trial_id", F.col("common_support_hash").alias("support_hash"))
    out = out.join(scored, "trial_id", "left")
    return out.withColumn("status", status).withColumns({"rmse_mm": F.col("ate_rmse") * 1000, "accepted_for_hypothesis_tests": F.col("status") == "success"})


def _phases(run: Run) -> DataFrame:
    return metrics.by_phase(comparisons.held_out(run["aligned"]), "residual_norm", "movement_phase")


def _streams(run: Run) -> tuple[DataFrame, DataFrame]:
    return _good(run, "telemetry_rows"), _good(run, "tracking_rows")


def _baseline_arm(run: Run) -> DataFrame:
    return comparisons.baseline(*_streams(run), run["times"], run["aligned"], run["accepted"], run.settings)


def _scored(run: Run) -> DataFrame:
    """Metrics of the trials that have them, with their parameters and the diagnostics that scenarios are described by."""
    m = run["metrics"].filter("status = 'success'").select("trial_id", "scenario_id", "dataset_tier", "rmse_mm", (F.col("ate_mean") * 1000).alias("ate_mm"), (F.col("rpe_rmse") * 1000).alias("rpe_mm"), "temporal_status")
    params = run["params"].select("trial_id", F.col("offset_b").alias("offset_s"), "theta_rad", "tx", "ty")
    gaps = run["diagnostics"].filter("stream = 'ev3'").select("trial_id", "irregularity")
    fits = run["times"].select("trial_id", F.col("ratio").alias("peak_ratio"))
    residual = run["spatial"].select("trial_id", (F.col("trajectory_residual") * 1000).alias("fit_rmse_mm"))
    for side in (params, gaps, fits, residual):
        m = m.join(side, "trial_id", "left")
    return m


def _timestamp_gaps(run: Run) -> DataFrame:
    some = run["metrics"].select("trial_id")
    return asof.gap_report(*(run[n].join(some, "trial_id", "left_semi") for n in ("telemetry", "tracking")))


def _h1_audit(run: Run) -> DataFrame:
    """The ranks that the H1 test rests on, a row for each trial and population."""
    rows = comparisons.h1_eligible(run["h1"]).filter("why_not is null").join(comparisons.populations(run["accepted"]), "trial_id")
    return statistics.signed_rank_rows(rows.select("trial_id", "population", "onset_rmse_mm", "refined_rmse_mm"), "onset_rmse_mm", "refined_rmse_mm", ["population"])


def _compatible(run: Run) -> DataFrame:
    """The gate of the extended tier, for its paired trials."""
    extended = run["pairs"].filter("pair_status = 'paired' and dataset_tier = 'extended_previous_paper'").select("trial_id")
    e, v = (extended.join(run["diagnostics"].filter(F.col("stream") == n).drop("stream"), "trial_id", "left") for n in ("ev3", "vrmt"))
    return quality.compatibility_issues(e, v, run.settings)


def _lag_curves(run: Run) -> DataFrame:
    """What the correlation of the two streams was at each lag, over the calibration rows."""
    s = run.settings
    cal = [_good(run, n).filter("partition = 'calibration'") for n in ("telemetry_rows", "tracking_rows")]
    if s.telemetry_proxy not in cal[0].columns or s.tracking_proxy not in cal[1].columns:
        return _nothing(run, "trial_id string, lag_s double, score double, overlap_s double, status string")
    return alignment.correlation_curve(*cal, s, s.telemetry_proxy, s.tracking_proxy, "local_time_s", "relative_time_s")


def _schema(run: Run) -> DataFrame:
    """Types, rows and NULLs of the columns of the cleaned streams and the metrics."""
    reports = [sinks.schema_report(run[p]).withColumn("product", F.lit(p)) for p in ("telemetry", "tracking", "metrics")]
    return reduce(DataFrame.unionByName, reports)


#: What trials are summarised by, and the figures that are.
SUMMARISED = ("rmse_mm", "ate_rmse_mm", "rpe_rmse_mm", "heading_rmse_deg")


def _summary(run: Run) -> DataFrame:
    """Overall, by tier, drive, route and scenario."""
    m = run["metrics"].filter("status = 'success'")
    parts = F.split("scenario_id", "_")
    heading = F.degrees("heading_rmse") if "heading_rmse" in m.columns else F.lit(None).cast("double")
    m = m.withColumns({"drive_id": F.get(parts, F.lit(0)), "route_id": F.get(parts, F.lit(1)), "ate_rmse_mm": F.col("ate_rmse") * 1000, "rpe_rmse_mm": F.col("rpe_rmse") * 1000, "heading_rmse_deg": heading})
    return metrics.group_summary(m, ["dataset_tier", "drive_id", "route_id", "scenario_id"], SUMMARISED)


def _phase_summary(run: Run) -> DataFrame:
    return metrics.group_summary(run["phases"].withColumn("rmse_mm", F.col("phase_rmse") * 1000), ["movement_phase"], ["rmse_mm"])


def _balance(run: Run) -> DataFrame:
    cells = lambda df: df.select(F.split("trial_id", "_")[0].alias("drive_id"), F.split("trial_id", "_")[1].alias("route_id"))
    return gates.balance(gates.design_grid(run.spark), cells(run["pairs"].filter("trial_id is not null")), cells(run["accepted"]))


def _gate_ledger(run: Run) -> DataFrame:
    made = lambda n: run[n] if n in run.made else None  # noqa: E731 - evidence is what this run has made
    times = run["times"]
    evidence = {
        "quality_accepted": run["rejections"], "calibration_non_degenerate": run["degeneracy"], "temporal_valid": times.withColumnRenamed("temporal_status", "status"), "clock_valid": times.withColumnRenamed("clock_model", "selected_model"),
        "final_alignment_valid": run["metrics"], "baseline_valid": made("baseline"), "H1_eligible": made("h1"), "H2_all_four_arm_eligible": made("h2"), "H3_both_arm_eligible": made("h3"),
    }
    return gates.gate_ledger(run["pairs"], gates.gate_members(run["pairs"], evidence))


def _cascade(run: Run) -> DataFrame:
    """The hash that the metrics were stored with against one of the aligned rows that the ledger has as evaluation rows, computed anew."""
    held = comparisons.held_out(run["aligned"])
    known = run["ledger"].filter((F.col("stream") == "ev3") & is_evaluation(F.col("partition"))).select("trial_id", F.explode("source_rows").alias("source_row_index"))
    fresh = support.common_support({"final": held, "ledger": known}, comparisons.KEY, ["trial_id"])
    found = run["metrics"].select("trial_id", "support_hash").join(fresh.select("trial_id", F.col("common_support_hash").alias("expected_hash")), "trial_id", "left")
    found = found.join(support.validate(held, comparisons.KEY, ["trial_id"]).select("trial_id", "support_status"), "trial_id", "left")
    return gates.cascade(run["gate_ledger"], run["metrics"].select("trial_id", "rmse_mm", "status"), found.withColumns({"support_status": F.coalesce("support_status", F.lit("empty")), "expected_hash": F.coalesce("expected_hash", F.lit(""))}))


PRODUCTS: dict[str, Callable[[Run], DataFrame]] = {
    "manifest": lambda r: logs.manifest(r.spark, r.inputs, r.settings),
    "pairs": lambda r: logs.pairs(r["manifest"]),
    "telemetry": _telemetry,
    "tracking": _tracking,
    "diagnostics": _diagnostics,
    "rejections": _rejections,
    "accepted": _accepted,
    "bounds": _bounds,
    "telemetry_rows": lambda r: _split(r, "telemetry"),
    "tracking_rows": lambda r: _split(r, "tracking"),
    "ledger": lambda r: comparisons.ledger_of(r["telemetry_rows"], r["tracking_rows"]),
    "degeneracy": _degeneracy,
    "times": _times,
    "spatial": _spatial,
    "params": _params,
    "aligned": _aligned,
    "metrics": _metrics,
    "phases": _phases,
    "schema": _schema,
    "h1": lambda r: comparisons.h1(*_streams(r), r["times"], r.settings),
    "h2": lambda r: comparisons.h2(*_streams(r), r["params"], r.settings),
    "h3": lambda r: comparisons.h3(*_streams(r), r["bounds"], r["ledger"], r.settings),
    "baseline_arm": _baseline_arm,
    "baseline": lambda r: r["baseline_arm"].filter("reason is null").drop("reason", "canonical_support_count"),
    "baseline_rejections": lambda r: r["baseline_arm"].filter("reason is not null").select("trial_id", "dataset_tier", "reason", F.col("common_support_count").alias("baseline_common_support_count"), "canonical_support_count"),
    "baseline_summary": lambda r: comparisons.baseline_summary(r["baseline"]),
    "h1_summary": lambda r: comparisons.h1_summary(r["h1"]),
    "h1_audit": _h1_audit,
    "timestamp_gaps": _timestamp_gaps,
    "query_times": lambda r: asof.query_time_report(r["aligned"], r["metrics"]),
    "compatible": _compatible,
    "summary": _summary,
    "repeatability": lambda r: metrics.scenario_repeatability(_scored(r)),
    "stability": lambda r: metrics.parameter_stability(_scored(r)),
    "robustness": lambda r: metrics.scenario_robustness(_scored(r)),
    "variance": lambda r: metrics.variance_decomposition(r["metrics"].filter("status = 'success'"), "rmse_mm", "scenario_id"),
    "balance": _balance,
    "design_trials": lambda r: gates.design_trials(r["pairs"], r["rejections"], r["metrics"].filter("status = 'success'")),
    "design_missing": lambda r: gates.design_missing(gates.design_grid(r.spark), r["design_trials"]),
    "design_overview": lambda r: gates.design_overview(gates.design_grid(r.spark), r["design_trials"]),
    "scenario_catalog": lambda r: gates.scenario_catalog(gates.design_grid(r.spark)),
    "phase_summary": _phase_summary,
    "lag_curves": _lag_curves,
    "gate_ledger": _gate_ledger,
    "gate_pivot": lambda r: gates.gate_pivot(r["gate_ledger"], ["planned_405", "extended_previous_paper"]),
    "cascade": _cascade,
    "stage_summary": lambda r: gates.stage_summary(r["cascade"]),
    "inference": lambda r: comparisons.inference(r["h1"], r["h2"], r["h3"], r["accepted"]),
    "conclusions": lambda r: comparisons.conclusion_stability(r["inference"]),
    "friedman": lambda r: comparisons.h2_friedman(r["h2"], r["accepted"]),
    "posthoc": lambda r: comparisons.h2_posthoc(r["h2"], r["accepted"]),
}
#: Products that are read to make a product.
READS: dict[str, str] = {
    "pairs": "manifest", "telemetry": "pairs", "tracking": "pairs", "diagnostics": "telemetry tracking", "rejections": "diagnostics pairs", "accepted": "pairs rejections", "bounds": "telemetry accepted",
    "telemetry_rows": "telemetry bounds", "tracking_rows": "tracking bounds", "ledger": "telemetry_rows tracking_rows", "degeneracy": "telemetry_rows tracking_rows bounds", "times": "degeneracy", "spatial": "times",
    "params": "times spatial", "aligned": "params", "metrics": "aligned accepted spatial", "phases": "aligned", "schema": "metrics", "h1": "times", "h2": "params", "h3": "bounds ledger", "baseline_arm": "aligned accepted times",
    "baseline": "baseline_arm", "baseline_rejections": "baseline_arm", "baseline_summary": "baseline", "h1_summary": "h1", "h1_audit": "h1 accepted", "timestamp_gaps": "metrics telemetry tracking", "query_times": "aligned metrics", "compatible": "pairs diagnostics", "summary": "metrics", "repeatability": "metrics params", "stability": "metrics params", "robustness": "metrics times diagnostics",
    "variance": "metrics", "balance": "pairs accepted", "design_trials": "pairs rejections metrics", "design_missing": "design_trials", "design_overview": "design_trials", "phase_summary": "phases", "lag_curves": "degeneracy", "gate_ledger": "pairs rejections degeneracy times metrics", "gate_pivot": "gate_ledger", "cascade": "gate_ledger metrics ledger", "stage_summary": "cascade",
    "inference": "h1 h2 h3 accepted", "conclusions": "inference", "friedman": "h2 accepted", "posthoc": "h2 accepted",
}
#: What each result consists of. Every run has the core; what is presented is drawn from all the others.
RESULTS: dict[str, str] = {
    "core": "metrics phases ledger schema",
    "h1": "h1 h1_summary h1_audit",
    "h2": "h2 friedman posthoc",
    "h3": "h3",
    "baseline": "baseline baseline_rejections baseline_summary",
    "diagnostics": "gate_ledger gate_pivot cascade stage_summary compatible summary repeatability stability robustness variance balance design_trials design_missing design_overview scenario_catalog phase_summary lag_curves timestamp_gaps query_times",
    "tables": "inference conclusions",
    "figures": "inference",
    "report": "inference",
}
PRESENTED = ("tables", "figures", "report")
#: After these products a run without a row can't go on.
POPULATIONS = {"accepted": "no accepted trial", "times": "no trial with parameters", "metrics": "no eligible metric"}


@dataclass(frozen=True)
class Selection:
    """Results by name, and the products to make for them in order."""

    results: tuple[str, ...]
    products: tuple[str, ...]

    @staticmethod
    def of(text: str) -> Selection:
        """From a comma-separated list; ``all`` stands for every result and for itself alone."""
        asked = [x for x in map(str.strip, text.split(",")) if x]
        if strange := [x for x in asked if x != "all" and x not in RESULTS]:
            raise ValueError(f"no such result: {' '.join(strange)}; there are {' '.join(RESULTS)} and all")
        if not asked or ("all" in asked and set(asked) != {"all"}):
            raise ValueError("name one result or more, or all by itself")
        wide = "all" in asked or any(x in PRESENTED for x in asked)
        chosen = [x for x in RESULTS if x == "core" or x in asked or (wide and (x not in PRESENTED or "all" in asked))]
        reached, open_ = set(), [p for x in chosen for p in RESULTS[x].split()]
        while open_:
            product = open_.pop()
            if product not in reached:
                reached.add(product)
                open_ += READS.get(product, "").split()
        # PRODUCTS lists every product after those it reads.
        return Selection(tuple(chosen), tuple(p for p in PRODUCTS if p in reached))


class Folder:
    """Small files of a run, written and read by Spark's own file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.root = folder.rstrip("/") if "://" in folder or folder.startswith("file:") else Path(folder).resolve().as_uri()
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def empty(self) -> bool:
        return not self._fs.exists(self._path("")) or not len(self._fs.listStatus(self._path("")))

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()


def execute(spark: SparkSession, inputs: dict[str, str], folder: str, results: str = "core", settings: Settings | None = None, frozen: bool = False) -> Run:
    """Run a selection into an empty folder. status.json says RUNNING, PASS or FAILED with the reason; provenance.json has an entry for each
    product. ``frozen``: only paths and config_id of the settings may differ from the defaults."""
    s = settings or Settings()
    comparisons.check_policies()
    if frozen:
        check_frozen(s)
    chosen = Selection.of(results)
    out = Folder(spark, folder)
    local = lambda p: Path(str(p).removeprefix("file://"))
    if out.root.startswith("file:"):
        check_folders([local(p) for p in inputs.values()], local(out.root))
    if not out.empty():
        raise ValueError(f"{folder} is not empty")
    text = json.dumps(asdict(s), sort_keys=True, default=str)
    out.write("settings.json", text)
    head = {"settings_sha256": hashlib.sha256(text.encode()).hexdigest(), "spark": spark.version, "python": platform.python_version(), "results": list(chosen.results)}
    out.write("software.json", json.dumps({"python": platform.python_version(), "platform": platform.platform()} | {p: metadata.version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")}, sort_keys=True))
    status = lambda **x: out.write("status.json", json.dumps(x | head, sort_keys=True))
    status(status="RUNNING")
    run, record = Run(spark, dict(inputs), f"{out.root}/products", s), []
    not_made = [{"product": p, "status": "not_applicable"} for p in PRODUCTS if p not in chosen.products]
    try:
        for name in chosen.products:
            df = run[name]
            record.append({"product": name, "status": "made", "reads": READS.get(name, "").split(), "columns": df.columns, "at": datetime.datetime.now(datetime.UTC).isoformat(), "config_id": s.config_id})
            out.write("provenance.json", json.dumps(record + not_made, indent=1))
            if name in POPULATIONS and (run["metrics"].filter("accepted_for_hypothesis_tests") if name == "metrics" else df).isEmpty():
                raise RunError(POPULATIONS[name])
        if "tables" in chosen.results:
            for table_name, df in tables(run.made).items():
                sinks.write_csv(df, f"{out.root}/tables/{table_name}", df.columns[:1], table_name not in PER_TRIAL)
        sinks.write_json(run["times"], f"{out.root}/parameters/temporal")
        sinks.write_json(run["spatial"], f"{out.root}/parameters/spatial")
        if "lag_curves" in run.made:
            sinks.write_json(run["lag_curves"], f"{out.root}/parameters/correlation")
        if "inference" in run.made:
            # Of the shared table of tests, each hypothesis gets its own part.
            for h in ("H1", "H2", "H3"):
                sinks.write_csv(run["inference"].filter(F.col("hypothesis_id") == h), f"{out.root}/hypotheses/{h}", ["population"])
        if "figures" in chosen.results:
            write_figures(run, out)
        if "report" in chosen.results:
            sections = reported(run.made)
            out.write("report.md", sinks.markdown("Trial alignment", sections))
            out.write("report.html", sinks.html("Trial alignment", sections))
        for name in chosen.results:
            validate_family(run, name)
        # Files are hashed by tasks; a name, a size and a hash of each come here.
        index = [r.asDict() for r in sinks.file_hashes(spark, out.root).filter("file not like 'status%' and file not like 'provenance%'").orderBy("file").collect()]
        out.write("index.json", json.dumps(index, indent=1))
        for entry in record:
            own = "".join(f"{r['file']} {r['sha256']}\n" for r in index if r["file"].startswith(f"products/{entry['product']}/"))
            entry["outputs_sha256"] = hashlib.sha256(own.encode()).hexdigest()
        of = {e["product"]: e["outputs_sha256"] for e in record}
        out.write("provenance.json", json.dumps([e | {"inputs_sha256": {r: of[r] for r in e["reads"]}} for e in record] + not_made, indent=1))
    except Exception as e:
        status(status="FAILED", reason=str(e)[:500])
        raise
    status(status="PASS")
    return run


#: What a reader of a published family should know of it.
FAMILIES = {
    "core": "Held-out metrics of every trial, by phase, with the ledger that says which rows were held out.", "h1": "Onset against refined time offset.", "h2": "Four reference operators on the same held-out rows.",
    "h3": "Fits without and with the rows that are scored; the second arm leaks on purpose.", "baseline": "The plain alignment against the final one, by population.", "diagnostics": "Gates, design, repeatability and robustness.",
}


def publish(run: Run, target: str, families: Sequence[str]) -> list[dict]:
    """Copy the products of result families as tables to ``target``/family/product, check every copy by its number of rows and its content, and write an index and a
    guide. Tables go from task to task; a family that was published there before is an error, as nothing that is published changes."""
    if strange := [f for f in families if f not in FAMILIES]:
        raise ValueError(f"no such family: {' '.join(strange)}; there are {' '.join(FAMILIES)}")
    out = Folder(run.spark, target)
    rows: list[dict] = []
    for family in families:
        if not Folder(run.spark, f"{out.root}/{family}").empty():
            raise ValueError(f"{family} is published in {target} already")
        validate_family(run, family)
        for product in RESULTS[family].split():
            path = f"{out.root}/{family}/{product}"
            run[product].write.parquet(path)
            own, copy = (sinks.content_hash(df).first().asDict() for df in (run[product], run.spark.read.parquet(path)))
            if own != copy:
                raise RunError(f"{family}: the copy of {product} differs: {copy} is not {own}")
            rows.append({"family": family, "product": product, "columns": run[product].columns} | own)
    guide = [f"# Published results\n\nSettings: {run.settings.config_id}. Tables are Parquet; The index has the number of rows and the content hash of each.\n"]
    for family in families:
        guide.append(f"## {family}\n\n{FAMILIES[family]}\n")
        guide += [f"* `{family}/{r['product']}`: {r['rows']} rows of {', '.join(r['columns'])}" for r in rows if r["family"] == family]
    # Earlier families have files of their own beside these.
    name = "-".join(families)
    out.write(f"index-{name}.json", json.dumps(rows, indent=1))
    out.write(f"guide-{name}.md", "\n".join(guide) + "\n")
    return rows


def write_figures(run: Run, out: Folder) -> None:
    """Of every declared figure its extract, the cells of that with hashes, and a chart description; and a manifest that says which have rows."""
    manifest = []
    for f in figures(run.made):
        applies = f.extract is not None and not f.extract.isEmpty()
        manifest.append({"figure_id": f.figure_id, "title": f.title, "source": f.source, "mark": f.mark, "status": "available" if applies else "not_applicable"})
        if applies:
            sinks.write_csv(f.extract, f"{out.root}/figures/{f.figure_id}", f.extract.columns[:1])
            sinks.cells(f.extract, f.figure_id, f.source, out.root).write.parquet(f"{out.root}/figures/cells/{f.figure_id}")
            out.write(f"figures/{f.figure_id}.json", chart(f.mark, f.x, f.y, f.title))
    out.write("figures/manifest.json", json.dumps(manifest, indent=1))
    if not any(x["status"] == "available" for x in manifest):
        raise RunError("no figure has a row to show")


#: Columns that readers of a product count on.
CONTRACTS = {
    "gate_ledger": "trial_id string, dataset_tier string, gate string, gate_status string, reason string",
    "cascade": "trial_id string, dataset_tier string, stage string, score_mm double, valid boolean, reason string",
    "metrics": "trial_id string, rmse_mm double, status string, accepted_for_hypothesis_tests boolean, support_hash string",
    "h1": "trial_id string, delta_rmse_mm double, common_support_hash string, valid_for_paper boolean, reason string",
    "h2": "trial_id string, method string, rmse_mm double, common_support_hash string, status string",
    "h3": "trial_id string, calibration_mode string, heldout_rmse_mm double, delta_rmse_mm double, common_support_hash string, valid_for_paper boolean",
    "baseline": "trial_id string, baseline_rmse_mm double, final_rmse_mm double, delta_rmse_mm double, common_support_hash string",
}


def validate_family(run: Run, result: str) -> None:
    """What a published result must hold: its products made, one row for each trial (and arm), and scores only where rows are valid."""
    for product in RESULTS[result].split():
        if product not in run.made:
            raise RunError(f"{result}: {product} was not made")
        if product in CONTRACTS:
            logs.contract(run[product], product, CONTRACTS[product])
    keys = {"metrics": ["trial_id"], "h1": ["trial_id"], "h2": ["trial_id", "method"], "h3": ["trial_id", "calibration_mode"], "baseline": ["trial_id"], "cascade": ["trial_id", "stage"], "gate_ledger": ["trial_id", "gate"]}
    for product in set(RESULTS[result].split()) & set(keys):
        if not run[product].groupBy(*keys[product]).count().filter("count > 1").isEmpty():
            raise RunError(f"{result}: {product} repeats {', '.join(keys[product])}")
    scores = {"h1": "valid_for_paper and delta_rmse_mm is null", "h3": "valid_for_paper and heldout_rmse_mm is null", "h2": "status = 'success' and rmse_mm is null", "baseline": "delta_rmse_mm is null", "cascade": "valid and score_mm is null"}
    for product in set(RESULTS[result].split()) & set(scores):
        if not run[product].filter(scores[product]).isEmpty():
            raise RunError(f"{result}: {product} has valid rows without a score")


def main(argv: list[str] | None = None) -> int:
    import argparse

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--telemetry", required=True)
    parser.add_argument("--tracking", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--results", default="core")
    parser.add_argument("--settings")
    parser.add_argument("--frozen", action="store_true")
    parser.add_argument("--publish", help="folder to copy result families to")
    parser.add_argument("--families", default="core", help="families to publish, comma-separated")
    args = parser.parse_args(argv)
    from gaugeline.config import load

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run = execute(spark, {"ev3": args.telemetry, "vrmt": args.tracking}, args.output, args.results, load(args.settings), args.frozen)
        if args.publish:
            publish(run, args.publish, args.families.split(","))
    except (RunError, ValueError) as e:
        print(e)
        return 1
    return 0
