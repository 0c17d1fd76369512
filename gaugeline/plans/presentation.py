"""Tables, box summaries, histograms and charts' data for the report; figures are data with a small chart description."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.columns import truthy
from gaugeline.operators.cleaning import ordered
from gaugeline.sources.sinks import flat


def histogram(df: DataFrame, column: str, bins: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of equal width between the extremes: one pass for these, one for the counts."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.groupBy(*group).agg(F.lit(0).alias("bin"), F.lit(None).cast("double").alias("low"), F.count(column).alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(*group, place.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.lit(float(low)) + F.col("bin") * width)


def box(df: DataFrame, column: str, group: Sequence[str]) -> DataFrame:
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.groupBy(*group).agg(q.alias("q"), F.count(column).alias("n")).select(*group, "n", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("low", "q1", "median", "q3", "high"))])


def heatmap(df: DataFrame, row: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def closest_to_median(df: DataFrame, column: str) -> DataFrame:
    """The row whose value is nearest to the median; ties to the first trial."""
    return df.crossJoin(df.agg(F.median(column).alias("__m"))).filter(F.col(column).isNotNull()).orderBy(F.abs(F.col(column) - F.col("__m")), "trial_id").limit(1).drop("__m")


def thinned(df: DataFrame, every: int = 10, time: str = "t") -> DataFrame:
    """Each trial's first row and every so-manieth after it, for plots of long series."""
    return df.withColumn("__k", F.row_number().over(ordered(time))).filter((F.col("__k") - 1) % every == 0).drop("__k")


def by_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def chart(mark: str, x: str, y: str, title: str) -> str:
    """A chart description that common viewers of declarative charts read; the data is the extract of the same name."""
    return json.dumps({"title": title, "mark": mark, "encoding": {"x": {"field": x}, "y": {"field": y, "type": "quantitative"}}}, sort_keys=True)


@dataclass(frozen=True)
class Figure:
    """A declared figure: what it shows, from which product, and its extract (None if that product wasn't made)."""

    figure_id: str
    title: str
    source: str
    mark: str
    x: str
    y: str
    extract: DataFrame | None


def eligible(df: DataFrame) -> DataFrame:
    """Rows that may be plotted: by the valid flag where there is one, else by their status."""
    if "valid_for_paper" in df.columns:
        return df.filter(truthy(F.col("valid_for_paper").cast("string")))
    return df.filter(F.lower("status").isin("ok", "success", "valid", "accepted")) if "status" in df.columns else df


def is_placeholder(df: DataFrame) -> bool:
    """A table without rows, or whose every cell is empty or a word that stands for nothing."""
    blank = [F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin("", "none", "nan", "n/a", "placeholder") for c in df.columns]
    return bool(df.agg(F.coalesce(F.bool_and(reduce(Column.__and__, blank)), F.lit(True))).first()[0])


def figures(made: Mapping[str, DataFrame]) -> list[Figure]:
    """The ten declared figures, as extracts for charts."""
    cell = lambda df: df.withColumns({"drive_id": F.split("scenario_id", "_")[0], "route_id": F.split("scenario_id", "_")[1]})
    take = lambda name, f: f(made[name]) if name in made else None
    routes = [f"T{k}" for k in range(1, 10)]
    return [
        Figure("dataset_design", "Trials of each cell of the design", "balance", "rect", "route_id", "nominal", take("balance", lambda d: d.select("drive_id", "route_id", "nominal", "discovered"))),
        Figure("accepted_trials", "Accepted trials of each cell", "balance", "rect", "route_id", "accepted", take("balance", lambda d: d.select("drive_id", "route_id", "accepted", "complete"))),
        Figure("repeatability", "Spread of the error over repetitions", "repeatability", "rect", "route_id", "cv_rmse", take("repeatability", lambda d: cell(d).select("scenario_id", "drive_id", "route_id", "mean_rmse_mm", "cv_rmse", "status"))),
        Figure("cascade_example", "The trial nearest to the median error, by stage", "cascade", "bar", "stage", "score_mm", take("cascade", lambda d: d.join(closest_to_median(d.filter("valid"), "score_mm").select("trial_id"), "trial_id", "left_semi").select("trial_id", "stage", "score_mm"))),
        Figure("cascade_reduction", "Mean error by stage", "stage_summary", "bar", "stage", "mean_mm", made.get("stage_summary")),
        Figure("scenario_heatmap", "Mean error by drive and route", "robustness", "rect", "drive_id", "T1", take("robustness", lambda d: heatmap(cell(d), "drive_id", "route_id", routes, "mean_rmse_mm"))),
        Figure("h1", "Onset against refined offset", "h1", "bar", "trial_id", "delta_rmse_mm", take("h1", lambda d: eligible(d).select("trial_id", "delta_rmse_mm"))),
        Figure("h2", "Error by reference operator", "h2", "boxplot", "method", "median", take("h2", lambda d: box(eligible(d), "rmse_mm", ["method"]))),
        Figure("h3", "Fit without and with the rows that are scored", "h3", "bar", "trial_id", "heldout_rmse_mm", take("h3", lambda d: eligible(d).select("trial_id", "calibration_mode", "heldout_rmse_mm"))),
        Figure("error_distribution", "Distribution of the error", "metrics", "bar", "low", "n", take("metrics", lambda d: histogram(eligible(d), "rmse_mm"))),
    ]


#: Tables with a row for each trial, and the products that stand for them in a report.
PER_TRIAL = {"metrics": "summary", "baseline": "baseline_summary"}


def reported(made: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """tables() for a report, whose rows are listed: those with a row for each trial are replaced by their summaries, or left out."""
    out = {}
    for name, df in tables(made).items():
        stand_in = made.get(PER_TRIAL.get(name, ""))
        if name not in PER_TRIAL:
            out[name] = df
        elif stand_in is not None:
            out[name] = flat(stand_in)
    return out


def tables(made: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The presentation tables that a run's products allow."""
    out: dict[str, DataFrame] = {}
    if "pairs" in made:
        out["dataset"] = made["pairs"].groupBy("dataset_tier", "pair_status").agg(F.count("*").alias("trials"))
    if "rejections" in made:
        out["rejections"] = made["rejections"].groupBy("reason").agg(F.count_distinct("trial_id").alias("trials"))
    if "metrics" in made:
        m = made["metrics"].filter("status = 'success'")
        out["metrics"] = m.select("trial_id", "rmse_mm", "ate_mean", "p95", "rpe_rmse", "temporal_offset_s", "spatial_fit_residual")
        out["metric_spread"] = box(m, "rmse_mm", ["dataset_tier"])
        out["temporal_cases"] = made["metrics"].filter("temporal_status is not null and temporal_status <> 'ok'").groupBy("temporal_status").agg(F.count("*").alias("trials"))
    if "h2" in made:
        out["methods"] = made["h2"].filter("status = 'success'").groupBy("method").agg(F.avg("rmse_mm").alias("mean_rmse_mm"), F.count("*").alias("trials"))
    if "baseline" in made:
        out["baseline"] = made["baseline"].select("trial_id", "baseline_rmse_mm", "final_rmse_mm", "delta_rmse_mm")
    if "inference" in made:
        out["decisions"] = made["inference"].select("hypothesis_id", "population", "n", "p_value", "p_adjusted", "decision")
    if "gate_ledger" in made:
        out["gates"] = made["gate_ledger"].filter("gate_status = 'passed'").groupBy("gate").agg(F.count_distinct("trial_id").alias("trials"))
    if "stage_summary" in made:
        out["stages"] = made["stage_summary"]
    if "h3" in made:
        out["modes"] = eligible(made["h3"]).groupBy("calibration_mode").agg(F.avg("heldout_rmse_mm").alias("mean_rmse_mm"), F.count("*").alias("trials"))
    return out
