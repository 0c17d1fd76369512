"""Writers of tables, evidence and presentation extracts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.columns import finite, value_type

CLOCK_FIELDS = ("trial_id", "selected_model", "scale_a", "offset_b", "candidate_scale_a", "candidate_offset_b", "temporal_refinement_delta_s", "affine_improvement_ratio", "constant_mse", "affine_mse", "candidate_hit_bound", "reason")
CLOCK_REQUIRED = ("trial_id", "selected_model", "scale_a", "offset_b")


def flat(df: DataFrame) -> DataFrame:
    """Columns that text formats can hold: arrays, maps and structs as JSON, non-finite numbers as NULL."""
    return df.select(*[(F.to_json(c) if kind.startswith(("array", "map", "struct")) else finite(F.col(c)) if kind in ("float", "double") else F.col(c)).alias(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, sort: Sequence[str] = (), one_file: bool = True) -> None:
    """CSV with a header, in order. Ledgers that are aggregates go to one file; a table with a row for each trial (``one_file=False``) to files of
    consecutive ranges. An empty table is an empty file with its header."""
    out = flat(df)
    if sort:
        out = out.orderBy(*sort)
    (out.coalesce(1) if sort and one_file else out).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, drop: Sequence[str] = ()) -> None:
    """A JSON object for each row, NULL fields included; non-finite numbers are NULL."""
    kept = df.drop(*drop)
    kept.select(*[(finite(F.col(c)) if kind in ("float", "double") else F.col(c)).alias(c) for c, kind in kept.dtypes]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_trials(df: DataFrame, path: str, key: str = "trial_id") -> None:
    """Parquet with a folder for each trial, so that reads of some trials skip the others; rows of a trial are dealt by it first."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)


def schema_report(df: DataFrame) -> DataFrame:
    """A row for each column: type, rows and NULLs, from one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"c{k}") for k, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), F.col(f"c{k}").alias("null_count")) for k, (c, kind) in enumerate(df.dtypes)])
    return counts.select("rows", F.inline(items)).select("column", "dtype", F.col("rows").alias("row_count"), "null_count")


def clock_export(df: DataFrame) -> DataFrame:
    """The clock contract: its fields in order, required ones not NULL, one row a trial, sorted by it; else an error."""
    if missing := [c for c in CLOCK_FIELDS if c not in df.columns]:
        raise ValueError(f"clock export lacks {', '.join(missing)}")
    bad = df.agg(F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in CLOCK_REQUIRED]) == 1).alias("null"), (F.count("*") - F.count_distinct("trial_id")).alias("repeated")).first()
    if bad["null"] or bad["repeated"]:
        raise ValueError(f"clock export has {bad['null']} incomplete and {bad['repeated']} repeated rows")
    return df.select(*CLOCK_FIELDS).orderBy("trial_id")


def normalise_path(c: Column, run: str) -> Column:
    """The run's folder in a provenance cell becomes <RUN_ROOT>."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("/")), F.lit(run.rstrip("/")), F.lit("<RUN_ROOT>"))


def cells(df: DataFrame, figure: str, source: str, run: str = "") -> DataFrame:
    """One row for each cell of a presentation extract, with the hash of its row."""
    texts = {c: normalise_path(F.col(c).cast("string"), run) if run else F.col(c).cast("string") for c in df.columns}
    row_hash = F.sha2(F.to_json(F.struct(*[t.alias(c) for c, t in texts.items()]), {"ignoreNullFields": "false"}), 256)
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("column_index"), t.alias("value_text"), value_type(t).alias("value_type")) for k, (c, t) in enumerate(texts.items())])
    return df.select(F.lit(figure).alias("figure_id"), F.lit(source).alias("source"), row_hash.alias("row_sha256"), F.inline(items))


# ------------------------------------------------------------------ evidence


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """file (its path from the folder), bytes and sha256 of every file below a folder: read and hashed by tasks, a file in each, in any store that Spark reads. Files without
    a byte aren't read by Spark and have no row."""
    root = re.sub("^file:/+", "file:/", folder).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/+", "file:/")
    return files.select(F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 4096)).otherwise(path).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_hash(df: DataFrame) -> DataFrame:
    """rows and content: the number of rows, and a hash that equal tables share whatever the order and the files of their rows."""
    row = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in df.columns])
    both = df.select(row.alias("a"), F.xxhash64(F.lit(1), row).alias("b"))
    parts = [F.lower(F.hex(F.bit_xor(c))) for c in ("a", "b")] + [F.sum(F.col("a").cast("decimal(38,0)")).cast("string")]
    return both.agg(F.count("*").alias("rows"), F.concat_ws(":", *parts).alias("content"))


def sha256_file(path: Path | str) -> str:
    """Of one local file."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _cells(df: DataFrame) -> list[list[str]]:
    """All rows of a presentation table as text: tables of a report are aggregates."""
    return [["" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in df.toLocalIterator()]


def markdown(title: str, sections: Mapping[str, DataFrame]) -> str:
    """A report of presentation tables, with all their rows."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in _cells(df)] + [""]
    return "\n".join(out)


def html(title: str, sections: Mapping[str, DataFrame]) -> str:
    """The same report as a page."""
    out = ["<!DOCTYPE html>", f"<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body>", f"<h1>{escape(title)}</h1>"]
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(x)}</{tag}>" for x in values) + "</tr>"
    for name, df in sections.items():
        out += [f"<h2>{escape(name)}</h2>", "<table>", row("th", df.columns), *(row("td", r) for r in _cells(df)), "</table>"]
    return "\n".join([*out, "</body></html>"])
