"""File manifests, trial pairing and the raw log readers. Everything is a scan and an aggregate over files or records; no file is opened on the driver."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.config import Settings
from gaugeline.sources import records

MANIFEST = "file_path string, file_name string, trial_id string, stream_type string, parsed_drive string, parsed_route string, parsed_date string, parsed_time string, file_size long, detected_columns int, file_checksum string, parser_status string"
#: Columns of the headerless tracker log, as it is written.
TRACKER_COLUMNS = ("timestamp", "logger", "level", "x", "y", "z", "roll", "pitch", "yaw", "qx", "qy", "qz", "qw", "extra1", "extra2")


def manifest(spark: SparkSession, folders: dict[str, str], s: Settings) -> DataFrame:
    """One row for each CSV file below the folders (stream -> folder); a folder that is missing gives no rows.

    Files are hashed where they are read; a file is one row of the scan, so logs should be of ordinary size.
    """
    found = {}
    for stream, folder in folders.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            found[stream] = one_slash(str(fs.makeQualified(path).toString()))
    if not found:
        return spark.createDataFrame([], MANIFEST)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(list(found.values()))
    return _manifest_rows(files, found, s)


def one_slash(path: str) -> str:
    """Local paths come with one slash or three, by the reader; here always with one."""
    return re.sub("^file:/+", "file:/", path)


def _manifest_rows(files: DataFrame, folders: dict[str, str], s: Settings) -> DataFrame:
    files = files.withColumn("path", records.file_path())
    stream = F.coalesce(*[F.when(F.startswith("path", F.lit(folder.rstrip("/") + "/")), F.lit(name)) for name, folder in folders.items()], F.lit("unknown"))
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(F.col("file_name"), s.filename_pattern, k)
    fits = F.col("file_name").rlike(s.filename_pattern)
    first_line = F.substring_index(F.decode("content", "UTF-8"), "\n", 1)
    named = files.withColumns({"stream": stream, "file_name": name, "first_line": first_line})
    trial = F.when(fits, F.concat_ws("_", part(1), part(2), part(3), part(4))).otherwise("unknown")
    return named.select(
        F.col("path").alias("file_path"), "file_name", trial.alias("trial_id"), F.when(fits, part(5)).otherwise(F.col("stream")).alias("stream_type"),
        *[F.when(fits, part(k)).otherwise("unknown").alias(f"parsed_{c}") for k, c in enumerate(("drive", "route", "date", "time"), 1)],
        F.col("length").alias("file_size"), F.when(F.trim("first_line") == "", 0).otherwise(F.size(F.split("first_line", ","))).alias("detected_columns"),
        F.sha2("content", 256).alias("file_checksum"), F.when(fits, "ok").otherwise("malformed").alias("parser_status"),
    )


def repetitions(trials: DataFrame, candidate: Column, most: int = 5) -> DataFrame:
    """candidate, repetition_id and dataset_tier: the first repetitions of each scenario among the candidates are planned."""
    line = Window.partitionBy("scenario_id", "candidate").orderBy("trial_id")
    out = trials.withColumn("candidate", candidate).withColumn("repetition_id", F.when(F.col("candidate"), F.row_number().over(line)).otherwise(1))
    return out.withColumn("dataset_tier", F.when(F.col("candidate") & (F.col("repetition_id") <= most), "planned_405").otherwise("extended_previous_paper"))


def pairs(files: DataFrame) -> DataFrame:
    """One row for each trial, and one for each malformed file: status, tier, repetition and what both streams have.

    The first 5 paired repetitions of each of the 9 x 9 scenarios, in the order of trial ids, are the planned tier.
    """
    good = files.filter("parser_status <> 'malformed'")
    listed = lambda stream: F.transform(F.array_sort(F.collect_list(F.when(F.col("stream_type") == stream, F.struct("file_path", "file_checksum")))), lambda x: x)
    trials = good.groupBy("trial_id").agg(listed("ev3").alias("e"), listed("vrmt").alias("v"))
    n_e, n_v = F.size("e"), F.size("v")
    reasons = F.array_compact(F.array(F.when(n_e > 1, "duplicate_ev3"), F.when(n_v > 1, "duplicate_vrmt"), F.when((n_e == 0) & (n_v > 0), "missing_ev3"), F.when((n_v == 0) & (n_e > 0), "missing_vrmt")))
    parts = F.split("trial_id", "_")
    trials = trials.withColumns({
        "status_reasons": reasons, "drive_id": F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown")), "route_id": F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")),
    }).withColumns({"status": F.coalesce(F.get("status_reasons", F.lit(0)), F.lit("paired")), "scenario_id": F.concat_ws("_", "drive_id", "route_id")})
    planned = (F.col("status") == "paired") & F.col("drive_id").rlike("^D0*[1-9]$") & F.col("route_id").rlike("^T0*[1-9]$")
    trials = repetitions(trials, planned)
    out = _pair_columns(trials.withColumn("dataset_tier", F.when(F.col("status") != "paired", "diagnostic_or_unplanned").otherwise(F.col("dataset_tier"))))
    malformed = files.filter("parser_status = 'malformed'").select(
        F.col("file_name").alias("trial_id"), F.array(F.lit("malformed_filename")).alias("status_reasons"), F.lit("malformed_filename").alias("status"), F.lit("unknown").alias("drive_id"), F.lit("unknown").alias("route_id"), F.lit("unknown").alias("scenario_id"),
        F.lit(0).alias("repetition_id"), F.lit("unknown").alias("dataset_tier"),
        *[F.when(F.col("stream_type") == stream, F.array(F.struct("file_path", F.lit("").alias("file_checksum")))).otherwise(F.array().cast("array<struct<file_path:string,file_checksum:string>>")).alias(c) for c, stream in (("e", "ev3"), ("v", "vrmt"))],
    )
    return out.unionByName(_pair_columns(malformed))


def _pair_columns(df: DataFrame) -> DataFrame:
    tier, status = F.col("dataset_tier"), F.col("status")
    analysis = F.when(tier == "planned_405", "primary_planned_405").when(tier == "extended_previous_paper", "extended_sensitivity").otherwise("diagnostic_only")
    compatible = F.when((status == "paired") & (tier != "unknown"), "compatible").when(status == "paired", "unknown_dataset_tier").when(status.isin("duplicate_ev3", "duplicate_vrmt"), "duplicate_trial").otherwise(status)
    first = lambda c, f: F.coalesce(F.get(F.col(f"{c}.{f}"), F.lit(0)), F.lit(""))
    return df.select(
        "trial_id", "status", "status_reasons", status.alias("pair_status"), first("e", "file_path").alias("ev3_file"), first("v", "file_path").alias("vrmt_file"), F.col("e.file_path").alias("ev3_files"), F.col("v.file_path").alias("vrmt_files"),
        first("e", "file_checksum").alias("ev3_checksum"), first("v", "file_checksum").alias("vrmt_checksum"), "drive_id", "route_id", "dataset_tier", analysis.alias("analysis_set"),
        F.when(tier == "planned_405", "planned").when(tier == "extended_previous_paper", "extended").otherwise("unknown").alias("protocol_source"), (tier == "planned_405").alias("is_planned_405"), (tier == "extended_previous_paper").alias("is_extended_log"),
        "scenario_id", "repetition_id", F.when(tier == "unknown", "unknown").otherwise(F.concat("scenario_id", F.lit("_grp"))).alias("trial_group_id"),
        F.when(tier == "unknown", "unknown").when(F.exists("status_reasons", lambda r: r.startswith("duplicate_")), "duplicate").otherwise("unique").alias("duplicate_status"), compatible.alias("compatibility_status"),
    )


# ------------------------------------------------------------------ logs


def is_tracker_log(first_line: str) -> bool:
    return ";" in first_line and ("INFO" in first_line or "tracker" in first_line)


def read_stream(spark: SparkSession, files: DataFrame, sniff: bool = False) -> DataFrame:
    """Raw text columns of all logs in ``files`` (file_path, trial_id), united by name; missing fields are NULL, and row indices count
    data records from 0. Fields may be quoted, with line ends and doubled quotes inside.

    Logs are read by byte ranges (``records.py``), so one may have any size. Only the different first records come to the driver, of
    which there are as many as formats, and the paths, which Spark's scan holds there anyway. ``sniff`` also accepts the headerless
    tracker log: known names first, col_i beyond them.
    """
    known = files.select(F.regexp_replace("file_path", "^file:/+", "file:/").alias("file_path"), "trial_id")
    found = records.records(spark, [r["file_path"] for r in known.select("file_path").distinct().collect()])
    # One row for each file: its first record names the format.
    first_records = found.filter("record = 0").select("file_path", F.col("text").alias("head"))
    rows = found.join(known.join(first_records, "file_path"), "file_path").select("trial_id", "head", F.col("record").alias("source_row_index"), F.col("text").alias("line"))
    heads = {r["head"]: next(csv.reader([r["head"]]), []) for r in first_records.select("head").distinct().collect()}
    trackers = {h: len(h.split(";")) for h in heads if sniff and is_tracker_log(h)}
    first, names = 0 if trackers else 1, []
    formats: list[tuple[str, list[str], Column]] = []
    for h, header in sorted(heads.items()):
        fields = F.split("line", ";") if h in trackers else F.array(*[F.col(f"f.c{k}") for k in range(len(header))])
        own = [*TRACKER_COLUMNS, *(f"col_{i}" for i in range(len(TRACKER_COLUMNS), trackers[h]))][: trackers[h]] if h in trackers else header
        formats.append((h, own, fields))
        names += [c for c in own if c not in names]
    if not names:
        return spark.createDataFrame([], "trial_id string, source_row_index long")
    wide = max(len(own) for _, own, _ in formats)
    parsed = rows.withColumn("f", F.from_csv(F.col("line"), F.lit(", ".join(f"`c{k}` string" for k in range(wide))), {"escape": '"'}))
    tracked = F.col("head").isin(*trackers) if trackers else F.lit(False)
    # The first line of a log is a row, that of a table its header.
    parsed = parsed.filter((F.col("source_row_index") >= first) & (tracked | (F.col("source_row_index") > 0)))

    def value(name: str) -> Column:
        found = [F.when(F.col("head") == h, F.nullif(F.trim(F.get(fields, F.lit(own.index(name)))), F.lit("")) if h in trackers else F.get(fields, F.lit(own.index(name)))) for h, own, fields in formats if name in own]
        return F.coalesce(*found)

    place = F.col("source_row_index") - F.when(tracked, 0).otherwise(1)
    return parsed.select("trial_id", place.cast("bigint").alias("source_row_index"), *[value(c).alias(c) for c in names])


# ------------------------------------------------------------------ tables


#: What Spark's readers say of files that aren't of the format asked for.
UNREADABLE = ("is not a Parquet file", "CANNOT_READ_FOOTER", "CANNOT_READ_FILE_FOOTER", "MALFORMED_RECORD_IN_PARSING", "PARQUET_COLUMN_DATA_TYPE_MISMATCH")


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table, or an empty one of this schema where its path is missing or its files aren't of the format.

    Anything else that goes wrong, such as a lost executor or a denied access, is an error and no empty table.
    """
    try:
        df = spark.read.format(fmt).options(**options).schema(schema).load(path)
        df.limit(1).count()
        return df
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    except (PySparkException, Py4JJavaError) as broken:
        if not any(sign in str(broken) for sign in UNREADABLE):
            raise
    return spark.createDataFrame([], schema)


def read_by_name(spark: SparkSession, folder: str, pattern: str, key: str = "trial_id", group: int = 1) -> DataFrame:
    """Parquet files of one folder in one scan, with an id taken from each file's name; files whose name doesn't fit are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder).withColumn("__name", F.element_at(F.split(records.file_path(), "/"), -1))
    return rows.filter(F.col("__name").rlike(pattern)).withColumn(key, F.regexp_extract("__name", pattern, group)).drop("__name")


class MissingColumns(ValueError):
    """A required table lacks columns."""


def contract(df: DataFrame, name: str, schema: str) -> DataFrame:
    """The table, if it has the contract's columns under their types; else an error that names all that is wrong."""
    kinds, wrong = dict(df.dtypes), []
    for part in schema.split(", "):
        column, kind = part.split(" ", 1)
        if kinds.get(column) != kind:
            wrong.append(f"{column} is {kinds.get(column, 'missing')}, not {kind}")
    if wrong:
        raise MissingColumns(f"{name}: {'; '.join(wrong)}")
    return df


def required(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet", **options: str) -> DataFrame:
    df = spark.read.format(fmt).options(**options).load(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"{path} lacks {', '.join(missing)}")
    return df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def exactly_one(df: DataFrame, key: str, wanted: str) -> DataFrame:
    """The one row of a key; an error at run time if there are none or several."""
    n = df.filter(F.col(key) == wanted).limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} row for {key} = {wanted!r}")
    return df.filter(F.col(key) == wanted)
