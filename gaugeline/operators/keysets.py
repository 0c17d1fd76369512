"""Sets of keys by trial and stream as bits of one row for each key: subsets, disjointness, unions and their hashes.

Each set has a bit. A key's bits say which sets hold it, and come from one aggregate that combines before it shuffles; counts of what a question
asks for, as keys in both of two sets or in one and not in the other, are a second aggregate. Only trials of at most SMALL keys are hashed as arrays,
and the ledger's own arrays; no larger set of a trial is ever in one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.columns import json_list_hash, sort_keys
from gaugeline.operators.digests import JSON_LIST, ordered_digests
from gaugeline.sources.kept import kept

#: The sets of the leakage comparison: what the ledger and the streams hold in either partition, and what may be fitted of the evaluation rows.
SETS = {name: 1 << k for k, name in enumerate(("ledger_calibration", "ledger_evaluation", "calibration", "evaluation", "eligible"))}
PARTITIONS = ("calibration", "evaluation")
LEAKAGE = {"split": "split_excludes_evaluation_fitting_keys", "full": "intentionally_leaky_evaluation_fitting_keys_included"}


#: Keys of a trial that are hashed as one array at most.
SMALL = 1000


def _list_hash(keys: Column, kind: str) -> Column:
    """SHA-256 of an array's keys in order as a JSON list, as ordered_digests has it; NULL for none."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.when(F.size(keys) > 0, json_list_hash(F.array_sort(keys) if whole else sort_keys(keys.cast("array<string>"))))


def bits_of(members: DataFrame, group: Sequence[str], key: str, sets: Mapping[str, int]) -> DataFrame:
    """group columns, key, bits and repeated (whether a set holds the key more than once), of rows (group, key, set)."""
    bit = F.lit(0)
    for name, b in sets.items():
        bit = F.when(F.col("set") == name, F.lit(b)).otherwise(bit)
    each = members.filter(F.col(key).isNotNull()).withColumn("__bit", bit)
    twice = [F.sum(F.when(F.col("__bit") == b, 1).otherwise(0)) > 1 for b in sets.values()]
    return each.groupBy(*group, key).agg(F.bit_or("__bit").alias("bits"), F.array_max(F.array(*twice)).alias("repeated"))


def holds(sets: Mapping[str, int], *names: str, without: Sequence[str] = ()) -> Column:
    """Whether a key is in all of the sets, and in none of those in ``without``."""
    inside, outside = sum(sets[n] for n in names), sum(sets[n] for n in without)
    return (F.col("bits").bitwiseAND(inside) == inside) & (F.col("bits").bitwiseAND(outside) == 0)


def leakage(telemetry: DataFrame, tracking: DataFrame, ledger: DataFrame, eligible: DataFrame | None = None, key: str = "trial_id", identity: str = "source_row_index") -> DataFrame:
    """For each trial of the ledger: what the arms of the leakage comparison may be fitted on, counted and hashed, and why a trial is refused.

    The split arm is fitted on calibration keys, the full arm on the union with the evaluation keys. ``eligible`` (trial, identity): evaluation
    rows that may be fitted, by default all that the ledger has; a trial without any is refused, as if none had been kept.

    reason, the first that holds: keys or hashes are missing; a stream's calibration and evaluation keys overlap; a hash isn't that of its keys;
    an eligible key is no evaluation key; a key of the ledger isn't in its stream, or a stream repeats one. NULL if none does.
    """
    parts = ledger.filter(F.col("partition").isin(*PARTITIONS))
    persisted = parts.select(key, "stream", F.explode("source_rows").alias("key"), F.concat(F.lit("ledger_"), "partition").alias("set"))
    there = [df.filter(F.col("partition").isin(*PARTITIONS)).select(key, F.lit(s).alias("stream"), F.col(identity).alias("key"), F.col("partition").alias("set")) for s, df in (("ev3", telemetry), ("vrmt", tracking))]
    may = persisted.filter("stream = 'ev3' and set = 'ledger_evaluation'") if eligible is None else eligible.select(key, F.lit("ev3").alias("stream"), F.col(identity).alias("key"))
    members = persisted.unionByName(there[0]).unionByName(there[1]).unionByName(may.select(key, "stream", "key", F.lit("eligible").alias("set")))
    keys = kept(bits_of(members, [key, "stream"], "key", SETS))  # counted and hashed
    ev3 = F.col("stream") == "ev3"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    fit_split, fit_full = holds(SETS, "ledger_calibration"), F.col("bits").bitwiseAND(SETS["ledger_calibration"] | SETS["ledger_evaluation"]) != 0
    both = holds(SETS, "ledger_calibration", "ledger_evaluation")
    lost = holds(SETS, "ledger_calibration", without=["calibration"]) | holds(SETS, "ledger_evaluation", without=["evaluation"])
    has = [n((F.col("stream") == s) & holds(SETS, f"ledger_{p}")) == 0 for s in ("ev3", "vrmt") for p in PARTITIONS]
    counts = keys.groupBy(key).agg(
        n(ev3 & holds(SETS, "ledger_calibration")).alias("n_calibration"), n(ev3 & holds(SETS, "ledger_evaluation")).alias("n_evaluation"), n(ev3 & holds(SETS, "eligible")).alias("eligible_count"),
        n(ev3 & both).alias("overlap"), n(~ev3 & both).alias("other_overlap"), n(ev3 & holds(SETS, "eligible", without=["ledger_evaluation"])).alias("foreign"), n(lost | F.col("repeated")).alias("lost"), F.array_max(F.array(*has)).alias("bare"),
        n(ev3 & fit_split).alias("split_count"), n(ev3 & fit_full).alias("full_count"), (n(ev3 & fit_split & holds(SETS, "eligible")) == 0).alias("split_excludes"), (n(ev3 & fit_full & holds(SETS, "eligible")) > 0).alias("full_includes"),
    )
    named = F.array_compact(F.array(F.when(fit_split, "split"), F.when(fit_full, "full"), F.when(holds(SETS, "eligible"), "eligible")))
    # Trials of few keys are hashed as arrays, the others key by key, so that a trial may have any number of keys.
    large = keys.filter(ev3).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select(key)
    sets = {"split": fit_split, "full": fit_full, "eligible": holds(SETS, "eligible")}
    named = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in sets.items()]))
    one = ordered_digests(keys.filter(ev3).join(large, key, "left_semi").select(key, F.explode(named).alias("set"), "key"), [key, "set"], "key", "n", "h", JSON_LIST)
    one = one.groupBy(key).agg(*[F.max(F.when(F.col("set") == s, F.col("h"))).alias(f"{s}_hash") for s in sets])
    few = keys.filter(ev3).join(large, key, "left_anti").groupBy(key).agg(*[F.collect_list(F.when(c, F.col("key"))).alias(s) for s, c in sets.items()])
    kind = dict(keys.dtypes)["key"]
    hashes = one.unionByName(few.select(key, *[_list_hash(F.col(s), kind).alias(f"{s}_hash") for s in sets]))
    # The ledger has a partition's keys as one array.
    stored = parts.groupBy(key, "stream", "partition").agg(F.collect_list(F.struct(F.col("identity_hash").alias("h"))).alias("told"), F.array_distinct(F.flatten(F.collect_list("source_rows"))).alias("__rows"))
    fresh = _list_hash(F.array_compact("__rows"), kind)
    stored = stored.select(key, "stream", "partition", fresh.alias("h"), F.explode("told.h").alias("identity_hash"))
    matched = stored.groupBy(key).agg(
        n(F.col("identity_hash").isNull() | (F.col("identity_hash") == "")).alias("unhashed"), n(F.col("identity_hash") != F.col("h")).alias("mismatched"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "stream", "partition", "identity_hash"))), "\n"), 256).alias("partition_hash"),  # four hashes
    )
    out = matched.join(counts, key, "left").join(hashes, key, "left")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    reason = (
        F.when((F.col("unhashed") > 0) | none("n_calibration") | none("n_evaluation") | none("eligible_count"), "missing_persisted_h3_keys_or_partition_hash")
        .when(F.col("overlap") > 0, "persisted_calibration_evaluation_overlap").when(F.col("other_overlap") > 0, "persisted_vive_calibration_evaluation_overlap").when(F.col("mismatched") > 0, "partition_hash_mismatch")
        .when(F.col("foreign") > 0, "invalid_eligible_evaluation_fitting_keys").when((F.col("lost") > 0) | F.col("bare"), "missing_persisted_stream_ids")
    )
    kept_columns = ["n_calibration", "n_evaluation", "eligible_count", "split_count", "full_count"]
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in kept_columns], "split_excludes", "full_includes", "split_hash", "full_hash", "eligible_hash", "partition_hash", reason.alias("reason"))
