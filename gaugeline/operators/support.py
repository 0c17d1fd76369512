"""Exact support: which rows two or more arms share, checked, counted and hashed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.columns import canonical_key, row_token
from gaugeline.operators.digests import NO_LINES, ordered_digests


def with_token(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns support_key (text) and key_reason (NULL for a good key)."""
    kinds = dict(df.dtypes)
    parts = [canonical_key(F.col(k), kinds[k].split("(")[0]) for k in keys]
    rank = {"unsafe_integer": 1, "non_integral": 2, "non_finite": 3}
    worst = F.array_min(F.array_compact(F.array(*[F.when(r == name, F.lit(f"{n}{name}")) for _, r in parts for name, n in rank.items()])))
    return df.withColumns({"support_key": row_token([c for c, _ in parts]), "key_reason": F.substring(worst, 2, 40)})


def validate(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """rows, unique keys, duplicates and status of an arm, for each group.

    Precedence: missing column, duplicate, unsafe, non-integral, non-finite, empty, valid.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing:
        return df.groupBy(*group).agg(F.count("*").alias("rows")).select(*group, "rows", F.lit(0).cast("bigint").alias("finite_rows"), F.lit(0).cast("bigint").alias("unique_keys"), F.lit(0).cast("bigint").alias("duplicate_keys"), F.lit("missing_key_column").alias("support_status"))
    # Two steps, both map-side combined: rows by key, then keys by group. No count of distinct values in one task.
    tagged = with_token(df, keys)
    by_key = tagged.groupBy(*group, "support_key", "key_reason").agg(F.count("*").alias("n"))
    good = F.col("key_reason").isNull()
    out = by_key.groupBy(*group).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("finite_rows"), F.count_if(good).alias("unique_keys"), F.count_if(good & (F.col("n") > 1)).alias("duplicate_keys"),
        *[F.count_if(F.col("key_reason") == r).alias(f"__{r}") for r in ("unsafe_integer", "non_integral", "non_finite")],
    )
    status = (
        F.when(F.col("duplicate_keys") > 0, "duplicate_key").when(F.col("__unsafe_integer") > 0, "unsafe_integer_key")
        .when(F.col("__non_integral") > 0, "non_integral_key").when(F.col("__non_finite") > 0, "non_finite_key")
        .when(F.coalesce("unique_keys", F.lit(0)) == 0, "empty").otherwise("valid")
    )
    return out.select(*group, F.coalesce("rows", F.lit(0)).alias("rows"), "finite_rows", "unique_keys", "duplicate_keys", status.alias("support_status"))


def common_keys(arms: Mapping[str, DataFrame], keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """group columns and support_key of the keys that all arms have."""
    named = [with_token(df, keys).filter("key_reason is null").select(*group, "support_key", F.lit(name).alias("arm")) for name, df in sorted(arms.items())]
    every = reduce(DataFrame.unionByName, named)
    # Arms as bits: one aggregate that combines before it shuffles, and a key's arms are never rows of their own.
    words = [sorted(arms)[k : k + 62] for k in range(0, len(arms), 62)]
    bit = lambda word: reduce(lambda rest, kn: F.when(F.col("arm") == kn[1], F.lit(1 << kn[0]).cast("bigint")).otherwise(rest), enumerate(word), F.lit(0).cast("bigint"))
    have = every.groupBy(*group, "support_key").agg(*[F.bit_or(bit(w)).alias(f"__w{k}") for k, w in enumerate(words)])
    return have.filter(reduce(Column.__and__, [F.col(f"__w{k}") == (1 << len(w)) - 1 for k, w in enumerate(words)])).select(*group, "support_key")


def common_support(arms: Mapping[str, DataFrame], keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Count and hash of the common keys of each group, and status; an invalid arm blocks its group.

    The hash is over a group's keys in order, which go through it one after the other: a group may have any number of keys.
    """
    checks = reduce(DataFrame.unionByName, [validate(df, keys, group).withColumn("arm", F.lit(name)) for name, df in sorted(arms.items())])
    state = checks.groupBy(*group).agg(F.count("*").alias("arms"), F.min(F.when(F.col("support_status") != "valid", F.struct("arm", "support_status"))).alias("bad"))
    shared = ordered_digests(common_keys(arms, keys, group), group, "support_key")
    joined = state.join(shared, list(group), "left")
    blocked = F.col("bad").isNotNull() | (F.col("arms") < len(arms)) | F.col("n_keys").isNull()
    status = F.when(F.col("bad").isNotNull(), F.col("bad.support_status")).when(F.col("arms") < len(arms), "empty").when(F.col("n_keys").isNull(), "no_common_support").otherwise("valid")
    return joined.select(*group, F.when(blocked, 0).otherwise(F.col("n_keys")).cast("bigint").alias("common_support_count"), F.when(blocked, NO_LINES).otherwise(F.col("keys_hash")).alias("common_support_hash"), status.alias("support_status"))


def filter_common(arms: Mapping[str, DataFrame], keys: Sequence[str], group: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every arm with its rows on the common keys only."""
    shared = common_keys(arms, keys, group)
    on = [*group, "support_key"]
    return {name: with_token(df, keys).drop("key_reason").join(shared, on, "left_semi") for name, df in arms.items()}
