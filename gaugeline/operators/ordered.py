"""Order statistics of groups of any size: positions, exact quantiles, ranks and Walsh medians without a group in one task.

Everything rests on one step. Equal values of a group are counted first, so that a value which a third of all rows share is one row; the
distinct values are then dealt to tasks by ranges of (group, value), so that a group of any size is spread over as many tasks as it needs; and
each range's total, a table with a row for each group and range, says how many values stand before a range. Nothing holds a group's values, and
the answers are exact: a quantile is looked up at its position and not estimated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.columns import finite
from gaugeline.sources.kept import kept

#: Thresholds that one pass of the Walsh median tries for each group: its bracket shrinks to a sixteenth.
THRESHOLDS = 15


def cumulated(df: DataFrame, group: Sequence[str], order: Sequence[str], n: str = "n") -> DataFrame:
    """Rows with ``before`` and ``total``: the sums of ``n`` over the rows of their group that come first, and over all of them.

    Rows of a group differ in ``order``. A group column may be NULL; such rows are a group, too.
    """
    ranges = kept(df.repartitionByRange(*[F.col(c) for c in (*group, *order)] or [F.lit(0)]).withColumn("__range", F.spark_partition_id()))
    # A struct of NULLs equals another one, so rows whose group columns are NULL find their range.
    ranges = ranges.withColumn("__group", F.struct(*[F.col(g) for g in group], F.lit(0).alias("__one")))
    line = Window.partitionBy("__group").orderBy("__range")
    sums = ranges.groupBy("__group", "__range").agg(F.sum(n).alias("__n"))
    earlier = sums.select("__group", "__range", F.coalesce(F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__group")).alias("total"))
    inside = Window.partitionBy("__group", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return own.join(earlier, ["__group", "__range"]).withColumn("before", F.col("__before") + F.col("__inside")).drop("__group", "__range", "__before", "__inside")


def counted(df: DataFrame, group: Sequence[str], value: Column | str) -> DataFrame:
    """group columns, v and n: each finite value of a group with how often it occurs."""
    v = finite(F.col(value) if isinstance(value, str) else value)
    return df.select(*group, v.alias("v")).filter("v is not null").groupBy(*group, "v").agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, group: Sequence[str], columns: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """One row for each group and column (``name``): total, and under its name each quantile, interpolated between the two nearest values.

    All columns and groups go through the same two shuffles.
    """
    items = F.array(*[F.struct(F.lit(c).alias("name"), finite(F.col(c)).alias("v")) for c in columns])
    long = df.select(*group, F.inline(items)).filter("v is not null").groupBy(*group, "name", "v").agg(F.count("*").alias("n"))
    return quantiles_of_counts(long, [*group, "name"], probabilities)


def quantiles_of_counts(counts: DataFrame, group: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """As quantiles(), of rows (group, v, n): distinct values and how often they occur."""
    placed = cumulated(counts, group, ["v"])
    picked: list[Column] = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        picked += [F.max(F.when(holds(f(at)), F.col("v"))).alias(f"__{side}_{name}") for side, f in (("low", F.floor), ("high", F.ceil))]
    found = placed.groupBy(*group).agg(F.max("total").alias("total"), *picked)

    def between(name: str, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("total") - 1)
        return F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * (at - F.floor(at))

    return found.select(*group, "total", *[between(name, p).alias(name) for name, p in probabilities.items()])


def mean_ranks(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows (group, v, n, ...) with ``rank``: that of the value among its group's, equal values sharing their mean, and ``total``."""
    placed = cumulated(counts, group, ["v"])
    return placed.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("before")


# ------------------------------------------------------------------ Walsh medians


def _pairs_below(values: DataFrame, group: Sequence[str], limits: DataFrame) -> DataFrame:
    """For each group and limit (group, k, s): how many pairs of its values, each with itself too, have a sum of at most s."""
    asked = values.join(limits, list(group))
    queries = asked.select(*group, (F.col("s") - F.col("v")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("n"), "k", F.col("n").alias("weight"), (2 * F.col("v") <= F.col("s")).alias("own"))
    queries = queries.groupBy(*group, "at", "asks", "k").agg(F.max("n").alias("n"), F.sum("weight").alias("weight"), F.sum(F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("own"))
    samples = values.select(*group, F.col("v").alias("at"), F.lit(0).alias("asks"), F.lit(-1).alias("k"), "n", F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("own"))
    placed = cumulated(samples.unionByName(queries), group, ["at", "asks", "k"]).filter("asks = 1")
    # Ordered pairs count twice but for those of a value with itself.
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return placed.groupBy(*group, "k").agg(((F.sum(wide("weight") * wide("before")) + F.sum("own")) / 2).cast("decimal(38,0)").alias("below"))


def _in_order(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, with none left out."""
    bits = np.asarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


def _doubles(order: np.ndarray) -> np.ndarray:
    order = np.asarray(order, np.int64)
    return np.where(order < 0, np.int64(-(1 << 63)) - order, order).view(np.float64)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.DoubleType())])))
def _limits(low: pd.Series, high: pd.Series) -> pd.Series:
    """Numbers between the ends that cut the doubles there into parts of equal size; none if there is no double between."""
    out = []
    for a, b in zip(_in_order(low.to_numpy()).tolist(), _in_order(high.to_numpy()).tolist(), strict=True):
        cuts = sorted({a + (b - a) * i // (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)} - {a, b})
        out.append([{"k": k, "s": float(s)} for k, s in enumerate(_doubles(np.array(cuts, np.int64)) + 0.0)])
    return pd.Series(out)


def walsh_medians(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group columns, pseudomedian: the median of all averages of two of a group's values, each with itself too.

    Sums of two values are looked for between the least and the greatest one: each pass counts, for several limits at once and for all
    groups, the pairs whose sum is below, and keeps the part that holds the middle. It ends when no double lies between a bracket's ends, so
    the result is exact; that takes 16 passes over the distinct values, whatever their number. Group columns aren't NULL.
    """
    values = kept(counted(df, group, value))
    extent = values.groupBy(*group).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("n").cast("decimal(38,0)").alias("m"))
    pairs = (F.col("m") * (F.col("m") + 1) / 2).cast("decimal(38,0)")
    # Both middle sums are searched for side by side: rank is the number of pairs up to and including the sum.
    ranks = F.array(F.struct(F.lit(0).alias("middle"), F.floor((pairs + 1) / 2).cast("decimal(38,0)").alias("rank")), F.struct(F.lit(1).alias("middle"), (F.floor(pairs / 2) + 1).cast("decimal(38,0)").alias("rank")))
    # low: too few pairs are at or below it; high: enough are.
    state = extent.select(*group, F.inline(ranks), (2 * F.col("a") - F.greatest(F.abs("a"), F.lit(1e-300))).alias("low"), (2 * F.col("b")).alias("high"))
    keys = [*group, "middle"]
    while True:
        state = kept(state)
        limits = state.select(*keys, "rank", F.inline(_limits("low", "high")))
        if limits.isEmpty():
            break
        below = _pairs_below(values.withColumn("middle", F.explode(F.array(F.lit(0), F.lit(1)))), keys, limits.select(*keys, "k", "s"))
        seen = limits.join(below, [*keys, "k"])
        enough = F.col("below") >= F.col("rank")
        ends = seen.groupBy(*keys).agg(F.max(F.when(~enough, F.col("s"))).alias("up"), F.min(F.when(enough, F.col("s"))).alias("down"))
        state = state.join(ends, keys, "left").select(*keys, "rank", F.coalesce("up", "low").alias("low"), F.coalesce("down", "high").alias("high"))
    return state.groupBy(*group).agg((F.sum("high") / 4).alias("pseudomedian"))
