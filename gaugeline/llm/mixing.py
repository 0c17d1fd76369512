"""Mixing sources to target weights by hash-threshold histograms.

Every document gets two hash digits from its id. Sizes are summed by source and first digit (at most BINS rows a source,
map-side combined, so a source with a third of all rows costs no more than another); running sums over these few rows find
the bin in which each source's budget ends; only the documents of that boundary bin are summed again by the second digit.
What remains is a filter on (digit, digit) against two thresholds per source. Nothing is sorted, and a larger target takes a
superset of what a smaller one takes, as the thresholds are nested.

Defined results: a null text has size 0; null sources are one source, after all others; a null id hashes as the empty
string; rows with equal ids are taken together; a target above the source's size takes every document one or more times
whole and the remainder by threshold; an empty table gives no rows; texts of any length count in full; columns of other names are carried along
as a struct where rows are kept and not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.storage import keep, small

BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def digits(key: Column) -> tuple[Column, Column]:
    """Two independent digits below BINS from the hash of a key."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(h, at, 3), 16, 10).cast("int") for at in (1, 4))


def targets(sizes: DataFrame, weights: Sequence[float], most: float, share: float = 1.0) -> DataFrame:
    """source, source_size -> and target. ``sizes`` has a row for each source.

    Targets follow the weights (repeating along the sources in code point order, null last) and stop at ``most`` times the
    size; the excess is shared again until none is above. The end of that process has one level L with target =
    min(most * size, L * weight), and the sources that are at their stop are those with the least most * size / weight, so
    running sums in that order give L at once.
    """
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", (F.row_number().over(by_source) - 1).cast("int")).withColumn("weight", w)
    ranked = ranked.withColumn("stop", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("stop") / F.col("weight"))
    run = ranked.withColumns({
        "budget": F.lit(float(share)) * F.sum("source_size").over(everything),
        "stopped": F.coalesce(F.sum("stop").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The level if exactly the sources before this one have stopped; the first source that stays below its stop sets it.
    run = run.withColumn("if_open", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
    level = F.min(F.when(F.col("if_open") <= F.col("level"), F.struct("level", "source", "if_open"))).over(everything)["if_open"]
    return run.select("source", "source_size", F.least("stop", F.coalesce(level, F.col("level")) * F.col("weight")).alias("target"))


def thresholds(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source: whole (times that every document is taken), d1 and d2 (documents with smaller digits once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = wanted.select("source", "source_size", "target", whole.cast("bigint").alias("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    first = slim.groupBy("source", "d1").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("d1").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("below", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # The boundary bin: the last whose documents below it still fit.
    edge = first.alias("f").join(budgets.alias("b"), F.expr("f.source <=> b.source AND f.below <= b.rest"))
    edge = edge.groupBy("b.source", "source_size", "target", "whole", "rest").agg(F.max(F.struct("d1", "below")).alias("e"))
    edge = keep(edge.select("source", "source_size", "target", "whole", (F.col("rest") - F.col("e.below")).alias("rest"), F.col("e.d1").alias("d1")), "mix-edge")
    second = slim.alias("s").join(small(edge.select(F.col("source").alias("e_source"), F.col("d1").alias("e_d1"))), F.expr("s.source <=> e_source AND s.d1 = e_d1"))
    second = second.groupBy("s.source", "d2").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("d2").rowsBetween(Window.unboundedPreceding, 0)
    second = second.withColumn("upto", F.sum("size").over(upto)).withColumn("before", F.col("upto") - F.col("size"))
    # The nearer of the two cuts around the budget, so that the miss is at most half a second-level bin.
    cut = second.alias("n").join(edge.alias("g"), F.expr("n.source <=> g.source")).groupBy("g.source", "source_size", "target", "whole", "d1")
    cut = cut.agg(F.coalesce(F.max(F.when(F.col("upto") - F.col("rest") <= F.col("rest") - F.col("before"), F.col("d2") + 1)), F.lit(0)).alias("d2"))
    return cut.select("source", "source_size", "target", "whole", "d1", "d2")


def _cuts(slim: DataFrame, weights: Sequence[float], most: float, share: float) -> DataFrame:
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    return small(keep(thresholds(slim, keep(targets(sizes, weights, most, share), "mix-targets")), "mix-cuts"))


def _copies(most: float) -> Column:
    """How often a row s is taken under the thresholds c of its source."""
    once_more = F.when((F.col("s.d1") < F.col("c.d1")) | ((F.col("s.d1") == F.col("c.d1")) & (F.col("s.d2") < F.col("c.d2"))), 1).otherwise(0)
    return F.least(F.col("c.whole") + once_more, F.lit(int(most))).cast("int")


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size and digits of every row, written: the texts are read once for all the histograms."""
    d1, d2 = digits(F.col(id_col))
    return keep(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), d1.alias("d1"), d2.alias("d2")), "mix-sizes")


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: what the mix takes of every row of ``df``.

    The texts are read once; what follows works on a table of (id, source, size, two digits) in the shared folder. The
    table of thresholds has a row for each source; it is counted, and broadcast only up to storage.SMALL_ROWS rows.
    """
    slim = _slim(df, id_col, text_col, source_col)
    joined = slim.alias("s").join(_cuts(slim, weights, most, share).alias("c"), F.expr("s.source <=> c.source"), "left")
    joined = joined.select("doc_id", "size", "source_size", "target", _copies(most).alias("copies"), F.col("s.source").alias("source"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_rows(df: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (a struct of all columns of ``df``) and copies: how often the mix takes each row. The digits follow from the id, so no text is shuffled."""
    cuts = _cuts(_slim(df, id_col, text_col, source_col), weights, most, share)
    d1, d2 = digits(F.col(id_col))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source_col).alias("source"), d1.alias("d1"), d2.alias("d2")).alias("s")
    joined = rows.join(cuts.alias("c"), F.expr("s.source <=> c.source"), "left")
    return joined.select("s.row", _copies(most).alias("copies"))
