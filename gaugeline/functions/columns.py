"""Scalar operators as column expressions, all inside whole-stage code generation.

Non-finite numbers are NULL from ingestion on: comparisons with them are then never true, and aggregates skip them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and the infinities become NULL."""
    c = c.cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def numeric(c: Column) -> Column:
    """Text or number to a finite double, else NULL."""
    return finite(c.try_cast("double"))


def to_ns(seconds: Column) -> Column:
    """Seconds to integer nanoseconds, halves to even; NULL where it isn't finite or doesn't fit."""
    ns = F.rint(finite(seconds) * F.lit(1e9))
    return F.when(F.abs(ns) < F.lit(9.2e18), ns.cast("bigint"))


def exact_ns(text: Column, factor: str) -> Column:
    """Raw timestamp text to nanoseconds without passing through a double.

    Numeric text is scaled by ``factor`` (a decimal as text) in decimal arithmetic, halves to even; other text is read as a
    UTC date and time with up to nine fractional digits after a comma or a point.
    """
    trimmed = F.trim(text)
    number = F.bround(trimmed.try_cast("decimal(38,12)") * F.lit(factor).cast("decimal(12,9)") * F.lit(1_000_000_000).cast("decimal(10,0)"), 0)
    dotted = F.regexp_replace(trimmed, ",", ".")
    whole = F.regexp_extract(dotted, r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})(?:\.\d{1,9})?(?:Z|\+00:?00)?$", 1)
    fraction = F.regexp_extract(dotted, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.(\d{1,9})", 1)
    seconds = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(whole, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))
    dated = seconds * F.lit(1_000_000_000) + F.rpad(F.concat(F.lit("0"), fraction), 10, "0").try_cast("bigint")
    return F.coalesce(number.try_cast("bigint"), dated)


def wall_seconds(text: Column, factor: float) -> Column:
    """Numeric text, else a UTC date and time, in seconds times a unit factor."""
    stamp = F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.trim(text), ",", "."))) / F.lit(1e6)
    return F.coalesce(numeric(text), stamp) * F.lit(float(factor))


def wrap_angle(radians: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(radians + F.pi(), F.lit(2.0) * F.pi()) - F.pi()


def scenario(trial_id: Column) -> Column:
    """First two parts of a trial id."""
    parts = F.split(trial_id, "_")
    return F.concat_ws("_", F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown")), F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def is_evaluation(c: Column) -> Column:
    """The accepted spellings of the evaluation partition."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("evaluation", "eval", "heldout", "held_out", "held-out"), F.lit(False))


def upstream_reason(c: Column) -> Column:
    """Whether a reason text points at something missing before this stage."""
    return F.coalesce(F.lower(c).rlike("missing|unavailable|insufficient|invalid|failed|degenerate"), F.lit(False))


def yaw(qy: Column, qw: Column) -> Column:
    """Rotation about the vertical axis of a quaternion; missing parts count as the identity's."""
    return F.lit(2.0) * F.atan2(F.coalesce(qy, F.lit(0.0)), F.coalesce(qw, F.lit(1.0)))


def lever_arm(x: Column, y: Column, theta: Column, dx: float, dy: float) -> tuple[Column, Column]:
    """Position of the body point at (dx, dy) from the tracked one."""
    return x - (F.cos(theta) * dx - F.sin(theta) * dy), y - (F.sin(theta) * dx + F.cos(theta) * dy)


def rotate_translate(x: Column, y: Column, theta: Column, from_x: Column, from_y: Column, to_x: Column, to_y: Column) -> tuple[Column, Column]:
    """Shift to the origin of the first frame, rotate, shift to that of the second."""
    dx, dy = x - from_x, y - from_y
    return F.cos(theta) * dx - F.sin(theta) * dy + to_x, F.sin(theta) * dx + F.cos(theta) * dy + to_y


def phase_of(speed: Column, turn_rate: Column, stopped: str = "stopped", slow: float = 1.0, turning: float = 5.0) -> Column:
    """Later rules win: turning over straight, standing still over both."""
    return F.when(F.abs(speed) < slow, stopped).when(F.abs(turn_rate) > turning, "turning").otherwise("straight")


def aligned_phase(speed: Column, reference_speed: Column, turn_rate: Column, slow: float = 1.0, reference_slow: float = 0.05, turning: float = 5.0) -> Column:
    """stationary if both are slow; straight or turning if both move; uncertain if they disagree or one is unknown."""
    low, reference_low = speed < slow, reference_speed < reference_slow
    return (
        F.when(low & reference_low, "stationary").when(~low & ~reference_low & (F.abs(turn_rate) > turning), "turning")
        .when(~low & ~reference_low, "straight").otherwise("uncertain")
    )


def huber(error: Column, delta: float) -> Column:
    a = F.abs(error)
    q = F.least(a, F.lit(delta))
    return F.lit(0.5) * q * q + F.lit(delta) * (a - q)


# ------------------------------------------------------------------ identity keys


def canonical_key(c: Column, kind: str) -> tuple[Column, Column]:
    """Key text and the reason for which a value is no key (NULL if it is one).

    Integers, integral floats up to 2^53 and numeric text become integers; other text stays; NULL, NaN, infinities and
    blank text are non_finite, fractions non_integral, too large values unsafe_integer.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("string"), F.when(c.isNull(), "non_finite")
    if kind in ("float", "double"):
        reason = F.when(finite(c).isNull(), "non_finite").when(c != F.rint(c), "non_integral").when(F.abs(c) > 2.0**53, "unsafe_integer")
        return F.when(reason.isNull(), c.cast("decimal(20,0)").cast("string")), reason
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("decimal(38,10)"))
    huge = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & number.isNull()
    reason = (
        F.when(text.isNull() | (text == "") | F.lower(text).rlike(r"^[+-]?(nan|inf|infinity)$"), "non_finite")
        .when(number != F.round(number, 0), "non_integral")
        .when(huge | (F.abs(number) > F.lit("9223372036854775807").cast("decimal(38,0)")), "unsafe_integer")
    )
    return F.when(reason.isNull(), F.coalesce(number.cast("decimal(28,0)").cast("string"), text)), reason


def row_token(columns: Sequence[Column]) -> Column:
    """One column: its text; several: each with its length before it, so that no two rows share a token."""
    if len(columns) == 1:
        return columns[0]
    return F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns])


def sort_keys(keys: Column) -> Column:
    """Array of key texts in order: integers by value, then text."""
    tagged = F.transform(keys, lambda k: F.struct(k.try_cast("decimal(38,0)").isNull().alias("t"), k.try_cast("decimal(38,0)").alias("n"), k.alias("k")))
    return F.transform(F.array_sort(tagged), lambda s: s["k"])


def support_hash(keys: Column) -> Column:
    """SHA-256 of the sorted keys, one on a line; of nothing for no keys."""
    return F.sha2(F.array_join(sort_keys(keys), "\n"), 256)


def json_list_hash(sorted_keys: Column) -> Column:
    """SHA-256 of a sorted integer array as compact JSON."""
    return F.sha2(F.concat(F.lit("["), F.array_join(sorted_keys.cast("array<string>"), ","), F.lit("]")), 256)


def json_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Strict JSON of columns: non-finite numbers are null, and null fields are kept."""
    safe = [(finite(F.col(c)) if kind in ("float", "double") else F.col(c)).alias(c) for c, kind in df.dtypes if c in columns]
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})


def value_type(text: Column) -> Column:
    """What a cell's text holds."""
    return (
        F.when(text.isNull() | (text == ""), "null").when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike(r"^[+-]?\d+$"), "integer").when(text.try_cast("double").isNotNull(), "number").otherwise("string")
    )
