"""Per-trial fits and the reference operators.

The relational parts (rigid fits, transforms, residuals) are expressions and aggregates. Splines, monotone cubics, lag
correlation and the clock fit have no SQL form; they run on Arrow blocks of whole trials after one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import Settings
from gaugeline.functions import signals
from gaugeline.functions.columns import aligned_phase, rotate_translate, scenario
from gaugeline.operators import asof
from gaugeline.operators.cleaning import difference, ordered, path_length
from gaugeline.operators.digests import ordered_digests
from gaugeline.operators.grouped import map_trials, numbers_of

TEMPORAL = "b_onset double, b_refined double, b_final double, lag double, best double, second double, ratio double, temporal_status string"
CLOCK = "clock_model string, scale_a double, offset_b double, candidate_a double, candidate_b double, gain double, mse_constant double, mse_affine double, hit_bound boolean"


def _none(x: float | None) -> float | None:
    return None if x is None or not np.isfinite(x) else float(x)


def fit_time(telemetry: DataFrame, tracking: DataFrame, s: Settings, own: str | None = None, other: str | None = None, own_time: str = "local_time_s", other_time: str = "relative_time_s", key: str = "trial_id", onset_only: bool = False) -> DataFrame:
    """One row for each trial: temporal offset and clock model. Streams without the proxy column give status missing_input."""
    own, other = own or s.telemetry_proxy, other or s.tracking_proxy
    kind = dict(telemetry.dtypes)[key]
    schema = f"{key} {kind}, {TEMPORAL}, {CLOCK}"
    if own not in telemetry.columns or other not in tracking.columns:
        trials = telemetry.select(key).union(tracking.select(key)).distinct()
        empty = ", ".join(f"cast(null as {part.split()[1]}) as {part.split()[0]}" for part in f"{TEMPORAL}, {CLOCK}".split(", "))
        out = trials.selectExpr(key, *empty.split(", "))
        return out.withColumns({"b_onset": F.lit(0.0), "b_refined": F.lit(0.0), "b_final": F.lit(0.0), "temporal_status": F.lit("missing_input"), "clock_model": F.lit("constant_offset"), "scale_a": F.lit(1.0), "offset_b": F.lit(0.0), "gain": F.lit(0.0), "hit_bound": F.lit(False)})

    columns = [p.split()[0] for p in schema.split(", ")]

    def fit(block: pa.Table, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = []
        for name, e, v in _signal_pairs(block, numbers):
            offset = signals.temporal_offset(e, v, s, onset_only)
            clock = signals.clock_fit(e, v, offset.b_final, s)
            rows.append((name, *(_none(x) for x in offset[:-1]), offset.status, clock.model, *(_none(x) for x in clock[1:-1]), clock.hit_bound))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [block.schema.field(0).type, *_TYPES], strict=True)], columns)

    return map_trials(_both_streams(telemetry, tracking, own, other, own_time, other_time, key), ["stream", "t", "place"], fit, schema)


_TYPES = [pa.float64()] * 7 + [pa.string()] * 2 + [pa.float64()] * 7 + [pa.bool_()]


def _both_streams(telemetry: DataFrame, tracking: DataFrame, own: str, other: str, own_time: str, other_time: str, key: str) -> DataFrame:
    """trial, stream (0 or 1), t, s, place of the rows of trials."""
    place = lambda df: F.col("source_row_index").cast("long") if "source_row_index" in df.columns else F.lit(0).cast("long")
    pick = lambda df, k, t, v: df.select(key, F.lit(k).alias("stream"), F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("s"), place(df).alias("place"))
    return pick(telemetry, 0, own_time, own).unionByName(pick(tracking, 1, other_time, other))


def _signal_pairs(block: pa.Table, numbers: np.ndarray) -> Iterator[tuple[object, signals.Signal, signals.Signal]]:
    """Trial and the signals of its two streams, trial by trial."""
    t, y, stream = (numbers_of(block, c) for c in ("t", "s", "stream"))
    edges = np.searchsorted(numbers, np.arange(numbers[-1] + 2))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k = a + int(np.searchsorted(stream[a:z], 1))
        yield block.column(0)[a].as_py(), signals.Signal.of(t[a:k], y[a:k]), signals.Signal.of(t[k:z], y[k:z])


def correlation_curve(telemetry: DataFrame, tracking: DataFrame, s: Settings, own: str, other: str, own_time: str = "t", other_time: str = "t", key: str = "trial_id") -> DataFrame:
    """Lag, score and overlap of every evaluated lag of every trial, as rows."""
    schema = f"{key} {dict(telemetry.dtypes)[key]}, lag_s double, score double, overlap_s double, status string"

    def curve(block: pa.Table, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        for name, e, v in _signal_pairs(block, numbers):
            found, peak = signals.lag_correlation(e, v, s)
            n = len(found.lags)
            columns = [pa.array([name] * n, block.schema.field(0).type), pa.array(found.lags), pa.array(found.scores, from_pandas=True), pa.array(found.overlap), pa.array([peak.status] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in schema.split(", ")])

    return map_trials(_both_streams(telemetry, tracking, own, other, own_time, other_time, key), ["stream", "t", "place"], curve, schema)


def query_reference(queries: DataFrame, samples: DataFrame, values: Sequence[str], methods: Sequence[str] = signals.METHODS, key: str = "trial_id", query_time: str = "t", sample_time: str = "t", identity: str = "source_row_index") -> DataFrame:
    """Rows (key, identity, query time, method, ref_*, valid) of each query under each method; no extrapolation.

    Queries and samples are united, shuffled once and sorted once; all methods are worked out in one pass over blocks of whole trials. Of
    samples with equal times the first counts.
    """
    if unknown := set(methods) - set(signals.METHODS):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    proper = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    blank = [F.lit(None).cast("double").alias(c) for c in values]
    kind = dict(queries.dtypes)[identity]
    q = queries.select(key, F.col(query_time).cast("double").alias("t"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("place"), F.col(identity).alias("id"), *blank)
    place = F.col(identity).cast("long") if identity in samples.columns else F.lit(0).cast("long")
    v = samples.select(key, F.col(sample_time).cast("double").alias("t"), F.lit(0).alias("side"), place.alias("place"), F.lit(None).cast(kind).alias("id"), *[F.col(c).cast("double").alias(c) for c in values])
    v = v.filter(reduce(Column.__and__, [proper(c) for c in ("t", *values)]))
    columns = [key, identity, "t", "method", *[f"ref_{c}" for c in values], "valid"]
    schema = f"{key} {dict(queries.dtypes)[key]}, {identity} {kind}, t double, method string, " + ", ".join(f"ref_{c} double" for c in values) + ", valid boolean"

    def work(block: pa.Table, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, asked = numbers_of(block, "t"), numbers_of(block, "side") == 1
        knot = ~asked
        # Equal times are neighbours, as queries at a time come after its samples.
        at = np.flatnonzero(knot)
        again = np.append(False, (t[at][1:] == t[at][:-1]) & (numbers[at][1:] == numbers[at][:-1]))[: len(at)]
        knot[at[again]] = False
        at = at[~again]
        knots = signals.Knots(t[at], np.stack([numbers_of(block, c)[at] for c in values]), numbers[at])
        last = (np.cumsum(knot) - 1)[asked]
        rows = block.select([key, "id", "t"]).filter(pa.array(asked)).combine_chunks()
        if not rows.num_rows:
            return
        carried = [rows.column(c).combine_chunks() for c in (key, "id", "t")]
        for method in methods:
            found = knots.at(method, last, numbers[asked], t[asked])
            good = np.isfinite(found).all(axis=0)
            yield pa.RecordBatch.from_arrays([*carried, pa.array([method] * len(good), pa.string()), *(pa.array(f, mask=~good) for f in found), pa.array(good)], columns)

    return map_trials(q.unionByName(v), [F.col("t").asc_nulls_first(), "side", "place"], work, schema)


def spline_knots(samples: DataFrame, values: Sequence[str], key: str = "trial_id", time: str = "t") -> DataFrame:
    """Knots of the natural cubic trajectory with second derivatives (m_*): at least four knots, else no rows for the trial."""
    schema = f"{key} {dict(samples.dtypes)[key]}, {time} double, " + ", ".join(f"{c} double, m_{c} double" for c in values)

    def knots(block: pa.Table, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, y = numbers_of(block, time), np.stack([numbers_of(block, c) for c in values])
        good = np.isfinite(t) & np.isfinite(y).all(axis=0)
        at = np.flatnonzero(good)
        at = at[np.append(True, (np.diff(t[at]) != 0) | (np.diff(numbers[at]) != 0))[: len(at)]]
        at = at[np.bincount(numbers[at], minlength=int(numbers[-1]) + 1)[numbers[at]] >= 4]
        if not len(at):
            return
        own = signals.Knots(t[at], y[:, at], numbers[at])
        pairs = [pa.array(c) for each in zip(own.y, own.moments(), strict=True) for c in each]
        yield pa.RecordBatch.from_arrays([block.column(0).combine_chunks().take(pa.array(at)), pa.array(own.t), *pairs], [p.split()[0] for p in schema.split(", ")])

    place = [F.col("source_row_index").cast("long").alias("place")] if "source_row_index" in samples.columns else [F.lit(0).cast("long").alias("place")]
    picked = samples.select(key, F.col(time).cast("double").alias(time), *[F.col(c).cast("double").alias(c) for c in values], *place)
    return map_trials(picked, [time, "place"], knots, schema)


def query_knots(queries: DataFrame, knots: DataFrame, values: Sequence[str], key: str = "trial_id", time: str = "t") -> DataFrame:
    """Spline values from written knots, as column arithmetic on the bracketing ones."""
    carried = [*values, *[f"m_{c}" for c in values]]
    found = asof.inclusive_bracket(queries, knots, carried, key=key, query_time=time)
    h = F.col("next.t") - F.col("prev.t")
    a, b = (F.col("next.t") - F.col(time)) / h, (F.col(time) - F.col("prev.t")) / h
    cubic = lambda c: a * F.col(f"prev.{c}") + b * F.col(f"next.{c}") + ((a * a * a - a) * F.col(f"prev.m_{c}") + (b * b * b - b) * F.col(f"next.m_{c}")) * h * h / 6
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    return found.select(*queries.columns, *[F.when(inside, F.when(h > 0, cubic(c)).otherwise(F.col(f"prev.{c}"))).alias(f"ref_{c}") for c in values], inside.alias("valid"))


def rigid_fit(matched: DataFrame, source: tuple[str, str], target: tuple[str, str], key: str = "trial_id") -> DataFrame:
    """theta, tx, ty of the least-squares rigid motion from source to target, from five covariances: no Python, no collection."""
    (sx, sy), (tx, ty) = source, target
    known = matched.filter(" and ".join(f"{c} is not null" for c in (*source, *target)))
    cov = lambda a, b: F.covar_pop(F.col(a), F.col(b))
    out = known.groupBy(key).agg(
        F.count("*").alias("n"), F.atan2(cov(sx, ty) - cov(sy, tx), cov(sx, tx) + cov(sy, ty)).alias("theta_rad"),
        F.avg(sx).alias("__sx"), F.avg(sy).alias("__sy"), F.avg(tx).alias("__tx"), F.avg(ty).alias("__ty"),
    ).filter("n >= 3")
    c, s = F.cos("theta_rad"), F.sin("theta_rad")
    return out.select(key, "n", "theta_rad", (F.col("__tx") - c * F.col("__sx") + s * F.col("__sy")).alias("tx"), (F.col("__ty") - s * F.col("__sx") - c * F.col("__sy")).alias("ty"))


def apply_rigid(df: DataFrame, fits: DataFrame, x: str, y: str, out: tuple[str, str], flip_y: bool = False, key: str = "trial_id") -> DataFrame:
    joined = df.join(fits.select(key, "theta_rad", "tx", "ty"), key)
    zero = F.lit(0.0)
    ax, ay = rotate_translate(F.col(x), -F.col(y) if flip_y else F.col(y), F.col("theta_rad"), zero, zero, F.col("tx"), F.col("ty"))
    return joined.withColumns({out[0]: ax, out[1]: ay}).drop("theta_rad", "tx", "ty")


def heading_fit(telemetry: DataFrame, tracking: DataFrame, times: DataFrame, s: Settings, own: tuple[str, str] = ("odometry_x", "odometry_y"), other: tuple[str, str] = ("planar_x", "planar_y"), own_time: str = "local_time_s", other_time: str = "relative_time_s", key: str = "trial_id") -> DataFrame:
    """The alternative fit: the rotation between the directions in which both paths set out, on the mapped clock (``times``: scale_a, offset_b).

    The tracked path is interpolated at the mapped times of the telemetry, of samples at one time the first counts, and both paths run over
    the rows where both are known. A path's direction is that from its start to the first row at which it has come the set distance; a path
    shorter than that goes to its last row. n is the number of such rows, and start_residual how far the two points lie apart after the
    rotation. With fewer than two rows, or where a path's point is its start, theta_rad is 0 and start_residual NULL. Every trial of the
    telemetry has a row.
    """
    mapped = telemetry.join(times.select(key, "scale_a", "offset_b"), key, "left").withColumn("__q", F.coalesce("scale_a", F.lit(1.0)) * F.col(own_time) + F.coalesce("offset_b", F.lit(0.0)))
    queries = mapped.select(key, "source_row_index", F.col(own_time).alias("__own"), F.col("__q").alias("t"), F.col(own[0]).alias("ex"), F.col(own[1]).alias("ey"))
    samples = tracking.select(key, F.col(other_time).alias("t"), F.col(other[0]).alias("vx"), F.col(other[1]).alias("vy"), "source_row_index").filter("t is not null and vx is not null and vy is not null")
    first = samples.groupBy(key, "t").agg(F.min_by(F.struct("vx", "vy"), "source_row_index").alias("p")).select(key, "t", "p.vx", "p.vy")
    matched = asof.linear(queries, first, ["vx", "vy"]).filter("valid and ex is not null and ey is not null").select(key, "source_row_index", "__own", "ex", "ey", F.col("ref_vx").alias("vx"), F.col("ref_vy").alias("vy"))
    run = path_length(path_length(matched, "ex", "ey", "__e", "__own", key), "vx", "vy", "__v", "__own", key)
    place = F.struct("__own", "source_row_index")

    def reached(x: str, y: str, way: str) -> Column:
        """The point that ends a path's first stretch, and when it is reached."""
        point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), place.alias("at"))
        return F.coalesce(F.min_by(point, F.when(F.col(way) >= s.heading_distance_m, place)), F.max_by(point, place))

    ends = run.groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.struct("ex", "ey", "vx", "vy", place.alias("at")), place).alias("o"), reached("ex", "ey", "__e").alias("e"), reached("vx", "vy", "__v").alias("v"))
    step = lambda p, axis: F.col(f"{p}.{axis}") - F.col(f"o.{p}{axis}")
    usable = (F.col("n") >= 2) & (F.col("e.at") != F.col("o.at")) & (F.col("v.at") != F.col("o.at"))
    theta = F.atan2(step("e", "y"), step("e", "x")) - F.atan2(step("v", "y"), step("v", "x"))
    turned = ends.withColumn("theta_rad", F.when(usable, theta).otherwise(0.0))
    c, d = F.cos("theta_rad"), F.sin("theta_rad")
    apart = F.hypot(c * step("v", "x") - d * step("v", "y") - step("e", "x"), d * step("v", "x") + c * step("v", "y") - step("e", "y"))
    fits = turned.select(key, "n", "theta_rad", F.when(usable, apart).alias("start_residual"), *[F.col(f"o.{c0}").alias(f"{c0}0") for c0 in ("ex", "ey", "vx", "vy")])
    every = telemetry.select(key).distinct().join(fits, key, "left")
    return every.withColumns({"n": F.coalesce("n", F.lit(0)), "theta_rad": F.coalesce("theta_rad", F.lit(0.0))})


def spatial(telemetry: DataFrame, tracking: DataFrame, times: DataFrame, s: Settings, key: str = "trial_id") -> DataFrame:
    """theta_rad, tx, ty, trajectory_residual and start_residual by the method of the settings, with the number and the hash of the rows that were fitted."""
    if s.spatial_method == "rigid":
        fits = spatial_fit(telemetry, tracking, times, s, key).withColumn("start_residual", F.lit(None).cast("double"))
    else:
        start = heading_fit(telemetry, tracking.withColumn("planar_y", -F.col("planar_y") if s.flip_y else F.col("planar_y")), times, s, key=key)
        c, d = F.cos("theta_rad"), F.sin("theta_rad")
        fits = start.select(key, "n", "theta_rad", "start_residual", (F.col("ex0") - c * F.col("vx0") + d * F.col("vy0")).alias("tx"), (F.col("ey0") - d * F.col("vx0") - c * F.col("vy0")).alias("ty"), F.lit(None).cast("double").alias("trajectory_residual"))
    known = telemetry.filter("local_time_s is not null and odometry_x is not null and odometry_y is not null")
    used = ordered_digests(known, [key], "source_row_index", "fit_source_key_count", "fit_source_key_hash")
    payload = F.to_json(F.struct(F.lit(s.spatial_method).alias("method"), F.col(key).cast("string").alias("trial"), F.lit(s.flip_y).alias("flip_y"), F.col("fit_source_key_hash").alias("keys")))
    return fits.join(used, key, "left").withColumns({"spatial_method": F.lit(s.spatial_method), "fit_hash": F.sha2(payload, 256)})


def plane_residual(df: DataFrame, columns: Sequence[str] = ("x", "y", "z"), key: str = "trial_id") -> DataFrame:
    """Column planarity_residual: the distance of each row to its trial's least-squares plane, positive on the side of the second axis."""
    fits = plane_fit(df, columns, key).select(key, "nx", "ny", "nz")
    centre = df.filter(" and ".join(f"{c} is not null" for c in columns)).groupBy(key).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    sign = F.when(F.col("ny") < 0, -1.0).otherwise(1.0)
    distance = sum((F.col(n) * (F.col(c) - F.col(f"__{c}")) for n, c in zip(("nx", "ny", "nz"), columns, strict=True)), F.lit(0.0))
    return df.join(fits.join(centre, key), key, "left").withColumn("planarity_residual", sign * distance).drop("nx", "ny", "nz", *[f"__{c}" for c in columns])


def plane_fit(samples: DataFrame, columns: Sequence[str] = ("x", "y", "z"), key: str = "trial_id") -> DataFrame:
    """Normal and root mean square distance of each trial's least-squares plane, from the moments' aggregates and a 3x3 eigenproblem."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    moments = samples.filter(" and ".join(f"{c} is not null" for c in columns)).groupBy(key).agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs])

    @F.pandas_udf("struct<nx:double,ny:double,nz:double,planarity_residual:double>")
    def solve(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.empty((len(xx), 3, 3))
        for (i, j), v in zip([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], (xx, xy, xz, yy, yz, zz), strict=True):
            m[:, i, j] = m[:, j, i] = v
        values, vectors = np.linalg.eigh(m)
        n = vectors[:, :, 0]
        return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "planarity_residual": np.sqrt(np.maximum(0, values[:, 0]))})

    return moments.select(key, solve(*[F.col(f"{a}_{b}") for a, b in pairs]).alias("p")).select(key, "p.*")


def overlap(telemetry: DataFrame, tracking: DataFrame, own_time: str, other_time: str, key: str = "trial_id") -> DataFrame:
    """Common time span of both streams of each trial."""
    a = telemetry.groupBy(key).agg(F.min(own_time).alias("a0"), F.max(own_time).alias("a1"))
    b = tracking.groupBy(key).agg(F.min(other_time).alias("b0"), F.max(other_time).alias("b1"))
    return a.join(b, key).select(key, F.greatest("a0", "b0").alias("overlap_start"), F.least("a1", "b1").alias("overlap_end"))


def align(telemetry: DataFrame, tracking: DataFrame, params: DataFrame, s: Settings, method: str = "spline", key: str = "trial_id") -> DataFrame:
    """Telemetry rows on the tracking's clock and plane, within the common span: reference position, residuals and phase.

    ``params`` has a row for each trial: scale_a, offset_b, theta_rad, tx, ty.
    """
    mapped = telemetry.join(params, key).withColumn("t_common_s", F.col("scale_a") * F.col("local_time_s") + F.col("offset_b"))
    span = tracking.groupBy(key).agg(F.min("relative_time_s").alias("__v0"), F.max("relative_time_s").alias("__v1"))
    inside = mapped.join(span, key).filter(F.col("t_common_s").between(F.col("__v0"), F.col("__v1"))).drop("__v0", "__v1")
    samples = tracking.select(key, "source_row_index", F.col("relative_time_s").alias("t"), "planar_x", "planar_y")
    reference = query_reference(inside, samples, ["planar_x", "planar_y"], [method], query_time="t_common_s").select(key, "source_row_index", "ref_planar_x", "ref_planar_y", "valid")
    out = inside.join(reference, [key, "source_row_index"], "left")
    zero = F.lit(0.0)
    x, y = rotate_translate(F.col("ref_planar_x"), -F.col("ref_planar_y") if s.flip_y else F.col("ref_planar_y"), F.col("theta_rad"), zero, zero, F.col("tx"), F.col("ty"))
    out = out.withColumns({"vrmt_aligned_x": x, "vrmt_aligned_y": y})
    line = ordered("t_common_s")
    dt = difference(F.col("t_common_s"), line)
    speed = F.when(dt > 0, F.hypot(difference(F.col("vrmt_aligned_x"), line), difference(F.col("vrmt_aligned_y"), line)) / dt).otherwise(0.0)
    own = "speed_magnitude" if "speed_magnitude" in telemetry.columns else "motor_speed"
    turn = F.col("turn_rate") if "turn_rate" in telemetry.columns else F.lit(0.0)
    dx, dy = F.col("odometry_x") - F.col("vrmt_aligned_x"), F.col("odometry_y") - F.col("vrmt_aligned_y")
    out = out.withColumns({"residual_x": dx, "residual_y": dy, "residual_norm": F.hypot(dx, dy), "reference_speed": speed})
    out = out.withColumns({"sample_valid": F.col("residual_norm").isNotNull(), "movement_phase": aligned_phase(F.abs(F.col(own)), F.col("reference_speed"), turn), "scenario_id": scenario(F.col(key))})
    return out.drop("theta_rad", "tx", "ty", "scale_a", "offset_b", "valid")


def spatial_fit(telemetry: DataFrame, tracking: DataFrame, times: DataFrame, s: Settings, key: str = "trial_id") -> DataFrame:
    """Rigid fit from the flipped tracking plane to the odometry over the calibration rows, at the mapped times; residual of the fit."""
    mapped = telemetry.join(times.select(key, "scale_a", "offset_b"), key).withColumn("t", F.col("scale_a") * F.col("local_time_s") + F.col("offset_b"))
    y = -F.col("planar_y") if s.flip_y else F.col("planar_y")
    samples = tracking.select(key, F.col("relative_time_s").alias("t"), F.col("planar_x").alias("vx"), y.alias("vy"), "source_row_index").filter("t is not null and vx is not null and vy is not null")
    first = samples.groupBy(key, "t").agg(F.min_by(F.struct("vx", "vy"), "source_row_index").alias("p")).select(key, "t", "p.vx", "p.vy")
    matched = asof.linear(mapped.select(key, "source_row_index", "t", "odometry_x", "odometry_y"), first, ["vx", "vy"]).filter("valid")
    fits = rigid_fit(matched, ("ref_vx", "ref_vy"), ("odometry_x", "odometry_y"))
    back = apply_rigid(matched, fits, "ref_vx", "ref_vy", ("ax", "ay"))
    residual = back.groupBy(key).agg(F.sqrt(F.avg(F.pow(F.col("ax") - F.col("odometry_x"), F.lit(2)) + F.pow(F.col("ay") - F.col("odometry_y"), F.lit(2)))).alias("trajectory_residual"))
    return fits.join(residual, key, "left")
