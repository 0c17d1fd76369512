"""The fit by starting directions, case by case."""

import math

import pytest

from gaugeline.config import Settings
from gaugeline.operators import alignment


def fit(spark, own, other, scale=1.0, offset=0.0, distance=0.5):
    """own: (time, x, y), other: (time, x, y), both in the order of their rows; None for unknown."""
    e = spark.createDataFrame([("a", k, *map(num, r)) for k, r in enumerate(own)], "trial_id string, source_row_index long, local_time_s double, odometry_x double, odometry_y double")
    v = spark.createDataFrame([("a", k, *map(num, r)) for k, r in enumerate(other)], "trial_id string, source_row_index long, relative_time_s double, planar_x double, planar_y double")
    times = spark.createDataFrame([("a", scale, offset)], "trial_id string, scale_a double, offset_b double")
    return alignment.heading_fit(e, v, times, Settings(heading_distance_m=distance)).first()


def num(x):
    return None if x is None else float(x)


LINE = [(k, 0.1 * k, 0) for k in range(20)]


def test_the_clock_is_applied_before_directions_are_taken(spark):
    # At the mapped times the tracked path goes straight up; at the raw ones it would still go along x.
    tracked = [(k, 0.1 * k, 0) for k in range(10)] + [(10 + k, 0.9, 0.1 * (k + 1)) for k in range(30)]
    r = fit(spark, LINE, tracked, offset=10.0)
    assert (r["n"], r["theta_rad"], r["start_residual"]) == (20, pytest.approx(-math.pi / 2), pytest.approx(0, abs=1e-12))
    assert (r["ex0"], r["vx0"], r["vy0"]) == (0, pytest.approx(0.9), pytest.approx(0.1))


def test_a_shorter_path_goes_to_its_last_row(spark):
    r = fit(spark, LINE, [(k, 0, 0.01 * k) for k in range(20)])
    assert r["theta_rad"] == pytest.approx(-math.pi / 2) and r["start_residual"] == pytest.approx(0.5 - 0.19)


def test_degenerate_starts_have_no_rotation(spark):
    for own, other, n in (([], LINE, None), (LINE[:1], LINE, 1), (LINE, [], 0), ([(50, 0, 0), (51, 1, 0)], LINE, 0), ([(0, None, 1), (1, 1, 2)], LINE, 1)):
        r = fit(spark, own, other)
        if n is None:
            assert r is None
        else:
            assert (r["n"], r["theta_rad"], r["start_residual"]) == (n, 0.0, None)
    r = fit(spark, LINE, LINE, distance=0.0)
    assert (r["theta_rad"], r["start_residual"], r["ex0"]) == (0.0, None, 0.0)


def test_of_samples_at_one_time_the_first_counts(spark):
    tracked = [(t, x, y) for k in range(20) for t, x, y in ((k, 0.1 * k, 0), (k, 99, 99))]
    assert fit(spark, LINE, tracked)["theta_rad"] == pytest.approx(0)


def test_standing_still_counts_as_its_last_row(spark):
    r = fit(spark, LINE, [(k, 1, 1) for k in range(20)])
    assert r["theta_rad"] == 0.0 and r["start_residual"] == pytest.approx(0.5)
