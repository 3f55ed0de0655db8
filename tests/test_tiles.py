"""Sums over tiles are those over bonds, and no bonds are made for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators import density, neighbors, pmft, tiles
from swarmframe.plans import catalog


@pytest.fixture
def blocks(monkeypatch):
    """Small blocks and tiles, so that few points make many of them."""
    monkeypatch.setattr(tiles, "FEWEST", 20)
    monkeypatch.setattr(tiles, "CELL", 4)


def odd_points(spark, dims, n=400):
    """Two frames of points on a coarse lattice: at one place, with one id, beyond the box, without an angle or a place."""
    rng = np.random.default_rng(7)
    at = rng.integers(-64, 64, (n, 3)) / 8.0
    at[:, 2] *= dims == 3
    at[1], at[3] = at[0], at[2]
    at[4, 0] += 32
    rows = [(k % 2 + 5, 9 if k in (8, 10) else k, *map(float, v), None if k == 12 else float(k % 8) * np.pi / 4) for k, v in enumerate(at)]
    rows += [(5, 1_000, None, 0.0, 0.0, 0.0), (6, None, 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "frame int, point_id long, x double, y double, z double, theta double")


def flat(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("r", [1.9, 2.2])
@pytest.mark.parametrize("frames", [True, False])
def test_pmft_xy(spark, blocks, r, frames):
    p, box = odd_points(spark, 2), Box.square(16.0)
    p = p if frames else p.drop("frame")
    want = pmft.pmft_xy(neighbors.ball(p, box, r, carry=("theta",)), None, box, 9, 9, 1.5, 1.5, (12, 12))
    got = pmft.pmft_xy_within(p, box, 9, 9, r, 1.5, 1.5, (12, 12))
    columns = ("bin_x", "bin_y", "bin_count", "pcf", "pmft")
    assert flat(got, *columns) == flat(want, *columns) and got.agg(F.sum("bin_count")).first()[0] > 1_000


def without_bonds(spark, sf, name, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("bonds are made")

    monkeypatch.setattr(neighbors, "ball", refuse)
    return catalog.QUERIES[name](spark, sf)


def test_pmft_xy_makes_no_bonds(spark, sf, monkeypatch):
    assert without_bonds(spark, sf, "pmft_xy", monkeypatch).count() == 144


def test_frames_pmft_xy_makes_no_bonds(spark, sf, monkeypatch):
    assert without_bonds(spark, sf, "frames_pmft_xy", monkeypatch).count() == 144


@pytest.mark.parametrize("frames", [True, False])
def test_pmft_r12(spark, blocks, frames):
    p, box = odd_points(spark, 2), Box.square(16.0)
    p = p if frames else p.drop("frame")
    want = pmft.pmft_r12(neighbors.ball(p, box, 2.0, carry=("theta",)), None, None, box, 9, 9, 2.0, (4, 4, 4))
    got = pmft.pmft_r12_within(p, box, 9, 9, 2.0, 4)
    columns = ("bin_r", "bin_t1", "bin_t2", "bin_count", "pcf", "pmft")
    assert flat(got, *columns) == flat(want, *columns) and got.agg(F.sum("bin_count")).first()[0] > 1_000


def test_pmft_r12_makes_no_bonds(spark, sf, monkeypatch):
    assert without_bonds(spark, sf, "pmft_r12", monkeypatch).count() == 64


@pytest.mark.parametrize("frames", [True, False])
def test_correlation(spark, blocks, frames):
    p, box = odd_points(spark, 3), Box.cube(16.0)
    p = p.selectExpr("*", "CAST(point_id % 17 AS DOUBLE) AS re", "CAST(point_id % 5 AS DOUBLE) AS im")
    want = density.correlation(neighbors.ball(p, box, 3.0, carry=("re", "im")), None, None, 6, 3.0, per_frame=frames)
    got = density.correlation_within(p, box, 6, 3.0, per_frame=frames)
    columns = ["frame"] * frames + ["bin", "bin_count", "re", "im"]
    assert flat(got, *columns) == flat(want, *columns)


def test_frames_correlation_makes_no_bonds(spark, sf, monkeypatch):
    got = without_bonds(spark, sf, "frames_correlation", monkeypatch)
    assert got.count() == 6 * got.select("frame").distinct().count() > 0


def test_correlation_of_a_frame_without_bonds(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 2.0, 1.0)], "frame long, point_id long, x double, y double, z double, re double, im double")
    assert flat(density.correlation_within(p, Box.cube(16.0), 6, 3.0, per_frame=True), "frame", "bin", "bin_count", "re", "im") == [(1, k, 0, 0.0, 0.0) for k in range(6)]
