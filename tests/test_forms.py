"""Forms and parameters of operators that the catalogue's queries leave at their defaults."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators import cluster, density, environment, neighbors, order, pmft
from swarmframe.sources.points import lattice, periodic_buffer, random_system

POINT = "point_id long, x double, y double, z double"
QUAT = "point_id long, qw double, qx double, qy double, qz double"


def test_own_bonds(spark):
    rows = spark.createDataFrame([(0, 1, 3.0, 0.0, 4.0), (1, 0, 0.0, -2.0, 0.0)], "i long, j long, dx double, dy double, dz double")
    out = neighbors.from_arrays(rows, 2, 2).orderBy("i").collect()
    assert [(r["distance"], r["weight"]) for r in out] == [(5.0, 1.0), (2.0, 1.0)]
    weighted = neighbors.from_arrays(rows.withColumn("weight", F.lit(0.5)), 2, 2).first()
    assert weighted["weight"] == 0.5
    for n_queries, n_points in ((1, 2), (2, 1)):
        with pytest.raises(ValueError):
            neighbors.from_arrays(rows, n_queries, n_points)
    assert neighbors.from_arrays(rows.limit(0), 0, 0).count() == 0
    for low, high in ((0.0, 0.0), (-1.0, 1.0), (2.0, 1.0)):
        with pytest.raises(ValueError):
            neighbors.filter_r(rows, high, low)


def test_buffers(spark):
    box, p = random_system(spark, 4, 20, seed=5)
    wide, out = periodic_buffer(p, box, 1, images=True)
    assert (wide.Lx, wide.Ly, wide.Lz) == (8, 8, 8) and out.count() == 20 * 7
    wide, out = periodic_buffer(p, box, (1, 0, 2), images=True, include_input=True)
    rows = out.collect()
    assert (wide.Lx, wide.Ly, wide.Lz) == (8, 4, 12) and len(rows) == 20 * 6
    assert all(abs(r["x"]) <= 4 and abs(r["y"]) <= 2 and abs(r["z"]) <= 6 for r in rows)
    wide, out = periodic_buffer(p, box, 1.5, include_input=True)
    at = np.array([[r["x"], r["y"], r["z"]] for r in p.collect()])
    shifts = 4.0 * np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    inside = (np.abs(at[:, None] + shifts) < 3.5).all(axis=2).sum()
    assert wide.Lx == 7 and out.count() == inside


def test_distributions(spark):
    """g(r) of a random system is about 1, with a lower limit too; the factor for finite systems; several frames."""
    box, p = random_system(spark, 10, 600, seed=1)
    bonds = cluster.save(neighbors.ball(p, box, 3.0))
    for low in (0.0, 1.0):
        g = [r["g_r"] for r in density.rdf(bonds, box, 600, 600, 5, 3.0, low).collect() if r["bin"]]
        assert np.allclose(g, 1, atol=0.1)
    a, b = (density.rdf(bonds, box, 600, 600, 5, 3.0, finite_size=f).orderBy("bin").collect() for f in (False, True))
    assert all(y["g_r"] == pytest.approx(x["g_r"] * 600 / 599) for x, y in zip(a, b, strict=True))
    twice = density.rdf(bonds.unionByName(bonds), box, 600, 600, 5, 3.0, n_frames=2).orderBy("bin").collect()
    assert [r["g_r"] for r in twice] == [pytest.approx(r["g_r"]) for r in a] and [r["n_r"] for r in twice] == [pytest.approx(r["n_r"]) for r in a]
    assert density.bin_edges(1.0, 3.0, 4) == [1, 1.5, 2, 2.5, 3] and density.bin_centers(1.0, 3.0, 2) == [1.5, 2.5]


def test_potentials(spark):
    box, p = random_system(spark, 8, 60, is2d=True, seed=2)
    bonds = cluster.save(neighbors.ball(p, box, 2.0))
    turn = p.select("point_id", F.lit(0.3).alias("theta"))
    rows = pmft.pmft_xy(bonds, turn, box, 60, 60, 1.0, 1.0, (3, 3)).collect()
    assert all(r["pmft"] == (pytest.approx(-math.log(r["pcf"])) if r["bin_count"] else math.inf) for r in rows)
    empty = pmft.pmft_xy(bonds.limit(0), turn, box, 60, 60, 1.0, 1.0, (3, 3)).collect()
    assert len(empty) == 9 and {r["pmft"] for r in empty} == {math.inf}
    q = p.select("point_id", F.lit(1.0).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"))
    deep = Box(8, 8, 8)
    one, two = (pmft.pmft_xyz(bonds, q, deep, 60, 60, (1.0, 1.0, 1.0), (4, 4, 1), e).orderBy("bin_x", "bin_y").collect() for e in (((1, 0, 0, 0),), ((1, 0, 0, 0), (1, 0, 0, 0))))
    assert [r["pcf"] for r in one] == [pytest.approx(r["pcf"]) for r in two] and [2 * r["bin_count"] for r in one] == [r["bin_count"] for r in two]
    half = math.sqrt(0.5)  # a quarter turn about z moves the histogram's quarters
    turned = pmft.pmft_xyz(bonds, q, deep, 60, 60, (1.0, 1.0, 1.0), (2, 2, 1), ((half, 0, 0, half),)).collect()
    plain = {(r["bin_x"], r["bin_y"]): r["bin_count"] for r in pmft.pmft_xyz(bonds, q, deep, 60, 60, (1.0, 1.0, 1.0), (2, 2, 1)).collect()}
    assert {(r["bin_x"], r["bin_y"]): r["bin_count"] for r in turned} == {(1 - y, x): n for (x, y), n in plain.items()}
    moved = pmft.shifted(p, box, (3.0, 0.0, 0.0))
    d = neighbors.ball(p, box, 0.5, queries=moved).where("i = j").count()
    assert d == 0 and moved.where("abs(x) > 4").count() == 0


def test_equivalent_orientations(spark):
    half = math.sqrt(0.5)
    q = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0), (1, half, 0.0, 0.0, half)], QUAT)
    bonds = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0, 1.0, 1.0)], "i long, j long, dx double, dy double, dz double, distance double, weight double")
    quarter = ((1, 0, 0, 0), (half, 0, 0, half), (0, 0, 0, 1), (half, 0, 0, -half))
    assert environment.angular_separation(bonds, q).first()["angle"] == pytest.approx(math.pi / 2)
    assert environment.angular_separation(bonds, q, equivalent=quarter).first()["angle"] == pytest.approx(0, abs=1e-6)
    assert all(r["angle"] == pytest.approx(0, abs=1e-6) for r in environment.angular_separation_global(q, [(1, 0, 0, 0)], quarter).collect())
    # in the neighbour's frame the bond points along -y
    out = environment.bond_projection(bonds.withColumn("dx", F.lit(2.0)).withColumn("distance", F.lit(2.0)), q, [(0, 1, 0), (1, 0, 0)]).orderBy("projection").collect()
    assert [(round(r["value"], 9), round(r["normed"], 9) + 0.0) for r in out] == [(-2.0, -1.0), (0.0, 0.0)]
    best = environment.bond_projection(bonds, q, [(0, 1, 0)], quarter).first()
    assert best["value"] == pytest.approx(1)


def test_orders_with_weights(spark):
    box, p = lattice(spark, "hex", (6, 6))
    bonds = cluster.save(neighbors.ball(p, box, 1.1))
    assert all(r["re"] ** 2 + r["im"] ** 2 == pytest.approx(1) for r in order.hexatic(p, bonds).collect())
    assert all(r["re"] ** 2 + r["im"] ** 2 == pytest.approx(0, abs=1e-9) for r in order.hexatic(p, bonds, 4).collect())
    one = bonds.withColumn("weight", F.when(F.col("dx") > 0.9, 1.0).otherwise(0.0))
    assert all(r["re"] == pytest.approx(1) for r in order.hexatic(p, one, 4, weighted=True).collect())
    box, p = lattice(spark, "fcc", 3, scale=2)
    bonds = cluster.save(neighbors.ball(p, box, 1.5))
    both = order.steinhardt(p, bonds, [4, 6]).collect()
    assert all(r["q4"] == pytest.approx(0.19094065) and r["q6"] == pytest.approx(0.57452416) for r in both)
    doubled = order.steinhardt(p, bonds.withColumn("weight", F.lit(2.0)), 6, weighted=True).first()["q"]
    assert doubled == pytest.approx(0.57452416) and order.steinhardt_system(p, bonds, 6).first()["q"] == pytest.approx(0.57452416)


def test_nematic_by_frame(spark):
    rng = np.random.default_rng(3)
    rows = [(f, i, *map(float, rng.standard_normal(3) + (3 * f, 0, 0))) for f in (0, 2) for i in range(50)]
    d = spark.createDataFrame(rows, "frame long, point_id long, ux double, uy double, uz double")
    found = {r["frame"]: r for r in order.nematic_order(d).collect()}
    for f in (0, 2):
        value, director, _ = order.nematic(d.where(f"frame = {f}").drop("frame"))
        assert found[f]["order"] == pytest.approx(value) and abs(np.dot(director, [found[f][k] for k in ("ux", "uy", "uz")])) == pytest.approx(1)
    assert order.nematic_particles(d).count() == 100


def test_densities_by_frame(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (2, 0, 1.0, 0.0, 0.0), (2, 1, 1.0, 0.5, 0.0)]
    p = spark.createDataFrame(rows, f"frame long, {POINT}")
    cells = {(r["frame"], r["ix"], r["iy"]) for r in density.sphere_voxelization(p, Box.square(4), 4, 0.8).collect()}
    assert {f for f, _, _ in cells} == {1, 2} and cells == {(f, x, y) for f, px, py in ((1, 0, 0), (2, 1, 0), (2, 1, 0.5)) for x in range(4) for y in range(4) if math.dist(((x - 1.5 - px + 2) % 4 - 2, (y - 1.5 - py + 2) % 4 - 2), (0, 0)) < 0.8}
    whole = density.gaussian_density(p, Box.square(4), 4, 1.9, 0.5, empty=True).groupBy("frame").agg(F.count("*").alias("n"), F.sum("density").alias("s")).collect()
    assert {r["frame"]: r["n"] for r in whole} == {1: 16, 2: 16}
    near = {r["point_id"]: r["num_neighbors"] for r in density.local_density(p.where("frame = 2"), Box.square(4), 1.0, 0.2).collect()}
    assert near == {0: 1.0, 1: 1.0}
