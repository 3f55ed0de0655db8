"""Known values of small systems and crystals."""

import math

import numpy as np
import pytest

from swarmframe.functions.box import Box
from swarmframe.functions.sph import wigner3j
from swarmframe.operators import cluster, density, neighbors, order
from swarmframe.sources.points import lattice, random_system, read_xyz


def table(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "point_id long, x double, y double, z double")


FOUR = [(0, 0, 0), (1, 0, 0), (3, 0, 0), (2, 0, 0)]


def test_ball_of_four(spark):
    p, box = table(spark, FOUR), Box.cube(10)
    n = {r["i"]: r["n"] for r in neighbors.neighbor_counts(neighbors.ball(p, box, 2.01, exclude_ii=False), p).collect()}
    assert [n[i] for i in range(4)] == [3, 4, 3, 4]
    assert neighbors.ball(p, box, 2.01).count() == 10
    with pytest.raises(ValueError):
        neighbors.ball(p, box, 5)


def test_nearest_of_four(spark):
    p, box = table(spark, FOUR), Box.cube(10)
    got = neighbors.nearest(p, box, 3, exclude_ii=False).collect()
    sets = [{r["j"] for r in got if r["i"] == i} for i in range(4)]
    assert sets == [{0, 1, 3}, {0, 1, 3}, {1, 2, 3}, {1, 2, 3}]
    assert neighbors.nearest(p, box, 5).count() == 12


@pytest.mark.parametrize("box", [Box.cube(10), Box(10, 9, 11, 0.3, -0.2, 0.4)])
def test_brute_force(spark, box):
    rng = np.random.default_rng(5)
    f = rng.random((40, 3)) - 0.5
    at = f @ np.array(box.lattice_vectors)
    p = table(spark, at)
    shifts = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]) @ np.array(box.lattice_vectors)
    d = np.linalg.norm(at[None, :, None] - at[:, None, None] + shifts, axis=-1).min(-1)
    r = 0.49 * min(box.plane_distances) - 1
    want = {(i, j) for i in range(40) for j in range(40) if i != j and d[i, j] < r}
    assert {(b["i"], b["j"]) for b in neighbors.ball(p, box, r).collect()} == want


def test_fcc_order(spark):
    box, p = lattice(spark, "fcc", 4, scale=2)
    bonds = neighbors.ball(p, box, 1.5)
    q = [r["q"] for r in order.steinhardt(p, bonds, 6).collect()]
    assert len(q) == 256 and np.allclose(q, 0.57452416, atol=1e-5)
    w = [r["w"] for r in order.steinhardt_w(p, bonds, 6).collect()]
    assert np.allclose(w, -0.00262604, atol=1e-5)
    _, out = order.solid_liquid(p, bonds, 6, 0.7, 6)
    rows = out.collect()
    assert {r["num_connections"] for r in rows} == {12} and {r["cluster"] for r in rows} == {0}


@pytest.mark.parametrize(("name", "n"), [("bcc", 14), ("fcc", 12)])
def test_shells(spark, name, n):
    box, p = lattice(spark, name, 4, noise=1e-4, seed=1)
    bonds = neighbors.ball(p, box, 1.49)
    for found in (neighbors.sann(bonds), neighbors.rad(bonds)):
        assert {r["n"] for r in neighbors.neighbor_counts(found, p).collect()} == {n}


def test_lone_particle(spark):
    p = table(spark, [(0, 0, 0)])
    bonds = neighbors.ball(p, Box.cube(10), 1.5)
    assert math.isnan(order.steinhardt(p, bonds, 6).first()["q"])
    assert density.local_density(p, Box.cube(10), 2, 1).first()["num_neighbors"] == 0


def test_cluster_properties(spark):
    p = table(spark, [(0, -2, 0), (0, -2, 0), (0, 2, 0), (-0.1, 1.9, 0)])
    masses = spark.createDataFrame([(i, i + 1.0) for i in range(4)], "point_id long, mass double")
    box = Box.square(5)
    assigned = cluster.clusters(p, neighbors.ball(p, box, 0.5))
    out = {r["cluster"]: r for r in cluster.properties(p.join(masses, "point_id"), assigned, box, "mass").collect()}
    assert out[1]["com_x"] == pytest.approx(-0.057143, abs=1e-5) and out[1]["com_y"] == pytest.approx(1.942857, abs=1e-5)
    assert [r["keys"] for r in cluster.cluster_keys(assigned).orderBy("cluster").collect()] == [[0, 1], [2, 3]]


def test_gaussian_mass(spark):
    box, p = random_system(spark, 10, 10, seed=3)
    total = density.gaussian_density(p, box, 20, 4.9, 1.0).agg({"density": "sum"}).first()[0] * (10 / 20) ** 3
    assert total == pytest.approx(10, rel=1e-3)


def test_directors_and_cubatic(spark):
    d = spark.createDataFrame([(1.0, 0.0, 0.0)] * 50, "ux double, uy double, uz double")
    value, director, tensor = order.nematic(d)
    assert value == pytest.approx(1) and abs(director[0]) == pytest.approx(1) and tensor[1, 1] == pytest.approx(-0.5)
    rng = np.random.default_rng(0)
    q = [(i, math.cos(t / 2), 0.0, 0.0, math.sin(t / 2)) for i, t in enumerate(rng.uniform(0, 0.05, 200))]
    rows = spark.createDataFrame(q, "point_id long, qw double, qx double, qy double, qz double")
    assert order.cubatic(rows)[0] == pytest.approx(1, abs=0.02)
    same = order.rotational_autocorrelation(rows, rows, 2).collect()
    assert np.allclose([r["order"] for r in same], 1)


def test_wigner():
    assert wigner3j(2, 0, 0) == pytest.approx(-math.sqrt(2 / 35))


def test_xyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\nfirst\nC 0 0 0\nO 1 0 0\n1\nsecond\nC 0.5 1 2\n")
    rows = read_xyz(spark, str(tmp_path)).orderBy("frame", "point_id").collect()
    assert [(r["frame"], r["point_id"], r["element"], r["z"]) for r in rows] == [(0, 0, "C", 0.0), (0, 1, "O", 0.0), (1, 0, "C", 2.0)]


def test_stream_equals_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from swarmframe.plans.catalog import CUBE, events_frames
    from swarmframe.streaming.frames import RdfAccumulator

    frames = events_frames(spark, sf).where("frame < 4").select("frame", "point_id", "x", "y", "z")
    for k in range(1, 4):
        frames.where(F.col("frame") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    acc = RdfAccumulator(CUBE, 3.0, 6)
    q = acc.start(stream, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    whole = density.rollup_rdf(neighbors.ball(frames, CUBE, 3.0), 6, 3.0).where("frame IS NULL")
    want = {r["bin"]: r["bin_count"] for r in whole.collect()}
    assert acc.counts() == [want.get(k, 0) for k in range(6)]


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_folder(tmp_path):
    """The rest imports and lists its queries when the training-data operators are deleted."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rdf' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
