"""Matching, registration, descriptors, diffraction, files, displacements, streams."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators import cluster, density, diffraction, environment, matching, msd, neighbors, order
from swarmframe.sources.points import lattice, oblique_cell, random_system, read_cif, rectangular_cell
from swarmframe.streaming.frames import RdfAccumulator, session_counts, sliding_counts, windowed_counts

POINT = "point_id long, x double, y double, z double"


def turn(axis, angle):
    axis = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)


def test_registration_finds_rotations():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 6, 9):
        ref = rng.standard_normal((n, 3))
        moved = (ref @ turn(rng.standard_normal(3), 1.1).T)[rng.permutation(n)]
        rmsd, rotation, chosen = matching.register(ref, moved)
        assert rmsd < 1e-6 and np.allclose(moved @ rotation.T, ref[chosen], atol=1e-6)
        assert np.linalg.det(rotation) == pytest.approx(1) and sorted(chosen) == list(range(n))
    with pytest.raises(ValueError):
        matching.register(np.zeros((2, 3)), np.zeros((3, 3)))


def test_similar_sets():
    a = np.array([(1.0, 0, 0), (0, 1, 0), (0, 0, 1)])
    assert matching.similar(a, a[[2, 0, 1]] + 0.01, 0.1)[1].tolist() == [1, 2, 0]
    assert matching.similar(a, a[:2], 0.1) is None and matching.similar(a, a + [0.2, 0, 0], 0.1) is None
    turned = a @ turn((1, 2, 3), 0.7).T
    assert matching.similar(a, turned, 0.1) is None and matching.similar(a, turned, 0.1, registration=True) is not None
    assert matching.minimize_rmsd(a, a[:2])[0] == -1 and matching.minimize_rmsd(a, a + [0.3, 0, 0])[0] == pytest.approx(0.3)


def test_crystals_are_one_environment(spark):
    for name, r, size in (("bcc", 1.2, 14), ("fcc", 0.8, 12), ("sc", 1.2, 6)):
        box, p = lattice(spark, name, 4)
        bonds = cluster.save(neighbors.ball(p, box, r))
        found = matching.environment_clusters(p, bonds, bonds, 0.1)
        assert {x["cluster"] for x in found.collect()} == {0}
        mean = matching.cluster_environments(p, bonds, found).collect()
        assert len(mean) == size and sum(abs(x["dx"] + x["dy"] + x["dz"]) for x in mean) > 0
        motif = [(x["dx"], x["dy"], x["dz"]) for x in mean]
        assert {x["matches"] for x in matching.motif_match(p, bonds, motif, 0.01, box=box).collect()} == {True}
        turned = np.array(motif) @ turn((1, 1, 0), 0.4).T
        if size == 6:
            assert max(x["rmsd"] for x in matching.motif_rmsd(p.limit(4), bonds, turned, registration=True).collect()) < 1e-5
    lone = spark.createDataFrame([(7, 0.0, 0.0, 0.0)], POINT)
    none = neighbors.ball(lone, box, 0.5)
    assert matching.motif_rmsd(lone, none, motif).first()["rmsd"] == -1 and not matching.motif_match(lone, none, motif, 1.0).first()["matches"]


def test_descriptors_give_steinhardt(spark):
    """Averages of a point's descriptors are its q_lm, in any axes."""
    box, p = random_system(spark, 6, 60, seed=2)
    bonds = cluster.save(neighbors.nearest(p, box, 6))
    want = {r["point_id"]: r["q"] for r in order.steinhardt(p, bonds, 4).collect()}
    q = spark.createDataFrame([(i, *(np.array(v) / np.linalg.norm(v)).tolist()) for i, v in enumerate(np.random.default_rng(3).standard_normal((60, 4)))], "point_id long, qw double, qx double, qy double, qz double")
    for mode, orientations in (("global", None), ("particle_local", q), ("neighborhood", None)):
        y = environment.local_descriptors(bonds, 4, True, mode, orientations).where("l = 4")
        got = y.groupBy("i", "m").agg(F.avg("re").alias("re"), F.avg("im").alias("im")).groupBy("i").agg(F.sqrt(4 * math.pi / 9 * F.sum(F.expr("re * re + im * im"))).alias("q"))
        assert {r["i"]: pytest.approx(r["q"], abs=1e-9) for r in got.collect()} == want
    assert environment.local_descriptors(bonds, 2, False, "global", max_num_neighbors=2).count() == 60 * 2 * 6
    with pytest.raises(ValueError):
        environment.local_descriptors(bonds, 2, mode="other")


def test_frames_are_apart(spark):
    """Two frames together give what each gives alone."""
    box = Box.cube(5)
    rng = np.random.default_rng(6)
    rows = [(f, i, *map(float, rng.random(3) * 5 - 2.5)) for f in (3, 9) for i in range(40)]
    both = spark.createDataFrame(rows, f"frame long, {POINT}")
    bonds = cluster.save(neighbors.ball(both, box, 1.4))
    _, solid = order.solid_liquid(both, bonds, 6, 0.2, 1)
    made = {
        "clusters": cluster.clusters(both, bonds),
        "hexatic": order.hexatic(both, bonds),
        "average": order.steinhardt(both, bonds, 4, average=True),
        "w": order.steinhardt_w(both, bonds, 4),
        "solid": solid,
        "system": order.steinhardt_system(both, bonds, 4),
        "properties": cluster.properties(both, cluster.clusters(both, bonds), box).select("frame", "cluster", "size", F.round("radius_of_gyration", 9)),
        "rdf": density.rdf(bonds, box, 40, 40, 5, 1.4, per_frame=True),
        "axes": environment.neighborhood_axes(bonds),
        "limited": neighbors.limited(bonds, 2),
        "nearest": neighbors.nearest(both, box, 3),
    }
    plain = lambda df: Counter(tuple(round(v, 7) + 0.0 if isinstance(v, float) and not math.isnan(v) else repr(v) for v in r) for r in df.collect())
    for f in (3, 9):
        p = both.where(f"frame = {f}").drop("frame")
        b = cluster.save(neighbors.ball(p, box, 1.4))
        _, s = order.solid_liquid(p, b, 6, 0.2, 1)
        alone = {
            "clusters": cluster.clusters(p, b), "hexatic": order.hexatic(p, b), "average": order.steinhardt(p, b, 4, average=True), "w": order.steinhardt_w(p, b, 4), "solid": s, "system": order.steinhardt_system(p, b, 4),
            "properties": cluster.properties(p, cluster.clusters(p, b), box).select("cluster", "size", F.round("radius_of_gyration", 9)), "rdf": density.rdf(b, box, 40, 40, 5, 1.4),
            "axes": environment.neighborhood_axes(b), "limited": neighbors.limited(b, 2), "nearest": neighbors.nearest(p, box, 3),
        }
        for name, want in alone.items():
            got = made[name].where(f"frame = {f}").drop("frame").select(*want.columns)
            assert plain(got) == plain(want), (name, f)


def test_bonds_are_the_same_in_all_ways(spark):
    """Half of the bonds mirrored, small and large cells, carried columns, rows without a place."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.random(3) * 12 - 6)) for i in range(150)] + [(900, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, POINT).withColumn("v", F.col("point_id") * 2)
    for r in (0.9, 2.5, 5.9):
        whole = {(b["i"], b["j"]): b for b in neighbors.ball(p, Box.cube(12), r, carry=("v",)).collect()}
        half = neighbors.ball(p, Box.cube(12), r, half=True).collect()
        assert 2 * len(half) == len(whole) and {(b["i"], b["j"]) for b in half} | {(b["j"], b["i"]) for b in half} == set(whole)
        two = {(b["i"], b["j"]) for b in neighbors.ball(p, Box.cube(12), r, queries=p, exclude_ii=True).collect()}
        assert two == set(whole)
        assert all(b["i_v"] == 2 * b["i"] and b["j_v"] == 2 * b["j"] and whole[b["j"], b["i"]]["dx"] == -b["dx"] for b in whole.values())
        assert neighbors.ball(p, Box.cube(12), r, exclude_ii=False).count() == len(whole) + 150
    with pytest.raises(ValueError):
        neighbors.all_pairs(p, Box.cube(12), most=100)


def test_shells_that_do_not_close(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], POINT)
    bonds = neighbors.ball(p, Box.cube(10), 2.0)
    for shell in (neighbors.sann, neighbors.rad):
        assert shell(bonds).count() == 2 and shell(bonds, incomplete="drop").count() == 0
        with pytest.raises(Exception, match="not full"):
            shell(bonds, incomplete="raise").collect()


def test_zero_bond_points_along_z(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0)], POINT)
    q = [r["q"] for r in order.steinhardt(p, neighbors.ball(p, Box.cube(10), 1.0), 6).orderBy("point_id").collect()]
    assert q[0] == pytest.approx(q[1]) and 0 < q[0] < 1 and q[2] == pytest.approx(1)


def test_diffraction_of_a_lattice(spark):
    box, p = lattice(spark, "sc", 16)
    for grid, output, zoom in ((64, 64, 1.0), (64, 65, 2.0)):
        rows = diffraction.diffraction_pattern(p, box, grid, output, zoom=zoom, peak_width=0.0).collect()
        im = np.zeros((output, output))
        for r in rows:
            im[r["row"], r["col"]] = r["s"]
        assert im[output // 2, output // 2] == pytest.approx(16**3)
        k = diffraction.pattern_k_values(box, output, zoom)
        assert abs(k[output // 2]) < 1e-9 or output % 2
        if zoom == 1.0:
            peaks = np.argwhere(im > 1)
            assert all(((at - 32) % 16 == 0).all() for at in peaks) and len(peaks) == 16
    with pytest.raises(ValueError):
        diffraction.diffraction_pattern(p, Box(16, 16, 8), 8)
    assert len(diffraction.pruned_vectors(diffraction.reciprocal_vectors(box, 9.0), box, 200)) == pytest.approx(200, rel=0.3)


def test_bessel(spark):
    x = np.linspace(0, 60, 400)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", diffraction.bessel_j0(F.col("x")).alias("j")).collect()
    t = (np.arange(400) + 0.5) * math.pi / 400
    assert all(abs(r["j"] - np.cos(r["x"] * np.sin(t)).mean()) < 2e-7 for r in got)


def test_cells(spark, tmp_path):
    box, p = lattice(spark, rectangular_cell(2.0, centered=True), (3, 3))
    assert (box.Lx, box.Ly) == (3, 6) and p.count() == 18
    box, p = lattice(spark, oblique_cell(1.0, 60.0), (6, 6))
    n = neighbors.neighbor_counts(neighbors.ball(p, box, 1.2), p).collect()
    assert {r["n"] for r in n} == {6}
    box, p = lattice(spark, "graphene", (6, 6))
    assert {r["n"] for r in neighbors.neighbor_counts(neighbors.ball(p, box, 0.7), p).collect()} == {3}
    (tmp_path / "a.cif").write_text("data_x\n_cell_length_a 4.0(1)\n_cell_length_b 4\n_cell_length_c 4\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90.0\nloop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\n'-x,-y,z'\n'x+1/2, y+1/2, z'\n'-x+1/2,-y+1/2,z'\n\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nA 0 0 0\nB 0.25(2) 0 0.5\n")
    box, p = read_cif(spark, str(tmp_path / "a.cif"))
    at = sorted((round(r["x"] + 0.0, 6), round(r["y"] + 0.0, 6), round(r["z"] + 0.0, 6)) for r in p.collect())
    assert box.Lx == 4 and at == sorted([(0, 0, 0), (-2, -2, 0), (1, 0, -2), (-1, 0, -2), (-1, -2, -2), (1, -2, -2)])


def test_displacements(spark):
    rows = [(p, f, float(f % 5) - 2, 0.0, 0.0, f // 5, 0, 0) for p in range(3) for f in range(12 if p else 6)]
    t = spark.createDataFrame(rows, "particle long, frame long, x double, y double, z double, ix int, iy int, iz int")
    flat = msd.unwrapped(t, Box.cube(5))
    direct = {r["frame"]: r["msd"] for r in msd.msd_direct(flat).collect()}
    assert direct == {f: pytest.approx(f * f) for f in range(12)}
    window = {r["lag"]: r["msd"] for r in msd.msd_window(flat).collect()}
    assert window == {f: pytest.approx(f * f, abs=1e-6) for f in range(12)}
    each = {(r["particle"], r["frame"]): r["msd"] for r in msd.msd_particles(flat).collect()}
    assert len(each) == 30 and each[0, 5] == pytest.approx(25)


def test_windows_over_streams(spark, tmp_path):
    """Tumbling, sliding and session windows close behind the watermark; what comes later is dropped."""
    batches = [[("a", "00:00:01"), ("a", "00:00:04"), ("b", "00:00:07")], [("a", "00:00:21"), ("b", "00:00:22")], [("a", "00:00:02"), ("b", "00:01:40")], [("z", "00:02:59")]]
    rows = lambda b: spark.createDataFrame([(k, f"2024-01-01 {t}", float(i % 2)) for i, (k, t) in enumerate(b)], "key string, at string, value double").withColumn("at", F.to_timestamp("at"))
    for n, b in enumerate(batches):
        rows(b).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    made = {
        "tumbling": lambda s: windowed_counts(s, "at", "10 seconds", "5 seconds", 2, 0.0, 2.0),
        "sliding": lambda s: sliding_counts(s, "at", "10 seconds", "5 seconds", "5 seconds", "key"),
        "session": lambda s: session_counts(s, "at", "5 seconds", "5 seconds", "key"),
    }
    got = {}
    for name, make in made.items():
        for n in range(len(batches)):  # a batch at a time, from the last checkpoint on
            (tmp_path / "now" / name).mkdir(parents=True, exist_ok=True)
            rows(batches[n]).coalesce(1).write.mode("append").parquet(str(tmp_path / "now" / name / "rows"))
            stream = spark.readStream.schema("key string, at timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "now" / name / "rows"))
            q = make(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / name / "check")).format("parquet").option("path", str(tmp_path / name / "out")).trigger(availableNow=True).start()
            q.awaitTermination()
        got[name] = spark.read.parquet(str(tmp_path / name / "out")).selectExpr("*", "second(window.start) + 60 * minute(window.start) AS s").collect()
    tumbling = Counter()
    for r in got["tumbling"]:
        tumbling[r["s"]] += r["n"]
    assert tumbling[0] == 3 and tumbling[20] == 2  # the late row is not in the first window
    assert Counter({(r["s"], r["key"]): r["n"] for r in got["sliding"] if r["s"] < 30 and r["window"]["start"].year == 2024})[(0, "a")] == 2
    assert {(r["key"], r["s"]): r["n"] for r in got["session"] if r["s"] < 60} == {("a", 1): 2, ("b", 7): 1, ("a", 21): 1, ("b", 22): 1}


def test_accumulator_survives_a_restart(spark, tmp_path):
    box, p = random_system(spark, 6, 50, seed=1)
    frames = p.withColumn("frame", F.lit(1))
    first = RdfAccumulator(box, 2.0, 4, str(tmp_path / "counts"))
    first.add(frames, 0)
    first.add(frames, 1)
    again = RdfAccumulator(box, 2.0, 4, str(tmp_path / "counts"))
    again.add(frames, 1)  # replayed
    one = RdfAccumulator(box, 2.0, 4)
    one.add(frames, 0)
    assert again.counts(spark) == [2 * n for n in one.counts()]


def test_cubatic_of_particles(spark):
    """A particle on the lattice axes has the order that annealing finds."""
    rng = np.random.default_rng(2)
    q = [(i, math.cos(t / 2), 0.0, 0.0, math.sin(t / 2)) for i, t in enumerate(rng.uniform(-0.05, 0.05, 100).tolist())] + [(100, 1.0, 0.0, 0.0, 0.0)]
    rows = spark.createDataFrame(q, "point_id long, qw double, qx double, qy double, qz double")
    each = {r["point_id"]: r["order"] for r in order.cubatic_particles(rows).collect()}
    value, at = order.cubatic(rows)
    assert each[100] == pytest.approx(value, abs=0.02) and max(each.values()) <= value + 1e-3
    with pytest.raises(ValueError):
        order.cubatic(rows, t_initial=0.1, t_final=1.0)


def test_frame_objects(spark):
    from types import SimpleNamespace as N

    from swarmframe.sources.points import from_system

    at = np.array([(0.5, 0.25, 0.0), (-1.0, 1.0, 0.0)])
    sides = N(Lx=4.0, Ly=5.0, Lz=1.0, xy=0.1, xz=0.0, yz=0.0, dimensions=2)
    systems = [
        (Box(4, 5, 0, 0.1), at),
        N(box=[4.0, 5.0, 0.0, 0.1, 0.0, 0.0], points=at),
        N(configuration=N(box=[4.0, 5.0, 1.0, 0.1, 0.0, 0.0], dimensions=2), particles=N(position=at)),
        N(box=sides, particles=N(position=at)),
        N(cell=N(matrix=np.array([[4.0, 0.5, 0, 9], [0, 5.0, 0, 9], [0, 0, 1.0, 9]]), is2D=True), particles=N(positions=at)),
    ]
    for system in systems:
        box, p = from_system(spark, system)
        assert box.is2d and (box.Lx, box.Ly, box.xy) == pytest.approx((4, 5, 0.1)) and p.count() == 2
    box, _ = from_system(spark, N(triclinic_dimensions=np.diag([3.0, 4.0, 5.0]), positions=at))
    assert (box.Lx, box.Ly, box.Lz) == (3, 4, 5)
    with pytest.raises(TypeError):
        from_system(spark, N(x=1))
