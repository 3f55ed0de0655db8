"""Forms that keep searches small where points are dense, and keys of large tables."""

import duckdb
import numpy as np
import pytest

from swarmframe.functions.box import Box
from swarmframe.operators import cluster, neighbors, order
from swarmframe.plans import catalog
from swarmframe.sources.points import HASHES, hashed_points, random_system


def test_hash_of_large_keys(spark):
    """Squares of keys beyond 2.7 million times the largest factor don't fit 64 bits."""
    keys = [0, 1, -1, -5, 65520, -65521, 130000, -130000, 2_000_000, 5_999_999, 3_000_000_000, 2**62, -(2**62)]
    rows = hashed_points(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    remainder = lambda v, m: v % m if v >= 0 else -(-v % m)
    assert [tuple(r) for r in rows] == [(k, *[remainder(k * k * a + k * b + c, m) / 4096 - 8 for a, b, c, m in HASHES]) for k in keys]


def distances(rows):
    return sorted((r["i"], r["j"], r["distance"]) for r in rows.select("i", "j", "distance").collect())


@pytest.mark.parametrize("incomplete", ["keep", "drop"])
def test_growing_sann(spark, incomplete, monkeypatch):
    """Shells found within growing radii are those among all bonds; the first radius takes few bonds."""
    box, p = random_system(spark, 8, 500, seed=3)
    asked, ball = [], neighbors.ball
    monkeypatch.setattr(neighbors, "ball", lambda points, box, r, *a, **k: asked.append(r) or ball(points, box, r, *a, **k))
    got = distances(neighbors.sann_within(p, box, 3.5, incomplete))
    assert asked[0] < 2
    assert got == distances(neighbors.sann(ball(p, box, 3.5), incomplete))


@pytest.mark.parametrize("incomplete", ["keep", "drop"])
def test_growing_rad(spark, incomplete, monkeypatch):
    box, p = random_system(spark, 8, 500, seed=4)
    asked, ball = [], neighbors.ball
    monkeypatch.setattr(neighbors, "ball", lambda points, box, r, *a, **k: asked.append(r) or ball(points, box, r, *a, **k))
    got = distances(neighbors.rad_within(p, box, 3.0, incomplete))
    assert asked[0] < 2 and got == distances(neighbors.rad(ball(p, box, 3.0), True, incomplete))


def test_growing_rad_of_sizes(spark):
    box, p = random_system(spark, 8, 500, seed=4)
    sized = p.selectExpr("*", "1 + 0.5 * (point_id % 3) AS radius")
    got = distances(neighbors.rad_within(sized, box, 3.0, "drop", "radius"))
    assert got == distances(neighbors.rad(neighbors.ball(p, box, 3.0), incomplete="drop", radii=sized.select("point_id", "radius")))
    assert neighbors.rad_within(sized.limit(0), Box.cube(8.0), 3.0).count() == 0


def joins(df):
    """Joins of the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("name", ["frames_pmft_xy", "frames_correlation", "frames_angular_separation", "local_descriptors_particle", "bond_order_modes"])
def test_values_go_along_with_points(spark, sf, name, monkeypatch):
    """Bonds are searched with their points' values and joined to none, and kept nowhere."""
    kept = []
    monkeypatch.setattr(cluster, "save", lambda df, *done: kept.append(df) or df)
    own = {"frames_pmft_xy": 4, "frames_correlation": 7, "frames_angular_separation": 3, "local_descriptors_particle": 1, "bond_order_modes": 2}
    assert joins(catalog.QUERIES[name](spark, sf)) <= own[name] and not kept


def test_searched_twice(spark):
    """An average and the scores of bonds that search again are those of joined bonds."""
    box, p = random_system(spark, 8, 300, seed=5)
    again = lambda points, names, half=False: neighbors.ball(points, box, 1.6, carry=names, half=half)
    bonds = neighbors.ball(p, box, 1.6)
    flat = lambda df: sorted(map(repr, map(tuple, df.collect())))
    near = lambda df, c, *keys: {tuple(r[k] for k in keys): pytest.approx(r[c], abs=1e-9, nan_ok=True) for r in df.collect()}
    got = {(r["point_id"],): r["q"] for r in order.steinhardt(p, bonds, 4, average=True, search=again).collect()}
    assert got == near(order.steinhardt(p, bonds, 4, average=True), "q", "point_id")
    joined, found = order.solid_liquid(p, bonds, 6, 0.4, 2), order.solid_liquid(p, bonds, 6, 0.4, 2, search=again)
    want = near(joined[0], "q_ij", "i", "j")
    assert {(r["i"], r["j"]): r["q_ij"] for r in found[0].collect()} == want
    assert {(r["i"], r["j"]): r["q_ij"] for r in order.solid_bonds(p, bonds, 6, True, again).collect()} == want
    assert flat(joined[1]) == flat(found[1].select(joined[1].columns))


def test_star_forest():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, (2, 260))
    x, y = cluster.star_forest(a, b)
    root = {int(n): int(n) for n in np.concatenate([a, b])}
    for _ in root:
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            root[p] = root[q] = min(root[p], root[q])
    assert dict(zip(x.tolist(), y.tolist(), strict=True)) == {n: r for n, r in root.items() if n != r}


def test_debye_of_many_points(spark, sf, monkeypatch):
    """The sum over all pairs isn't refused for their number."""
    asked, pairs = [], neighbors.all_pairs
    monkeypatch.setattr(neighbors, "all_pairs", lambda *a, most=10**11, **k: asked.append(most) or pairs(*a, most=most, **k))
    catalog.QUERIES["structure_factor_debye"](spark, sf)
    assert asked == [None]


def test_all_pairs_by_tiles(spark, monkeypatch):
    """The same bonds, whatever the tiles are, also for ids that come twice and rows without one."""
    monkeypatch.setattr(neighbors, "TILED", 32)
    box, p = random_system(spark, 8, 75, seed=5)
    p = p.selectExpr("CASE WHEN point_id > 70 THEN 70 WHEN point_id = 3 THEN NULL ELSE point_id END AS point_id", "x", "y", "z")
    full = lambda **k: sorted(map(tuple, neighbors.all_pairs(p, box, **k).collect()))
    for exclude in (True, False):
        assert full(exclude_ii=exclude, tile=8) == full(exclude_ii=exclude, tile=1_000) == full(exclude_ii=exclude)
    for few in (0, 1):
        assert neighbors.all_pairs(p.limit(few), box, exclude_ii=False, tile=8).count() == few


def test_all_pairs_takes_few_bytes_where_it_is_written(spark, tmp_path):
    """Both bonds of a pair have one distance, which is stored once; 8 bytes a row otherwise."""
    n = 1_500
    spark.range(n).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    out = catalog.QUERIES["all_pairs"](spark, str(tmp_path))
    out.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7 * n * (n - 1)


@pytest.mark.parametrize("name", ["pmft_xy", "pmft_xyt", "pmft_r12"])
def test_pmft_on_edges(spark, tmp_path, name):
    """Bonds whose coordinate rounds up to the limit, and two points at one place, count as in SQL."""
    keys = [*range(300), 34328, 99849, 32768, 45153, 110674]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
