"""Clusters of bonded points and their properties, frame by frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators.neighbors import _frame, prefix_sum


def save(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: checkpoint to shared storage where a folder is set, else keep it in memory.

    done: tables kept before that nothing reads once this one is there.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint()
    out = df.persist()
    if done:
        out.count()
        for d in done:
            d.unpersist()
    return out


#: Edges that a task collects before it reduces them.
PENDING = 1 << 20
WHOLE = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the edges a, b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _thinned(edges: DataFrame, by: list[str]) -> DataFrame:
    """Of each task's edges (by, a, b) only a forest of stars: no more than a task has nodes, and the same components."""
    kinds = dict(edges.dtypes)
    if any(kinds[c] not in WHOLE for c in ("a", "b", *by)):
        return edges
    kind = WHOLE[kinds["a"]]

    def run(batches):
        found: dict = {}  # by frame: the forest and the edges since then
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            frame = batch.column(by[0]).to_numpy() if by else np.zeros(len(a), np.int64)
            for f in np.unique(frame):
                own = slice(None) if f == frame[0] and (frame == f).all() else frame == f
                tree, rest = found.setdefault(int(f), [(np.zeros(0, a.dtype), np.zeros(0, a.dtype)), []])
                rest.append((a[own], b[own]))
                if sum(len(r[0]) for r in rest[:: max(1, len(rest) // 8)]) * max(1, len(rest) // 8) > max(PENDING, 2 * len(tree[0])):
                    found[int(f)] = [star_forest(*[np.concatenate([tree[k], *[r[k] for r in rest]]) for k in (0, 1)]), []]
        for f, (tree, rest) in found.items():
            a, b = star_forest(*[np.concatenate([tree[k], *[r[k] for r in rest]]) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(a), f), WHOLE[kinds[c]]) for c in by], pa.array(a, kind), pa.array(b, kind)], [*by, "a", "b"])

    return edges.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "a", "b")))


def components(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """(frame,) point_id, root: the least point that each one reaches over bonds, in rounds of large and small stars."""
    by = _frame(points)
    pair = lambda a, b: [*by, F.col(a).alias("a"), F.col(b).alias("b")]
    edges = bonds.where("i <> j").select(*by, F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b"))
    edges = save(_thinned(edges, by).distinct())
    while True:
        ends = edges.select(*by, F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(*by, F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy(*by, "node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break  # all are stars
        both = edges.unionByName(edges.select(*pair("b", "a")))
        least = both.groupBy(*by, "a").agg(F.min("b").alias("m")).select(*by, "a", F.least("a", "m").alias("m"))
        large = both.join(least, [*by, "a"]).where("b > a").select(*pair("b", "m")).distinct()
        least = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        moved = large.join(least, [*by, "a"]).where("b <> m").select(*pair("b", "m"))
        edges = save(least.select(*pair("a", "m")).unionByName(moved).distinct(), edges)
    roots = edges.select(*by, F.col("a").alias("point_id"), F.col("b").alias("root"))
    return points.select(*by, "point_id").join(roots, [*by, "point_id"], "left").withColumn("root", F.coalesce("root", "point_id"))


def clusters(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """(frame,) point_id, cluster: numbered by size, the largest first, then by the least point."""
    by = _frame(points)
    found = components(points, bonds)
    sizes = found.groupBy(*by, "root").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    # clusters of each size, then their order by root: few sizes, and no task holds all clusters
    larger = Window.partitionBy(*by).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.groupBy(*by, "n").agg(F.count("*").alias("many")).select(*by, "n", F.coalesce(F.sum("many").over(larger), F.lit(0)).alias("first"))
    placed = prefix_sum(sizes, [*by, "n"], "root", "one", "place").join(first, [*by, "n"])
    number = placed.select(*by, "root", (F.col("first") + F.col("place")).cast("long").alias("cluster"))
    return found.join(number, [*by, "root"]).select(*by, "point_id", "cluster")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """(frame,) cluster, size; points of no cluster are left out."""
    return assigned.where("cluster IS NOT NULL").groupBy(*_frame(assigned), "cluster").agg(F.count("*").alias("size"))


def largest_cluster_size(assigned: DataFrame) -> DataFrame:
    """(frame,) size of the largest cluster."""
    return cluster_sizes(assigned).groupBy(*_frame(assigned)).agg(F.max("size").alias("size"))


def cluster_keys(assigned: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(frame,) cluster, keys: the sorted keys of its points (their ids by default)."""
    by = _frame(assigned)
    rows = assigned.join(keys, [*by, "point_id"]) if keys is not None else assigned.withColumn("key", F.col("point_id"))
    return rows.groupBy(*by, "cluster").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def properties(points: DataFrame, assigned: DataFrame, box: Box, mass: str | None = None) -> DataFrame:
    """(frame,) cluster, size, mass, centre, centre of mass, gyration and inertia tensors, radius of gyration."""
    by = _frame(points)
    group = [*by, "cluster"]
    m = F.col(mass).cast("double") if mass else F.lit(1.0)
    rows = points.join(assigned, [*by, "point_id"]).withColumn("_m", m)
    center = box.center_of_mass(rows, group)
    com = box.center_of_mass(rows, group, "_m").select(*group, *[F.col(c).alias(f"com_{c}") for c in "xyz"])
    rows = rows.join(center.select(*group, *[F.col(c).alias(f"center_{c}") for c in "xyz"]), group).join(com, group)
    for kind in ("center", "com"):
        d = box.wrap(tuple(F.col(c) - F.col(f"{kind}_{c}") for c in "xyz"))
        rows = rows.withColumns({f"_{kind}{c}": v for c, v in zip("xyz", d, strict=True)})
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    gyration = [F.avg(F.col(f"_center{p[0]}") * F.col(f"_center{p[1]}")).alias(f"g_{p}") for p in pairs]
    r2 = sum((F.col(f"_com{c}") * F.col(f"_com{c}") for c in "yz"), F.col("_comx") * F.col("_comx"))
    inertia = [F.sum(F.col("_m") * ((r2 if p[0] == p[1] else F.lit(0.0)) - F.col(f"_com{p[0]}") * F.col(f"_com{p[1]}"))).alias(f"i_{p}") for p in pairs]
    keys = [*group, *[f"{k}_{c}" for k in ("center", "com") for c in "xyz"]]
    out = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.sum("_m").alias("mass"), *gyration, *inertia)
    return out.withColumn("radius_of_gyration", F.sqrt((F.col("i_xx") + F.col("i_yy") + F.col("i_zz")) / (2 * F.col("mass"))))
