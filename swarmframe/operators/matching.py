"""Local environments as sets of bond vectors: similar ones, motifs, root-mean-square distances, registration.

An environment is the list of a point's bond vectors, in the order of the
neighbours' ids.  Two environments are similar if each vector of one pairs with a
vector of the other, one to one, closer than a threshold.  With registration, the
second set is first turned onto the first by the best rotation that brute force
over triples of vectors finds.

Environments are gathered for each point (as many vectors as it has bonds) and
compared along bonds, so no task sees a whole frame; clusters are connected
components of similar bonded points.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators.cluster import components, prefix_sum, save
from swarmframe.operators.neighbors import _frame

#: A rotation that leaves less than this is taken at once.
EXACT = 1e-6
VECTORS = "array<struct<j: bigint, dx: double, dy: double, dz: double>>"


def kabsch(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Proper rotations R (..., 3, 3) that bring R p nearest to q, for sets (..., n, 3) about the origin."""
    u, _, vt = np.linalg.svd(np.swapaxes(p, -1, -2) @ q)
    v = np.swapaxes(vt, -1, -2)
    flip = np.linalg.det(v @ np.swapaxes(u, -1, -2)) < 0
    v[..., :, -1] = np.where(flip[..., None], -v[..., :, -1], v[..., :, -1])
    return v @ np.swapaxes(u, -1, -2)


def aligned_rmsd(reference: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets (m, n, 3): root-mean-square distances and the reference vector of each vector.

    Vectors choose in turn the nearest reference vector that is still free.
    """
    m, n = sets.shape[:2]
    free = np.ones((m, n), bool)
    chosen, total, row = np.zeros((m, n), np.int64), np.zeros(m), np.arange(m)
    for k in range(n):
        d2 = ((reference - sets[:, k, None]) ** 2).sum(axis=-1)
        d2[~free] = np.inf
        chosen[:, k] = d2.argmin(axis=1)
        total += d2[row, chosen[:, k]]
        free[row, chosen[:, k]] = False
    return np.sqrt(total / max(n, 1)), chosen


def register(reference: np.ndarray, points: np.ndarray, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Root-mean-square distance, rotation and reference vector of each point, the best over triples.

    A few reference vectors, drawn by ``seed``, meet every triple of points in every order.
    """
    n = len(reference)
    if n != len(points):
        raise ValueError("registration needs as many points as reference points")
    if n == 0:
        return 0.0, np.eye(3), np.zeros(0, np.int64)
    k = min(n, 3)
    anchors = reference[np.random.default_rng(seed).choice(n, k, replace=False)]
    orders = np.array([o for c in combinations(range(n), k) for o in permutations(c)])
    best = (np.inf, np.eye(3), np.zeros(n, np.int64))
    for at in range(0, len(orders), 4_096):
        turns = kabsch(points[orders[at : at + 4_096]], np.broadcast_to(anchors, (len(orders[at : at + 4_096]), k, 3)))
        turned = np.einsum("mij,nj->mni", turns, points)
        rmsd, chosen = aligned_rmsd(reference, turned)
        m = int(rmsd.argmin())
        if rmsd[m] < best[0]:
            best = (float(rmsd[m]), turns[m], chosen[m])
        if best[0] < EXACT:
            break
    return best


def similar(first: np.ndarray, second: np.ndarray, threshold: float, registration: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Rotation of the second set and the place in it of each vector of the first; None if they don't pair off."""
    if len(first) != len(second):
        return None
    if registration:
        _, turn, chosen = register(first, second)
        turned = second @ turn.T
        close = ((first[chosen] - turned) ** 2).sum(axis=1) < threshold * threshold
        return (turn, np.argsort(chosen)) if close.all() else None
    near = ((first[:, None] - second[None]) ** 2).sum(axis=-1) < threshold * threshold
    place, free = np.full(len(first), -1), np.ones(len(second), bool)
    for i, row in enumerate(near):
        options = np.flatnonzero(row & free)
        if not len(options):
            return None
        place[i] = options[0]
        free[options[0]] = False
    return np.eye(3), place


def minimize_rmsd(reference: np.ndarray, points: np.ndarray, registration: bool = False) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Least root-mean-square distance, rotation, and the reference vector of each point; -1 for sets of different sizes."""
    if len(reference) != len(points):
        return -1.0, np.eye(3), None
    if registration:
        return register(reference, points)
    rmsd, chosen = aligned_rmsd(reference, points[None])
    return float(rmsd[0]), np.eye(3), chosen[0]


def environments(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """(frame,) point_id, vectors: bond vectors of every point, by the neighbours' ids; a bond to itself is none."""
    by = _frame(points)
    vector = F.struct("j", "dx", "dy", "dz")
    found = bonds.where("i <> j").groupBy(*by, F.col("i").alias("point_id")).agg(F.sort_array(F.collect_list(vector)).alias("vectors"))
    return points.select(*by, "point_id").join(found, [*by, "point_id"], "left").withColumn("vectors", F.coalesce(F.col("vectors").cast(VECTORS), F.array().cast(VECTORS)))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    flat = column.flatten()
    v = np.column_stack([flat.field(f"d{c}").to_numpy(zero_copy_only=False) for c in "xyz"]) if len(flat) else np.zeros((0, 3))
    return [v[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _kinds(df: DataFrame, by: list[str]) -> list[str]:
    return [f"frame {dict(df.dtypes)['frame']}"] if by else []


def _wrapped(motif, box: Box | None) -> np.ndarray:
    motif = np.asarray(motif, float).reshape(-1, 3)
    if box is None:
        return motif
    vectors = np.array(box.lattice_vectors[: box.dims])[:, : box.dims]
    f = motif[:, : box.dims] @ np.linalg.inv(vectors)
    motif = motif.copy()
    motif[:, : box.dims] -= np.floor(f + 0.5) @ vectors
    return motif


def motif_match(points: DataFrame, bonds: DataFrame, motif, threshold: float, registration: bool = False, box: Box | None = None) -> DataFrame:
    """(frame,) point_id, matches: whether a point's environment is similar to the motif (wrapped into ``box``)."""
    by, motif = _frame(points), _wrapped(motif, box)

    def run(batches):
        for batch in batches:
            found = [similar(motif, v, threshold, registration) is not None for v in _vectors(batch.column("vectors"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*by, "point_id")], pa.array(found, pa.bool_())], [*by, "point_id", "matches"])

    return environments(points, bonds).mapInArrow(run, ", ".join([*_kinds(points, by), "point_id long, matches boolean"]))


def motif_rmsd(points: DataFrame, bonds: DataFrame, motif, registration: bool = False, box: Box | None = None) -> DataFrame:
    """(frame,) point_id, rmsd of a point's environment to the motif; -1 where the numbers of vectors differ."""
    by, motif = _frame(points), _wrapped(motif, box)

    def run(batches):
        for batch in batches:
            found = [minimize_rmsd(motif, v, registration)[0] for v in _vectors(batch.column("vectors"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*by, "point_id")], pa.array(found, pa.float64())], [*by, "point_id", "rmsd"])

    return environments(points, bonds).mapInArrow(run, ", ".join([*_kinds(points, by), "point_id long, rmsd double"]))


def environment_clusters(points: DataFrame, bonds: DataFrame, env_bonds: DataFrame, threshold: float, registration: bool = False) -> DataFrame:
    """(frame,) point_id, cluster: bonded points with similar environments; clusters by their least point.

    bonds say which points are compared, env_bonds make the environments.
    """
    by = _frame(points)
    env = save(environments(points, env_bonds))
    side = lambda key, name: env.select(*by, F.col("point_id").alias(key), F.col("vectors").alias(name))
    pairs = bonds.where("i < j").select(*by, "i", "j").unionByName(bonds.where("i > j").select(*by, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    both = pairs.join(side("i", "a"), [*by, "i"]).join(side("j", "b"), [*by, "j"]).where(F.size("a") == F.size("b")).select(*by, "i", "j", "a", "b")

    def run(batches):
        for batch in batches:
            found = [similar(a, b, threshold, registration) is not None for a, b in zip(_vectors(batch.column("a")), _vectors(batch.column("b")), strict=True)]
            yield batch.select([*by, "i", "j"]).filter(pa.array(found, pa.bool_()))

    links = both.mapInArrow(run, ", ".join([*_kinds(points, by), "i long, j long"]))
    found = save(components(points, links))
    roots = found.select(*by, "root").distinct().withColumn("one", F.lit(1))
    number = prefix_sum(roots, by, "root", "one", "cluster").select(*by, "root", F.col("cluster").cast("long").alias("cluster"))
    return found.join(number, [*by, "root"]).select(*by, "point_id", "cluster")


def cluster_environments(points: DataFrame, env_bonds: DataFrame, assigned: DataFrame, registration: bool = False) -> DataFrame:
    """(frame,) cluster, k, dx, dy, dz: each cluster's mean environment, its vectors aligned to those of its least point."""
    by = _frame(points)
    env = environments(points, env_bonds).join(assigned, [*by, "point_id"])
    first = env.groupBy(*by, "cluster").agg(F.min_by("vectors", "point_id").alias("model"))
    both = env.join(first, [*by, "cluster"]).select(*by, "cluster", "vectors", "model")

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            keys = [batch.column(c).to_pylist() for c in (*by, "cluster")]
            for n, (v, model) in enumerate(zip(_vectors(batch.column("vectors")), _vectors(batch.column("model")), strict=True)):
                _, turn, chosen = minimize_rmsd(model, v, registration)
                if chosen is not None:
                    rows += [(*[k[n] for k in keys], int(c), *map(float, turn @ x)) for c, x in zip(chosen, v, strict=True)]
            names = [*by, "cluster", "k", "dx", "dy", "dz"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    turned = both.mapInArrow(run, ", ".join([*_kinds(points, by), "cluster long, k long, dx double, dy double, dz double"]))
    return turned.groupBy(*by, "cluster", "k").agg(*[F.avg(f"d{c}").alias(f"d{c}") for c in "xyz"])
