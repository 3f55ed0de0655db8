"""Neighbour joins under periodic boundaries.

Points fall into cells at least as wide as the radius, or half of it where the box
has few of them.  The query side is multiplied over the cells around its own, and
an equi-join on (frame, cell) with the minimum-image distance as the residual
gives the bonds.  Where the points query themselves, each pair is found once, over
half of the cells, and mirrored.  Both sides are shuffled by cell, so a large frame
is split; AQE splits dense cells.

bonds: (frame,) i, j, dx, dy, dz, distance, weight; the vector points from i to j.
Columns that are carried along come as i_name and j_name.
"""

from __future__ import annotations

from itertools import product
from math import ceil, floor, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.functions.box import Box

BOND = ("i", "j", "dx", "dy", "dz", "distance", "weight")
#: Boxes with fewer cells than this along an axis get cells of half the radius.
FEW_CELLS = 8
#: Most buckets that a prefix sum orders in one task.
PREFIX_BUCKETS = 4_096
#: Neighbours that the first radius of a growing search holds on average; most shells close with fewer.
SHELL = 26
#: Points that are put in order together before they are dealt out to tiles.
TILED = 4_096


def _frame(df: DataFrame) -> list[str]:
    return ["frame"] if "frame" in df.columns else []


def _pairs(joined: DataFrame, box: Box, by: list[str], carried: list[str]) -> DataFrame:
    d = box.wrap(tuple(F.col(f"p{c}") - F.col(f"q{c}") for c in "xyz"))
    rows = joined.select(*by, "i", "j", *carried, *[v.alias(f"d{c}") for v, c in zip(d, "xyz", strict=True)])
    return rows.withColumn("_d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))


def _finish(rows: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    return rows.select(*by, "i", "j", "dx", "dy", "dz", F.sqrt("_d2").alias("distance"), F.lit(1.0).alias("weight"), *carried)


def _sides(points: DataFrame, queries: DataFrame | None, by: list[str], carry: tuple[str, ...], query_carry: tuple[str, ...]):
    """Queries and points under names of their own; rows without a place or an id take no part.

    Coordinates that can't be null keep the generated code of a pair small enough
    to be compiled.
    """
    q = points if queries is None else queries
    some = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL" for c in ("point_id", "x", "y", "z", *by)))
    place = lambda prefix: [F.coalesce(c, F.lit(0.0)).alias(f"{prefix}{c}") for c in "xyz"]
    left = some(q).select(*by, F.col("point_id").alias("i"), *place("q"), *[F.col(c).alias(f"i_{c}") for c in query_carry])
    right = some(points).select(*by, F.col("point_id").alias("j"), *place("p"), *[F.col(c).alias(f"j_{c}") for c in carry])
    return left, right


def _offsets(m: int, periodic: bool, reach: int) -> list[int]:
    """Cells around a cell of m along an axis, each one once."""
    if not periodic or 2 * reach + 1 <= m:
        return list(range(-reach, reach + 1))
    return list(range(m))


def ball(
    points: DataFrame, box: Box, r_max: float, r_min: float = 0.0, queries: DataFrame | None = None, exclude_ii: bool | None = None,
    carry: tuple[str, ...] = (), query_carry: tuple[str, ...] | None = None, half: bool = False,
) -> DataFrame:
    """All bonds with r_min <= distance < r_max; i = j is left out by default where the points query themselves.

    carry, query_carry: columns of points and of queries that go along.  half: of
    each pair of points that query themselves only one bond, the other one's mirror.
    """
    if r_max <= 0 or r_max <= r_min:
        raise ValueError("r_max must be positive and above r_min")
    if any(p and d <= 2 * r_max for d, p in zip(box.plane_distances, box.periodic, strict=False)):
        raise ValueError("r_max is too large for the box")
    by = _frame(points)
    own = queries is None
    query_carry = carry if query_carry is None else query_carry
    left, right = _sides(points, queries, by, carry, query_carry)
    carried = [f"i_{c}" for c in query_carry] + [f"j_{c}" for c in carry]
    n = [max(1, floor(d / r_max)) for d in box.plane_distances]
    # smaller cells make more copies of each query and fewer candidates; points of one frame are the denser ones
    reach = 2 if min(n) < FEW_CELLS and not by else 1
    n = [max(1, floor(reach * d / r_max)) for d in box.plane_distances] if reach > 1 else n

    def cells(df: DataFrame, prefix: str) -> DataFrame:
        f = box.fractional(tuple(F.col(f"{prefix}{c}") for c in "xyz"))
        named = {f"_c{k}": F.floor(v * m).cast("int") for k, (v, m) in enumerate(zip(f, n, strict=True))}
        return df.withColumns({k: F.pmod(v, F.lit(m)) if p else v for (k, v), m, p in zip(named.items(), n, box.periodic, strict=False)})

    keys = [f"_c{k}" for k in range(len(n))]
    left, right = cells(left, "q"), cells(right, "p")
    axes = [_offsets(m, p, reach) for m, p in zip(n, box.periodic, strict=False)]
    # a pair of cells is met from one side only if each offset and its opposite are different cells
    mirrored = own and all(not p or 2 * reach + 1 <= m for m, p in zip(n, box.periodic, strict=False))
    steps = [o for o in product(*axes) if not mirrored or o >= (0,) * len(o)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{k}") for k, v in enumerate(o)]) for o in steps]))
    left = left.withColumn("_o", step)
    moved = {key: F.col(key) + F.col(f"_o.o{k}") for k, key in enumerate(keys)}
    left = left.withColumns({key: F.pmod(v, F.lit(m)) if p else v for (key, v), m, p in zip(moved.items(), n, box.periodic, strict=False)})
    if mirrored:  # inside a cell the smaller id asks
        left = left.withColumn("_inside", F.expr(" AND ".join(f"_o.o{k} = 0" for k in range(len(n)))))
    # both sides by cell: a side that is small before it is multiplied must not be broadcast
    joined = left.drop("_o").join(right.hint("shuffle_hash"), [*by, *keys])
    if mirrored:
        joined = joined.where(~F.col("_inside") | (F.col("i") < F.col("j")))
    elif own and half:
        joined = joined.where(F.col("i") <= F.col("j"))
    rows = _pairs(joined, box, by, carried)
    rows = rows.where((F.col("_d2") < r_max * r_max) & (F.col("_d2") >= r_min * r_min))
    exclude = exclude_ii if exclude_ii is not None else own
    if not mirrored:
        rows = _finish(rows.where("i <> j") if exclude else rows, by, carried)
        return rows
    rows = _finish(rows, by, carried)
    if not half:
        columns = [c for c in rows.columns if c not in by]
        swap = {"i": "j", "j": "i"} | {f"i_{c}": f"j_{c}" for c in carry} | {f"j_{c}": f"i_{c}" for c in carry}
        back = [(F.lit(0.0) - F.col(c) if c in ("dx", "dy", "dz") else F.col(swap.get(c, c))).alias(c) for c in columns]
        rows = rows.select(*by, F.explode(F.array(F.struct(*columns), F.struct(*back))).alias("_b")).select(*by, "_b.*")
    if not exclude and r_min <= 0:
        zero = [F.lit(0.0).alias(c) for c in ("dx", "dy", "dz", "distance")]
        selves = points.where(" AND ".join(f"{c} IS NOT NULL" for c in ("point_id", "x", "y", "z", *by))).select(*by, F.col("point_id").alias("i"), F.col("point_id").alias("j"), *zero, F.lit(1.0).alias("weight"), *[F.col(c).alias(f"{p}_{c}") for p in "ij" for c in carry])
        rows = rows.unionByName(selves)
    return rows


def all_pairs(points: DataFrame, box: Box, queries: DataFrame | None = None, exclude_ii: bool = True, most: int | None = 10**11, tile: int | None = None) -> DataFrame:
    """Every pair as a bond: the number of rows is the product, as asked for; more than ``most`` is refused.

    tile: where the points of one frame query themselves, pairs come by two groups of about
    so many points, all of them and then all of their mirrors.  Distances repeat so closely
    that a compressor with a short window stores them once.
    """
    by = _frame(points)
    left, right = _sides(points, queries, by, (), ())
    if most is not None:
        counts = left.groupBy(*by).agg(F.count("*").cast("double").alias("a")) if by else left.agg(F.count("*").cast("double").alias("a"))
        other = right.groupBy(*by).agg(F.count("*").cast("double").alias("b")) if by else right.agg(F.count("*").cast("double").alias("b"))
        total = (counts.join(other, by) if by else counts.crossJoin(other)).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        if total > most:
            raise ValueError(f"{total:.3g} pairs: raise most, or search within a radius")
    cores = max(left.sparkSession.sparkContext.defaultParallelism, 1)
    if by:
        rows = _pairs(left.join(right, by), box, by, [])
    elif tile and queries is None:
        rows = _pairs(_tiles(left, tile, cores), box, by, [])
    else:  # blocks of queries against blocks of points, spread over the tasks
        k = F.pmod(F.xxhash64("i"), F.lit(cores))
        rows = _pairs(left.withColumn("_k", k).repartition(cores, "_k").drop("_k").crossJoin(right), box, by, [])
    return _finish(rows.where("i <> j") if exclude_ii else rows, by, [])


def _tiles(points: DataFrame, tile: int, cores: int) -> DataFrame:
    """i, qx, qy, qz, j, px, py, pz of every pair of points, i and j in either order, by pairs of tiles."""
    buckets = max(1, ceil(points.count() / TILED))
    held = points.groupBy(F.pmod(F.xxhash64("i"), F.lit(buckets)).alias("_k")).agg(F.collect_list(F.struct("i", "qx", "qy", "qz")).alias("_l"))
    held = held.select("_k", "_l", F.explode(F.sequence(F.lit(0), (F.size("_l") - 1).cast("int"), F.lit(tile))).alias("_n"))
    held = held.select(F.struct("_k", "_n").alias("_a"), F.slice("_l", F.col("_n") + 1, tile).alias("_p"))
    pairs = held.repartition(cores, "_a").crossJoin(held.select(F.col("_a").alias("_b"), F.col("_p").alias("_r"))).where("_a <= _b")
    turns = F.explode(F.when(F.col("_a") < F.col("_b"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = pairs.select("_p", "_r", turns.alias("_t")).select(F.explode("_p").alias("_p"), "_r", "_t").select("_p", F.explode("_r").alias("_r"), "_t")
    own, other = ("i", "qx", "qy", "qz"), ("j", "px", "py", "pz")
    first = [F.when(F.col("_t"), F.col(f"_r.{c}")).otherwise(F.col(f"_p.{c}")).alias(c) for c in own]
    return rows.select(*first, *[F.when(F.col("_t"), F.col(f"_p.{c}")).otherwise(F.col(f"_r.{c}")).alias(d) for c, d in zip(own, other, strict=True)])


def nearest(points: DataFrame, box: Box, k: int, r_max: float | None = None, r_min: float = 0.0, queries: DataFrame | None = None, exclude_ii: bool | None = None) -> DataFrame:
    """The k nearest within r_max; equal distances by the smaller j.  Fewer where there are no more.

    Starts with the radius that an even density would need and doubles it for the
    queries that found too few, up to r_max or half of the box.  Only what is left
    beyond half of the box, where a cell search can't reach, asks all points.
    """
    from swarmframe.operators.cluster import save

    by = _frame(points)
    skip = exclude_ii if exclude_ii is not None else queries is None
    asked = points if queries is None else queries
    count = points.groupBy(*by).count().agg(F.max("count")).first()[0] if by else points.count()
    if not count:
        raise ValueError("there are no points")
    widest = 0.4999 * min(box.plane_distances)
    per_point = box.volume / count
    r = ((k + 1) * per_point / pi) ** 0.5 if box.is2d else (0.75 * (k + 1) * per_point / pi) ** (1 / 3)
    last = widest if r_max is None else min(widest, r_max)
    r = min(1.3 * r, last)
    order = Window.partitionBy(*by, "i").orderBy("distance", "j")
    parts, left = [], asked
    while True:
        near = ball(points, box, r, 0.0, None if left is points else left, skip).where(F.col("distance") >= r_min)
        ranked = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        if r >= last and r_max is not None and r_max <= widest:
            parts.append(ranked)
            break
        ranked = save(ranked)
        full = ranked.where(F.col("_n") == k).select(*by, "i")
        parts.append(ranked.join(full, [*by, "i"], "left_semi"))
        left = save(left.join(full.withColumnRenamed("i", "point_id"), [*by, "point_id"], "left_anti"))
        if left.isEmpty():
            break
        if r >= last:
            rest = all_pairs(points, box, left, skip).where(F.col("distance") >= r_min)
            parts.append(rest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k))
            break
        r = min(2 * r, last)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.drop("_n")
    return found.where(F.col("distance") < r_max) if r_max is not None else found


def from_arrays(bonds: DataFrame, n_queries: int, n_points: int) -> DataFrame:
    """A caller's own bonds, after a check of their ids; distance and weight are filled in."""
    low, high_i, high_j = bonds.agg(F.least(F.min("i"), F.min("j")), F.max("i"), F.max("j")).first()
    if low is not None and (low < 0 or high_i >= n_queries or high_j >= n_points):
        raise ValueError("an index is out of range")
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    weight = F.col("weight") if "weight" in bonds.columns else F.lit(1.0)
    return bonds.select(*_frame(bonds), "i", "j", "dx", "dy", "dz", length.alias("distance"), weight.alias("weight"))


def filter_r(bonds: DataFrame, r_max: float, r_min: float = 0.0) -> DataFrame:
    if r_max <= 0 or r_min < 0 or r_max <= r_min:
        raise ValueError("radii must be ordered and positive")
    return bonds.where((F.col("distance") >= r_min) & (F.col("distance") < r_max))


def prefix_sum(rows: DataFrame, by: list[str], key: str, value: str, out: str) -> DataFrame:
    """rows with the sum of ``value`` over smaller integer keys of the same group; keys are unique there.

    Keys fall into buckets of one width; a window runs over the buckets' sums and
    one inside each bucket, so a group of any size is spread over many tasks.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = max(1, ceil(((high or 0) - (low or 0) + 1) / PREFIX_BUCKETS))
    rows = rows.withColumn("_b", F.floor((F.col(key) - F.lit(low or 0)) / width))
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    buckets = buckets.select(*by, "_b", F.coalesce(F.sum("_s").over(before(Window.partitionBy(*by).orderBy("_b"))), F.lit(0)).alias("_head"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy(*by, "_b").orderBy(key))), F.lit(0))
    return rows.withColumn("_in", inside).join(buckets, [*by, "_b"]).withColumn(out, F.col("_head") + F.col("_in")).drop("_b", "_in", "_head")


def neighbor_counts(bonds: DataFrame, queries: DataFrame) -> DataFrame:
    """i, n and the place of the first bond in (i, j) order, for every query point."""
    by = _frame(bonds)
    n = bonds.groupBy(*by, "i").agg(F.count("*").alias("n"))
    rows = queries.select(*by, F.col("point_id").alias("i")).join(n, [*by, "i"], "left").na.fill(0, ["n"])
    return prefix_sum(rows, by, "i", "n", "first").select(*by, "i", "n", "first")


def limited(bonds: DataFrame, most: int, nearest_first: bool = False) -> DataFrame:
    """At most so many bonds of each query point: the first by j, or the nearest ones."""
    order = Window.partitionBy(*_frame(bonds), "i").orderBy(*(["distance"] if nearest_first else []), "j")
    return bonds.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _shell(rows: DataFrame, by: list[str], stop: Column, incomplete: str) -> DataFrame:
    """Bonds before _stop; what happens to points whose shell never closes is up to ``incomplete``."""
    if incomplete not in ("keep", "drop", "raise"):
        raise ValueError("incomplete is keep, drop or raise")
    rows = rows.withColumn("_stop", stop)
    if incomplete == "raise":
        rows = rows.withColumn("_stop", F.when(F.col("_stop").isNull(), F.raise_error(F.concat(F.lit("the shell is not full of point "), F.col("i").cast("string"))).cast("int")).otherwise(F.col("_stop")))
    return rows.where("_n < _stop" if incomplete != "keep" else "_stop IS NULL OR _n < _stop")


def sann(bonds: DataFrame, incomplete: str = "keep") -> DataFrame:
    """Solid-angle nearest neighbours: the shortest shell that closes around each point.

    incomplete: what to do with points whose bonds are too few to close a shell:
    keep all of them, drop them, or raise an error.
    """
    by = _frame(bonds)
    order = Window.partitionBy(*by, "i").orderBy("distance", "j")
    rows = bonds.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum("distance").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    stop = F.min(F.when((F.col("_n") >= 4) & (F.col("_sum") <= F.col("distance") * (F.col("_n") - 3)), F.col("_n"))).over(Window.partitionBy(*by, "i"))
    return _shell(rows, by, stop, incomplete).drop("_n", "_sum", "_stop")


def rad(bonds: DataFrame, stop_at_blocked: bool = True, incomplete: str = "keep", radii: DataFrame | None = None, radius: str | None = None) -> DataFrame:
    """Relative angular distance: a neighbour stays unless a nearer one stands before it.

    radii: (point_id, radius) of the points, for particles of several sizes: solid
    angles then go by (radius / distance) squared.  radius: the column of the bonds
    that holds j's radius already.
    """
    by = _frame(bonds)
    order = Window.partitionBy(*by, "i").orderBy("distance", "j")
    rows = bonds.withColumn("_n", F.row_number().over(order))
    rows = rows.join(radii.select(*_frame(radii), F.col("point_id").alias("j"), F.col("radius").alias("_r")), [*_frame(radii), "j"]) if radii is not None else rows.withColumn("_r", F.col(radius) if radius else F.lit(1.0))
    k = rows.select(*by, "i", F.col("_n").alias("_k"), *[F.col(f"d{c}").alias(f"k{c}") for c in "xyz"], F.col("distance").alias("_dk"), F.col("_r").alias("_rk"))
    dot = F.col("dx") * F.col("kx") + F.col("dy") * F.col("ky") + F.col("dz") * F.col("kz")
    # (rj / dj)**2 < cos * (rk / dk)**2 with cos = dot / (dj * dk)
    blocked = F.col("_dk") * F.col("_dk") * F.col("_dk") * (F.col("_r") * F.col("_r")) < dot * F.col("distance") * (F.col("_rk") * F.col("_rk"))
    hit = rows.join(k, [*by, "i"]).where(F.col("_k") < F.col("_n")).where(blocked).select(*by, "i", "_n").distinct()
    if stop_at_blocked or incomplete != "keep":
        first = hit.groupBy(*by, "i").agg(F.min("_n").alias("_first"))
        closed = _shell(rows.join(first, [*by, "i"], "left"), by, F.col("_first"), incomplete)
        if stop_at_blocked:
            return closed.drop("_n", "_stop", "_first", "_r")
        rows = rows.join(closed.select(*by, "i").distinct(), [*by, "i"], "left_semi")
    return rows.join(hit, [*by, "i", "_n"], "left_anti").drop("_n", "_r")


def _growing(points: DataFrame, box: Box, r_max: float, shell, incomplete: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(frame,) i, j, distance of the shells that ``shell`` closes, without all bonds below r_max at once.

    Whether a bond closes a shell depends on nearer bonds only, so a shell that is
    closed within a smaller radius is final.  The points whose shell isn't closed
    search again with twice the radius; ``incomplete`` is for those left at r_max.
    """
    from swarmframe.operators.cluster import save

    by = _frame(points)
    count = points.groupBy(*by).count().agg(F.max("count")).first()[0] if by else points.count()
    per_point = box.volume / max(count or 0, 1)
    r = min(r_max, (SHELL * per_point / pi) ** 0.5 if box.is2d else (0.75 * SHELL * per_point / pi) ** (1 / 3))
    found, left = None, points
    while True:
        bonds = ball(points, box, r, queries=None if left is points else left, exclude_ii=True, carry=carry, query_carry=carry if left is points else ())
        closed = shell(bonds, "drop" if r < r_max else incomplete).select(*by, "i", "j", "distance")
        closed = closed if r >= r_max else save(closed)
        found = closed if found is None else found.unionByName(closed)
        if r >= r_max:
            return found
        left = save(left.join(closed.select(*by, F.col("i").alias("point_id")).distinct(), [*by, "point_id"], "left_anti"))
        if left.isEmpty():
            return found
        r = min(2 * r, r_max)


def sann_within(points: DataFrame, box: Box, r_max: float, incomplete: str = "keep") -> DataFrame:
    """The bonds of ``sann`` among all bonds below r_max: (frame,) i, j, distance."""
    return _growing(points, box, r_max, sann, incomplete)


def rad_within(points: DataFrame, box: Box, r_max: float, incomplete: str = "keep", radius: str | None = None) -> DataFrame:
    """The bonds of ``rad``, up to the first blocked one, among all bonds below r_max: (frame,) i, j, distance.

    radius: a column of points with the particles' radii.
    """
    return _growing(points, box, r_max, lambda bonds, rest: rad(bonds, True, rest, radius=f"j_{radius}" if radius else None), incomplete, (radius,) if radius else ())


def interface(bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points, and the query points, that have a bond to the other set."""
    by = _frame(bonds)
    return bonds.select(*by, F.col("j").alias("point_id")).distinct(), bonds.select(*by, F.col("i").alias("point_id")).distinct()
