"""Pair distributions and densities: histograms of bonds, sums by point, grids.

Tables with a column ``frame`` give results for each frame.  Histograms add up all
frames unless ``per_frame`` is asked for.
"""

from __future__ import annotations

from math import ceil, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators import tiles
from swarmframe.operators.neighbors import _frame, ball


def bin_of(value: Column, low: float, high: float, n: int, clamp: bool = True) -> Column:
    """Regular bins; -1 outside low <= value < high.

    A value below high whose bin rounds up to n falls into the last bin.  Without
    clamp it keeps n, which ``dense`` leaves out as well: it can't be told from high.

    Never null, so that a search for bonds doesn't take the bin's expression as
    a condition of its own; ``dense`` leaves -1 out.
    """
    k = F.floor((value - low) / ((high - low) / n))
    k = (F.least(k, F.lit(n - 1)) if clamp else k).cast("int")
    return F.coalesce(F.when((value >= low) & (value < high), k), F.lit(-1))


def bin_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / n for k in range(n + 1)]


def bin_centers(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * (k + 0.5) / n for k in range(n)]


def dense(histogram: DataFrame, sizes: dict[str, int], fill: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Every bin of the axes (of each frame), those without rows filled with 0; the axes have a fixed number of bins."""
    spark = histogram.sparkSession
    total = 1
    for n in sizes.values():
        total *= n
    axes = spark.range(total)
    step = 1
    for name, n in reversed(list(sizes.items())):
        axes = axes.withColumn(name, (F.floor(F.col("id") / step) % n).cast("int"))
        step *= n
    axes = axes.drop("id")
    by = []
    if frames is not None:
        axes, by = frames.select("frame").distinct().withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))), ["frame"]
        step = 1
        for name, n in reversed(list(sizes.items())):
            axes = axes.withColumn(name, (F.floor(F.col("_a") / step) % n).cast("int"))
            step *= n
        axes = axes.drop("_a")
    return axes.join(histogram, [*by, *sizes], "left").na.fill(0, fill)


def shell_volume(dims: int, low: Column, high: Column) -> Column:
    return pi * (high * high - low * low) if dims == 2 else 4 / 3 * pi * (high * high * high - low * low * low)


def rdf(
    bonds: DataFrame, box: Box, n_points: int, n_queries: int, bins: int, r_max: float, r_min: float = 0.0, n_frames: int = 1,
    finite_size: bool = False, half: bool = False, per_frame: bool = False,
) -> DataFrame:
    """(frame,) bin, bin_count, g_r, n_r.  Bonds of several frames add up; box and numbers are those of one frame.

    half: the bonds hold each pair once, so each counts twice.  per_frame: a distribution for each frame.
    """
    by = _frame(bonds) if per_frame else []
    counted = bonds.select(*by, bin_of(F.col("distance"), r_min, r_max, bins).alias("bin")).groupBy(*by, "bin").agg((F.count("*") * (2 if half else 1)).alias("bin_count"))
    rows = dense(counted, {"bin": bins}, ["bin_count"], counted if by else None)
    width = (r_max - r_min) / bins
    low = F.lit(r_min) + F.col("bin") * width
    density = n_queries / box.volume * ((n_queries - 1) / n_queries if finite_size else 1)
    n_frames = 1 if by else n_frames
    g = F.col("bin_count") / (n_points * n_frames * density * shell_volume(box.dims, low, low + width))
    upto = Window.partitionBy(*by).orderBy("bin")
    return rows.select(*by, "bin", "bin_count", g.alias("g_r"), (F.sum("bin_count").over(upto) / (n_queries * n_frames)).alias("n_r"))


def rollup_rdf(bonds: DataFrame, bins: int, r_max: float, half: bool = False) -> DataFrame:
    """frame (null: all frames), bin, bin_count: every frame's histogram and the pooled one in one pass."""
    rows = bonds.select("frame", bin_of(F.col("distance"), 0.0, r_max, bins).alias("bin")).groupBy("frame", "bin").agg((F.count("*") * (2 if half else 1)).alias("n")).where("bin >= 0")
    return rows.groupingSets([["frame", "bin"], ["bin"]], "frame", "bin").agg(F.sum("n").alias("bin_count"))


def correlation(bonds: DataFrame, values: DataFrame | None, query_values: DataFrame | None, bins: int, r_max: float, per_frame: bool = False) -> DataFrame:
    """(frame,) bin, bin_count, re, im: mean of conj(value of j) * value of i over the bonds of a bin, 0 where there are none.

    values, query_values: (frame,) point_id, re, im; None where the bonds carry i_re, i_im, j_re, j_im.
    """
    by = _frame(bonds)
    rows = bonds
    for table, key in ((values, "j"), (query_values, "i")):
        if table is not None:
            own = _frame(table) and by
            rows = rows.join(table.select(*own, F.col("point_id").alias(key), F.col("re").alias(f"{key}_re"), F.col("im").alias(f"{key}_im")), [*own, key])
    by = by if per_frame else []
    rows = rows.select(*by, bin_of(F.col("distance"), 0.0, r_max, bins).alias("bin"), *[F.col(c).alias(n) for c, n in (("j_re", "a"), ("j_im", "b"), ("i_re", "c"), ("i_im", "d"))])
    means = rows.groupBy(*by, "bin").agg(F.count("*").alias("bin_count"), F.avg(F.expr("a * c + b * d")).alias("re"), F.avg(F.expr("a * d - b * c")).alias("im"))
    return dense(means, {"bin": bins}, ["bin_count", "re", "im"], means if by else None)


def correlation_within(points: DataFrame, box: Box, bins: int, r_max: float, per_frame: bool = False) -> DataFrame:
    """``correlation`` of all bonds below r_max of points that have re and im, summed by tiles and never made; no value is null.

    per_frame: every frame of the points, also those without bonds.
    """
    by = _frame(points) if per_frame else []
    sums = tiles.correlation_sums(points, box, r_max, bins).groupBy(*by, "bin").agg(F.sum("n").alias("bin_count"), F.sum("re").alias("re"))
    mean = F.when(F.col("bin_count") > 0, F.col("re") / F.col("bin_count")).otherwise(0.0)
    means = sums.select(*by, "bin", "bin_count", mean.alias("re"), F.lit(0.0).alias("im"))
    return dense(means, {"bin": bins}, ["bin_count", "re", "im"], points if by else None)


def local_density(points: DataFrame, box: Box, r_max: float, diameter: float, queries: DataFrame | None = None) -> DataFrame:
    """(frame,) point_id, num_neighbors, density; a point that crosses the sphere's edge counts in part."""
    asked = points if queries is None else queries
    by = _frame(points)
    bonds = ball(points, box, r_max + diameter / 2, queries=queries)
    d = F.col("distance")
    share = F.when(d < r_max - diameter / 2, 1.0).otherwise(1 + (r_max - (d + diameter / 2)) / diameter)
    sums = bonds.groupBy(*by, "i").agg(F.sum(share).alias("num_neighbors")).withColumnRenamed("i", "point_id")
    volume = pi * r_max**2 if box.is2d else 4 / 3 * pi * r_max**3
    return asked.select(*by, "point_id").join(sums, [*by, "point_id"], "left").na.fill(0.0, ["num_neighbors"]).withColumn("density", F.col("num_neighbors") / volume)


def _grid(points: DataFrame, box: Box, width: tuple[int, ...], r_max: float) -> DataFrame:
    """One row for each point and each cell centre within r_max: cell indices, _d2 and the point's columns."""
    axes = list(zip("xyz", box.lengths, width, strict=False))
    rows = points
    for c, length, n in axes:
        step = length / n
        reach = min(ceil(r_max / step), n // 2 if n > 1 else 0)
        at = F.floor((F.col(c) + length / 2) / step).cast("int")
        low, high = (-reach, reach) if 2 * reach + 1 <= n else (-((n - 1) // 2), n // 2)
        rows = rows.withColumn(f"_o{c}", F.explode(F.sequence(F.lit(low), F.lit(high))))
        rows = rows.withColumn(f"_d{c}", (at + F.col(f"_o{c}") + 0.5) * step - length / 2 - F.col(c))
        rows = rows.withColumn(f"_d{c}", F.col(f"_d{c}") - length * F.floor(F.col(f"_d{c}") / length + 0.5)).withColumn(f"i{c}", F.pmod(at + F.col(f"_o{c}"), F.lit(n)))
    d2 = sum((F.col(f"_d{c}") * F.col(f"_d{c}") for c, _, _ in axes[1:]), F.col("_dx") * F.col("_dx"))
    return rows.withColumn("_d2", d2).where(F.col("_d2") < r_max * r_max)


def gaussian_density(points: DataFrame, box: Box, width: int | tuple[int, ...], r_max: float, sigma: float, value: str | None = None, empty: bool = False) -> DataFrame:
    """(frame,) ix, iy(, iz), density of the cells that a point reaches.  Grid along the box's lengths.

    empty: also the cells that none reaches, with 0.
    """
    width = (width,) * box.dims if isinstance(width, int) else tuple(width)
    by = _frame(points)
    scale = (2 * pi * sigma * sigma) ** (-box.dims / 2)
    v = F.col(value) if value else F.lit(1.0)
    cells = [f"i{c}" for c in "xyz"[: box.dims]]
    found = _grid(points, box, width, r_max).groupBy(*by, *cells).agg(F.sum(v * scale * F.exp(-F.col("_d2") / (2 * sigma * sigma))).alias("density"))
    return dense(found, dict(zip(cells, width, strict=True)), ["density"], points if by else None) if empty else found


def sphere_voxelization(points: DataFrame, box: Box, width: int | tuple[int, ...], r_max: float) -> DataFrame:
    """(frame and) the cells whose centre lies within r_max of a point."""
    width = (width,) * box.dims if isinstance(width, int) else tuple(width)
    return _grid(points, box, width, r_max).select(*_frame(points), *[f"i{c}" for c in "xyz"[: box.dims]]).distinct()


__all__ = ["bin_centers", "bin_edges", "bin_of", "correlation", "dense", "gaussian_density", "local_density", "rdf", "rollup_rdf", "shell_volume", "sphere_voxelization"]
