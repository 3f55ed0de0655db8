"""Mean squared displacement of trajectories (frame, particle, x, y, z)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.functions.box import Box


def unwrapped(trajectory: DataFrame, box: Box) -> DataFrame:
    """Places in the boxes that the images (ix, iy, iz) name, as displacements need them."""
    at = box.unwrap(tuple(F.col(c) for c in "xyz"), [F.col(f"i{c}") for c in "xyz"[: box.dims]])
    return trajectory.withColumns(dict(zip("xyz", at, strict=True)))


def msd_particles(trajectory: DataFrame) -> DataFrame:
    """particle, frame, squared displacement from the particle's first frame; batches of particles are a union."""
    start = Window.partitionBy("particle").orderBy("frame")
    d2 = sum(((F.col(c) - F.first(c).over(start)) ** 2 for c in "yz"), (F.col("x") - F.first("x").over(start)) ** 2)
    return trajectory.select("particle", "frame", d2.alias("msd"))


def msd_direct(trajectory: DataFrame) -> DataFrame:
    """frame, msd from each particle's first frame, over the particles that have the frame."""
    start = Window.partitionBy("particle").orderBy("frame")
    d2 = sum(((F.col(c) - F.first(c).over(start)) ** 2 for c in "yz"), (F.col("x") - F.first("x").over(start)) ** 2)
    return trajectory.select("frame", d2.alias("d2")).groupBy("frame").agg(F.avg("d2").alias("msd"))


def msd_window(trajectory: DataFrame) -> DataFrame:
    """lag, msd over all start frames, then over the particles that last so long, by FFT within each trajectory.

    A particle's frames are one group of bounded length; particles are spread.
    """

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table["frame"].to_numpy(), kind="stable")
        r = np.column_stack([table[c].to_numpy()[order] for c in "xyz"]).astype(float)
        r -= r.mean(axis=0)
        n = len(r)
        f = np.fft.rfft(r, 2 * n, axis=0)
        auto = np.fft.irfft((f * f.conj()).real, axis=0)[:n].sum(axis=1)
        square = (r * r).sum(axis=1)
        head = np.concatenate([[0], np.cumsum(square)])
        lag = np.arange(n)
        sums = head[n - lag] + (head[n] - head[lag])
        return pa.table({"lag": lag, "d2": np.maximum((sums - 2 * auto) / (n - lag), 0)})

    each = trajectory.select("particle", "frame", "x", "y", "z").groupBy("particle").applyInArrow(one, "lag long, d2 double")
    return each.groupBy("lag").agg(F.avg("d2").alias("msd"))
