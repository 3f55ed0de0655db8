"""Frames as a stream: histograms that grow while frames arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.functions.box import Box
from swarmframe.operators.density import bin_of
from swarmframe.operators.neighbors import ball


def windowed_counts(events: DataFrame, time: str, window: str, late: str, bins: int, low: float, high: float, value: str = "value") -> DataFrame:
    """window, bin, n of a streamed value; events later than ``late`` behind the watermark are dropped."""
    rows = events.withWatermark(time, late).withColumn("bin", bin_of(F.col(value), low, high, bins)).where("bin >= 0")
    return rows.groupBy(F.window(time, window).alias("window"), "bin").agg(F.count("*").alias("n"))


class RdfAccumulator:
    """Adds the bonds of whole frames, batch by batch; a batch that comes again replaces itself.

    path: a folder on shared storage for a table of counts by batch, from which a
    restarted driver goes on; without it counts live as long as this object.
    """

    def __init__(self, box: Box, r_max: float, bins: int, path: str | None = None):
        self.box, self.r_max, self.bins, self.path = box, r_max, bins, path
        self.batches: dict[int, dict[int, int]] = {}

    def add(self, frames: DataFrame, batch_id: int) -> None:
        bonds = ball(frames, self.box, self.r_max, half=True)
        rows = bonds.select(bin_of(F.col("distance"), 0.0, self.r_max, self.bins).alias("bin")).groupBy("bin").agg((2 * F.count("*")).alias("n"))
        if self.path is None:
            self.batches[batch_id] = {r["bin"]: r["n"] for r in rows.collect()}  # one row for each bin
        else:
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def counts(self, spark=None) -> list[int]:
        """Counts by bin over all batches; with a path, of the table (``spark`` reads it)."""
        if self.path is None:
            return [sum(b.get(k, 0) for b in self.batches.values()) for k in range(self.bins)]
        found = {r["bin"]: r["n"] for r in spark.read.schema("bin int, n long, batch long").parquet(self.path).groupBy("bin").agg(F.sum("n").alias("n")).collect()}
        return [found.get(k, 0) for k in range(self.bins)]

    def start(self, stream: DataFrame, checkpoint: str):
        """A query that feeds this accumulator; each file of the source holds whole frames."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.add(df, n)).start()


def sliding_counts(events: DataFrame, time: str, window: str, slide: str, late: str, key: str) -> DataFrame:
    """window, key, n over windows that overlap: a new one begins every ``slide``."""
    return events.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("window"), key).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """window, key, n of sessions: runs of a key's events without a pause of ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), key).agg(F.count("*").alias("n"))
