"""What the operators share: tables on shared storage, code on executors, samples of labels."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmframe.plans.shipping import ship_package

_own_dir: list[str] = []
#: Spark's own setting: a finished query's shuffle files go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Longest labelled text, in bytes, that a model is fitted on.
TEXT_BOUND = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="swarmframe-"))
    return f"file://{_own_dir[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts the lineage: what follows is computed from files that survive the loss
    of an executor.  The query's shuffle files go when it has ended, the table when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(df._table_path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(target)


@atexit.register
def _drop_own_dir() -> None:
    import shutil

    for path in _own_dir:
        shutil.rmtree(path, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; also sees to it that executors can import this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_is(doc_id: str, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the held-out fold.

    The sample is the ``bound`` smallest hashes of doc_id, so reruns agree, and has
    one row, of the least text, for each id.  Texts above TEXT_BOUND bytes are left
    out, so the sample's size is bounded by ``bound * TEXT_BOUND``.  Only ids, of
    a proven bound, are broadcast.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~fold_is("doc_id", modulus, held_out) if modulus else F.lit(True))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= TEXT_BOUND)
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample, in ascending order of doc_id, in one task.

    The driver gets the model only, and a lost executor costs one task.
    """
    schema = pa.schema([(f.name, pa.int64() if f.name == "doc_id" else pa.string() if f.name == "text" else pa.int32()) for f in sample.schema])

    def run(batches):
        rows = pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema) for b in batches], schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows.sort_by("doc_id").combine_chunks()))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit(schema.empty_table())  # Spark leaves out a task without rows
