"""Shared-folder tables and input shaping for the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset (tests on one machine) a temporary folder is set; a
    cluster without the setting is an error, since a local folder of one
    machine would be invisible to the others.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/strataloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew where the input has fewer splits than the cluster has cores (a single small file).

    Rows here are whole texts or blocks of texts, so the session's bounds of an
    Arrow batch (10,000 rows, 64 MB) are lowered, never raised: a batch takes
    memory in the executor and in its Python worker. The setting stays, since
    the plan that this prepares runs later.
    """
    for key, most in (BATCH_ROWS, BATCH_BYTES):
        set_to = df.sparkSession.conf.get(key, None)
        if set_to is None or not str(set_to).isdigit() or not 0 < int(set_to) <= most:
            df.sparkSession.conf.set(key, most)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables that a module of this package keeps in a worker while a task runs.
HELD: list[dict] = []


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that lets go of memory when its task ends: idle workers live on beside the next stage's."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for table in HELD:
                table.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def row_total(df: DataFrame) -> int:
    return df.count()


def small_enough(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df
