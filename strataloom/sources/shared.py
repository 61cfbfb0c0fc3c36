"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, a temporary folder; on a cluster that is an error."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def write_out(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df there and read it back: the plan ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
