"""Streams over event folders: windows, latest votes and statuses, fan-out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.shared import shared_folder


def open_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, *, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by event type; rows later than the watermark are dropped, unless the stream runs in complete mode."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, *, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def _run(stream: DataFrame, name: str, mode: str) -> tuple[str, list[int]]:
    """Run a stream over all that is there: (folder of the outputs, batches that have one)."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/strataloom-stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/{n}")).start().awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{base}/out", sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The last result of a stream over all that is there, kept in the shared folder; nothing arrived: no rows."""
    out, batches = _run(stream, name, mode)
    read = stream.sparkSession.read.schema(stream.schema)
    return read.parquet(f"{out}/{batches[-1]}") if batches else stream.sparkSession.createDataFrame([], stream.schema)


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The state of a stream that was run in update mode: the last update of each key.

    The watermark works here: rows that are later are dropped, and the state of
    windows that it has passed is let go.
    """
    out, batches = _run(stream, name, "update")
    spark = stream.sparkSession
    if not batches:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).parquet(*(f"{out}/{n}" for n in batches)).withColumn("_n", F.regexp_extract(F.input_file_name(), r"/out/(\d+)/", 1).cast("long"))
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_n").alias("_v")).select(*keys, "_v.*")


def upsert_latest(stored: DataFrame, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The state after a batch: the last write of each key wins; applying a batch twice changes nothing."""
    both = stored.unionByName(batch)
    values = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("_v")).select(*keys, "_v.*")


def affected(events: DataFrame) -> DataFrame:
    """events(audit_id, topic, mentions, invalidated) -> one update for each target and mention; only the first carries the invalidated threads."""
    rows = events.select("audit_id", "invalidated", F.posexplode(F.array_distinct(F.concat(F.array("topic"), F.coalesce("mentions", F.array().cast("array<string>"))))).alias("pos", "topic"))
    return rows.select("audit_id", "topic", F.when(F.col("pos") == 0, F.col("invalidated")).alias("invalidated"))


def for_audit(stream: DataFrame, audit_id: str) -> DataFrame:
    return stream.filter(F.col("audit_id") == audit_id)
