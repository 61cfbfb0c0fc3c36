"""Snapshots, reports, step tables and dumps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 10
REPORT_VERSION = 5
PIPELINE_VARIANTS = ("Feature", "Requirement", "Behavior", "Characteristic", "FunctionalSemantic", "FunctionalPurpose", "PlacementRationale", "Condition", "Threat", "Invariant", "Validation")


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: int = SNAPSHOT_VERSION) -> None:
    """All tables; topics without what the pipeline made. The version is written last, so a broken write has none."""
    for name, df in tables.items():
        (df.filter(~F.col("variant").isin(*PIPELINE_VARIANTS)) if name == "topics" and "variant" in df.columns else df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(version, ",".join(sorted(tables)))], "version int, tables string").write.mode("overwrite").parquet(f"{path}/_meta")


def read_snapshot(spark: SparkSession, path: str, version: int = SNAPSHOT_VERSION) -> dict[str, DataFrame]:
    meta = spark.read.parquet(f"{path}/_meta").first()
    if meta.version != version:
        raise ValueError(f"snapshot version {meta.version}, expected {version}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta.tables.split(",")}


def write_report(spark: SparkSession, audit_id: str, topics: DataFrame, path: str) -> None:
    """One JSON line for each pipeline topic, a section for each variant, ordered by the id's text."""
    header = spark.createDataFrame([(REPORT_VERSION, audit_id)], "version int, audit_id string")
    header.write.mode("overwrite").json(f"{path}/header")
    rows = topics.filter(F.col("variant").isin(*PIPELINE_VARIANTS))
    rows.repartitionByRange("variant", "topic").sortWithinPartitions("variant", "topic").write.mode("overwrite").partitionBy("variant").json(f"{path}/sections")


def apply_report(spark: SparkSession, audit_id: str, topics: DataFrame, path: str) -> DataFrame:
    """Base topics without stale pipeline rows, with the report's rows; another version or audit is refused."""
    head = spark.read.json(f"{path}/header").first()
    if head.version != REPORT_VERSION or head.audit_id != audit_id:
        raise ValueError(f"report of version {head.version} for {head.audit_id}")
    rows = spark.read.schema(topics.schema).json(f"{path}/sections")
    return topics.filter(~F.col("variant").isin(*PIPELINE_VARIANTS)).unionByName(rows.select(*topics.columns))


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Run table builders in order; each result is written and a finished step is not run again. The first error stops."""
    done = dict(tables)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, build in steps:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if not where.getFileSystem(hadoop).exists(where):
            build(done).write.mode("overwrite").parquet(f"{path}/{name}")
        done[name] = spark.read.parquet(f"{path}/{name}")
    return done


def dump(views: dict[str, DataFrame], kinds: list[str], path: str) -> list[str]:
    """Write the named views as JSON lines; `all` stands for every view, repeats are dropped."""
    names = list(dict.fromkeys(n for k in kinds for n in (sorted(views) if k == "all" else [k])))
    for n in names:
        views[n].write.mode("overwrite").json(f"{path}/{n}")
    return names


def append_log(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, after those that the log folder already holds; a retried task adds none twice."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
