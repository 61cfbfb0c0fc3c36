"""Project files: scope and document lists, name, notes, source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import normalize_path


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """The text of one file; a missing file is an error when it is read."""
    return spark.read.text(path, wholetext=True)


def scope_list(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path): trimmed non-blank lines as normalised project paths, each once."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line != ''").select(normalize_path(F.col("line"), root).alias("path")).distinct()


def document_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, path, is_technical) in file order; a `technical:` prefix sets the flag."""
    lines = _whole(spark, path).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line != ''")
    technical = F.col("line").startswith("technical:")
    return lines.select("pos", F.trim(F.regexp_replace("line", "^technical:", "")).alias("path"), technical.alias("is_technical"))


def project_name(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).select(F.trim("value")).first()[0]


def security_notes(spark: SparkSession, path: str) -> str | None:
    """Trimmed text, None if blank; a missing file is an error."""
    return (_whole(spark, path).select(F.nullif(F.regexp_replace("value", r"^\s+|\s+$", ""), F.lit(""))).first() or [None])[0]


def source_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of source files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def documents(spark: SparkSession, root: str, listed: DataFrame, *, strict: bool = True) -> DataFrame:
    """(pos, path, is_technical, text) of the listed documents (see document_list) below a folder.

    Files are read by Spark where they lie; the list decides order and flags. A
    listed file that is not there is an error, or has a null text if not strict.
    """
    base = root.rstrip("/")
    texts = source_texts(spark, base).select(normalize_path(F.regexp_replace("path", "^file:(//)?", ""), base).alias("path"), "text")
    rows = listed.withColumn("path", normalize_path(F.col("path"), base)).join(texts, "path", "left").select("pos", "path", "is_technical", "text")
    if strict and (lost := [r.path for r in rows.filter("text is null").select("path").limit(20).collect()]):
        raise FileNotFoundError(f"listed documents that are not there: {', '.join(sorted(lost))}")
    return rows


def numbered(parts: DataFrame, *, first: int = 1) -> DataFrame:
    """parts(pos, k, ...) with id: consecutive numbers by document, then place, whatever the order of tasks.

    Each document takes as many numbers as it has parts, so a number follows from
    its place and the sizes of the documents before it (one row a document).
    """
    sizes = parts.groupBy("pos").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("pos").orderBy("k")) - 1
    return parts.join(sizes.select("pos", before.alias("_before")), "pos").withColumn("id", (F.col("_before") + place + first).cast("long")).drop("_before")


def comments(spark: SparkSession, path: str, *, kind: str = "parquet", **options: str) -> DataFrame:
    """The comments table of a store (a folder, or kind `jdbc` with its options) without hidden ones; the filter reaches the store."""
    reader = spark.read.format(kind).options(**options)
    return (reader.load() if kind == "jdbc" else reader.load(path)).filter("status is null or status <> 'hidden'")
