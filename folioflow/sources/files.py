"""Scans: raw files, tables by JDBC or Parquet, page output, the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The log's columns.
LOG_COLUMNS = ("serial", "date", "time", "level", "user_id", "user_email", "module", "event")


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of each file; Spark's scans skip files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def raw_file_stream(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def operation_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the log: lines whose first field is a number; `-` is null. Headers, rules, details and tracebacks are left out."""
    lines = spark.read.text(path)
    parts = F.transform(F.split("value", r" \| ", len(LOG_COLUMNS)), lambda x: F.trim(x))
    rows = lines.select(parts.alias("p")).where(F.col("p")[0].rlike("^[0-9]+$") & (F.size("p") == len(LOG_COLUMNS)))
    typed = rows.select(*[F.nullif(F.col("p")[i], F.lit("-")).alias(c) for i, c in enumerate(LOG_COLUMNS)])
    at = F.expr("try_to_timestamp(concat(date, ' ', time), 'yyyy-MM-dd HH:mm:ss')")
    return typed.select(F.col("serial").cast("long").alias("serial"), at.alias("at"), "level", F.expr("try_cast(user_id AS BIGINT)").alias("user_id"), "user_email", "module", "event")
