"""Sinks: stage tables and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: What ``training.training_rows`` gives.
TRAINING = "seq string, target_reg_log double, target_class double, is_rc boolean, split string"


def write_stage(df: DataFrame, path: str, partition: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replace a stage table; CSV gets a header."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_stage(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_training_set(rows: DataFrame, path: str) -> None:
    """Rows with a column ``split``, one folder for each split that has rows."""
    write_stage(rows, path, ["split"])


def read_training_set(spark: SparkSession, path: str, split: str, schema: str | None = None) -> DataFrame:
    """One split; only its folder is read. With a schema (``TRAINING``), a set without any rows is an empty table."""
    return read_stage(spark, path, schema).where(f"split = '{split}'").drop("split")
