"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: object) -> DataFrame:
    reader = spark.read.format(kind).options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options: object) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**{k: str(v) for k, v in options.items()}).load(path)


def tokens(df: DataFrame, text: str = "text", out: str = "token") -> DataFrame:
    """A row per white-space separated token."""
    return df.withColumn(out, F.explode(F.split(F.col(text), " "))).filter(F.col(out) != "")
