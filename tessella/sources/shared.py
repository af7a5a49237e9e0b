"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is made only where none is set and all executors are this machine."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="tessella-"))
    return at.rstrip("/")


def write(df: DataFrame, name: str, *by: str) -> str:
    """Write a new table, in folders by the columns `by`; returns its path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return path


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: plans that use it several times compute it once."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
