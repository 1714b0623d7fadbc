"""Sinks (S21, S28-S30)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..dataset import ROW
from ..errors import make
from .detect import CLOUD_SCHEMES


def csv(df: DataFrame, path: str) -> None:
    """Data columns with a header."""
    df.drop(ROW).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def parquet(df: DataFrame, path: str) -> None:
    """S21."""
    df.drop(ROW).write.mode("overwrite").parquet(path)


def issues(df: DataFrame, path: str, limit: int = 1000) -> None:
    """The report's first issues as JSON lines."""
    df.limit(limit).coalesce(1).write.mode("overwrite").json(path)


def report(spark: SparkSession, value: dict, path: str) -> None:
    """A report as one JSON file, on any file system that Spark writes."""
    text(spark, json.dumps(value, default=str), path)


def text(spark: SparkSession, content: str, path: str) -> None:
    data(spark, content.encode(), path)


def data(spark: SparkSession, content: bytes, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def cloud_path(provider: str, bucket: str, key: str, account: str = "") -> str:
    """The URI that Spark writes to at a provider."""
    if provider not in CLOUD_SCHEMES:
        raise make("export_failed", f"unknown provider {provider!r}")
    host = f"{bucket}@{account}.dfs.core.windows.net" if provider == "azure" else bucket
    return f"{CLOUD_SCHEMES[provider]}://{host}/{key.lstrip('/')}"


def upload(df: DataFrame, provider: str, bucket: str, key: str, account: str = "", kind: str = "parquet") -> str:
    path = cloud_path(provider, bucket, key, account)
    df.drop(ROW).write.mode("overwrite").format(kind).save(path)
    return path
