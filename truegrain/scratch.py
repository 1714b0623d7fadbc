"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.  Where the setting is
    absent a local one is set if Spark runs in one process, as in tests; on a
    cluster that is an error, for executors don't share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage, and survives lost executors because every executor
    reads the files from the shared folder.  Nothing reads the shuffles of the
    write again, so their files go when it ends.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(clean)
    path = f"{scratch_dir(spark)}/truegrain/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held) if held is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def clean(keep: int = 0) -> None:
    """Delete the scratch tables written so far but for the first ``keep``;
    frames that read them end."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing is left to delete with
            continue


def mark() -> int:
    """How many scratch tables there are, for ``clean`` to go back to."""
    return len(_written)
