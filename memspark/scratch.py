"""Written intermediate results: lineage is cut in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 100_000  # rows that may be sent to all tasks


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset and Spark runs in this one process, as in tests, a
    temporary folder takes its place; on a cluster an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='memspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into a new folder and read it back: lineage ends here, what is read twice is computed once,
    and the files survive lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, as the smaller side of a join: at most FEW rows are sent to all tasks, more are merged. Left alone, Spark
    goes by the size of files, and ids compress so well that millions of them would be gathered on the driver."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")
