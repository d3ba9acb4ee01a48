"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever ids are compared: it sorts last.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and Spark runs in this one process, as
    in tests, a temporary folder takes its place; on a cluster an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='memspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and what is read twice is
    computed once. The files survive lost executors; they are removed with the folder."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(column: str = "doc_id") -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def held_out(column: str = "doc_id") -> Column:
    """True for the fifth of ids that no model may learn from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sliced(batches, column: str | int, size: int = 4 << 20):
    """Arrow batches in runs of rows of about `size` bytes of a text column (a longer text is a run of its own), so that a
    worker holds a run's strings and words at a time, not those of thousands of whole texts."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right")))
            yield b.slice(at, stop - at)
            at = stop


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_chars: int) -> DataFrame:
    """label (0 or 1) and text of at most `limit` documents of each label, for a model to learn from on the driver.

    Held-out ids are never drawn, rows without a label neither. The ids with the least hash are drawn, so the sample
    is the same in each run and does not depend on partitions. Texts of over max_chars are left out of the sample (not
    of the scoring), and of an id with several rows the least text is taken, which bounds what the driver gets at
    2 * limit texts of max_chars characters.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    by = F.xxhash64("doc_id"), F.col("doc_id")
    drawn = [known.where(F.col("label") == v).orderBy(*by).limit(limit) for v in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = drawn[0].unionByName(drawn[1])  # 2 * limit rows of two numbers at most
    drawn_texts = texts.where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
    return drawn_texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ..., so that an operator's own names clash with none, and their new names
    by the old. Rename back with toDF(*docs.columns)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names
