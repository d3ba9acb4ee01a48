"""Line dedup: hashes of lines are range-partitioned and sorted by document and position, first occurrences are
streamed, and what comes back is a compressed keep bitmap for each document instead of its text."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_key, numbered, sliced
from .runs import later_in_run

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, did, tid, pos) of each line whose key is long enough. tid tells rows of one doc_id apart by text."""
    lines = docs.select(
        id_key().alias("did"), F.xxhash64("text").alias("tid"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    keyed = lines.withColumn("key", F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER))
    return keyed.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "did", "tid", "pos"
    )


@F.pandas_udf(T.BinaryType())
def packed(positions: pd.Series) -> pd.Series:
    """Keep bitmap of a document: a bit a line up to the last dropped one, 1 for kept, packed and deflated."""

    def pack(x) -> bytes:
        bits = np.ones(-(-(int(max(x)) + 1) // 8) * 8, dtype=bool)
        bits[np.asarray(x)] = False
        return zlib.compress(np.packbits(bits).tobytes())

    return positions.map(pack)


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of n_lines a bitmap keeps; lines beyond its end are kept, and None keeps all."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(did, tid, bitmap) of each document that loses a line.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of at least
    min_chars code points that two or more documents hold lose all their lines but those in the smallest doc_id that
    holds them. Null or empty texts have one empty line, which stays. A null doc_id counts as the largest id. Rows of
    one doc_id count as one document. An empty table gives no bitmaps.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drops = later_in_run(line_occurrences(texts, min_chars), ["h1", "h2"], "did", ["pos", "tid"], "repeats")
    return drops.groupBy("did", "tid").agg(packed(F.collect_set("pos")).alias("bitmap"))


def with_bitmaps(source: DataFrame, bitmaps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """source and, last, the bitmap of each row, null for those that keep all lines."""
    keyed = source.withColumns({"did": id_key(doc_id), "tid": F.xxhash64(F.coalesce(text, F.lit("")))})
    return keyed.join(bitmaps, ["did", "tid"], "left").select(*source.columns, "bitmap")


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    keep = unpack(bitmap, len(lines))
    return len(lines), int((~keep).sum()), "\n".join(line for line, k in zip(lines, keep, strict=True) if k)


def deduplicated(docs: DataFrame, min_chars: int = 10, least_words: int = 0) -> DataFrame:
    """docs with all columns, their texts without the lines that earlier documents hold.

    Which lines go is said in keep_bitmaps. A document that loses lines and is left with fewer than least_words words
    goes too; one that loses none stays whatever its length. Null texts stay null, repeated rows are treated alike, and
    an empty table gives an empty table.
    """
    source, names = numbered(docs)
    text = names["text"]

    def apply(batches):
        for b in sliced(batches, text):
            i = b.schema.get_field_index(text)
            rows = zip(b.column(text).to_pylist(), b.column("bitmap").to_pylist(), strict=True)
            texts = [t if m is None else kept_text(t, m)[2] for t, m in rows]
            columns = [pa.array(texts, b.schema.field(i).type) if k == i else b.column(k) for k in range(b.num_columns - 1)]
            out = pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
            if least_words:
                lost = b.column("bitmap").is_valid().to_pylist()
                out = out.filter(pa.array([not x or len(t.encode("utf-8", "surrogatepass").split()) >= least_words for t, x in zip(texts, lost, strict=True)]))
            yield out

    joined = with_bitmaps(source, keep_bitmaps(docs, min_chars), names["doc_id"], text)
    return joined.mapInArrow(apply, source.schema).toDF(*docs.columns)


def line_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document, from its keep bitmap."""

    def digest(batches):
        for b in batches:
            found = [kept_text(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("bitmap").to_pylist(), strict=True)]
            hashes = [hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in found]
            counts = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            arrays = [b.column("doc_id"), *counts, pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select("doc_id", "text")
    fields = T._parse_datatype_string("n_lines long, n_dropped long, kept_sha256 string").fields
    joined = with_bitmaps(slim, keep_bitmaps(slim, min_chars), "doc_id", "text")
    return joined.mapInArrow(digest, T.StructType([docs.schema["doc_id"], *fields]))
