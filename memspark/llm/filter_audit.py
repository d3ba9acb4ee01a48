"""What each of several filters does to a corpus, in every order of applying them.

The number of documents that fail all filters of a set is a sum of products of flags, so one aggregate gives it for all 32
sets. Inclusion and exclusion turn these into the survivors of any set of filters, and with them into what any order
removes at any step; the dividends of the same numbers give Shapley values. No order is ever run on the corpus.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
SPACE = r"[ \t-\r]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 100 words), B (under 80 % distinct words), C (over 10 % capitals), D (symbols)."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def by_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to D, good, toxic, count, later: for each text and its documents that agree in part and labels, how many
    they are and how many have a larger id than the least that holds the text.

    A document's flags are its text's, so documents meet as narrow rows by the digest of their text: repeated rows and
    copies add up before they are shuffled, and a text that a third of the corpus holds is a few rows."""
    text = F.coalesce("text", F.lit(""))
    flags = [f.cast("long").alias(k) for k, f in zip(FILTERS, failures(F.col("__ms_text")), strict=False)]
    rows = docs.select(id_key().alias("did"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("__ms_text"))
    rows = rows.select("did", "no_id", "part", F.unhex(F.sha2("__ms_text", 256)).alias("print"), *flags)
    own = ["part", "print", *FILTERS[:4]]
    rows = rows.groupBy("did", "no_id", *own).agg(F.count(F.lit(1)).alias("count"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("did")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    apart = F.when(F.col("no_id"), 1 + F.pmod(F.xxhash64("print"), F.lit(4096))).otherwise(0)  # null ids meet no label, and not each other
    known = known.withColumn("apart", F.pmod("did", F.lit(1)))  # 0; as a literal it would not be dealt by
    rows = rows.withColumn("apart", apart).join(known, ["did", "apart"], "left")
    rows = rows.fillna(False, ["good", "toxic"])
    groups = rows.groupBy(*own, "good", "toxic").agg(F.sum("count").alias("count"), F.min(F.struct("did", "count")).alias("least"))
    first = F.min("least.did").over(Window.partitionBy("print"))  # a row a part and pair of labels
    at_first = F.when(F.col("least.did") == first, F.col("least.count")).otherwise(0)
    return groups.select("part", *FILTERS[:4], "good", "toxic", "count", (F.col("count") - at_first).alias("later"))


def joint(texts: DataFrame) -> DataFrame:
    """part, and for each set of filters (bit k for the k-th) n, good and toxic: arrays of the documents, good and toxic
    ones among them, that fail all filters of the set; of all documents for the empty set."""
    last = 1 << (len(FILTERS) - 1)

    def product(s: int) -> Column:
        out = F.col("later") if s & last else F.col("count")
        for k, name in enumerate(FILTERS[:4]):
            out = out * F.col(name) if s >> k & 1 else out
        return out

    held = texts.groupBy("part", "good", "toxic").agg(*[F.sum(product(s)).alias(f"n{s}") for s in SETS])
    of = lambda rows: F.array(*[F.coalesce(F.sum(F.when(rows, F.col(f"n{s}"))), F.lit(0)) for s in SETS])
    return held.groupBy("part").agg(of(F.lit(True)).alias("n"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))


def survivors(fail_all: list[int]) -> np.ndarray:
    """By set of filters, the documents that none of them removes: the sum of (-1)^|T| fail_all[T] over its subsets T."""
    out = np.array([(-1) ** s.bit_count() * fail_all[s] for s in SETS], dtype=np.int64)
    for k in range(len(FILTERS)):
        for s in SETS:
            if s >> k & 1:
                out[s] += out[s ^ 1 << k]
    return out


def shapley(fail_all: list[int]) -> list[int]:
    """What each filter removes, summed over all orders: a set's dividend, (-1)^(|T| + 1) fail_all[T], is shared evenly."""
    orders = len(list(permutations(FILTERS)))
    return [sum((-1) ** (s.bit_count() + 1) * fail_all[s] * orders // s.bit_count() for s in SETS if s >> k & 1) for k in range(len(FILTERS))]


def effects(part: str, n: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """A row an order and step."""
    left, left_good, left_toxic = map(survivors, (n, good, toxic))
    shares, every, rows = shapley(n), len(SETS) - 1, []
    for order in permutations(range(len(FILTERS))):
        name, done = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            now = done | 1 << k
            removed = int(left[done] - left[now])
            alone = int(left[every ^ 1 << k] - left[every])
            lost = (int(x[done] - x[now]) for x in (left_good, left_toxic))
            rows.append((part, name, step, int(left[now]), removed, n[1 << k] - removed, alone, *lost, shares[k]))
            done = now
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (a language), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.

    A null text is an empty one, a null language the part "". Filter E fails a document if a smaller id has its text,
    in any part; a null id counts as the largest and has no labels, and rows of one id don't fail each other. A document
    with several labels is good, or toxic, if any of them says so. No documents, no rows; other columns are not read.
    """

    def run(batches):
        for b in batches:
            rows = [x for r in b.to_pylist() for x in effects(r["part"], r["n"], r["good"], r["toxic"])]
            if rows:
                names = ["part", "filter_order", "step", *COUNTS]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return joint(by_text(docs, labels)).mapInArrow(run, schema)
