"""URL filters: a cascade of Bloom filters tells exactly which keys of the corpus are listed, without a join.

Level 0 holds the listed keys; level 1 the corpus's keys that pass level 0 without being listed; level 2 the listed
keys that pass level 1; and so on, until no false positive is left. The first level that a key does not pass tells
whether it is listed. The answer is exact for every key of the corpus, since all of them were tried when it was built.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and where there is no `://`."""
    m = SPLIT.search(url) if url else None
    return (m[1].translate(LOWERED), m[2]) if m else ("", "")


@dataclass(frozen=True)
class Shapes:
    """The shapes that listed keys have: how many labels their hosts, how many characters their paths."""

    labels: tuple[int, ...]
    paths: tuple[int, ...]

    @staticmethod
    def of(rules: list[tuple[str, str]]) -> Shapes:
        return Shapes(tuple(sorted({h.count(".") + 1 for h, _ in rules})), tuple(sorted({len(p) for _, p in rules})))

    def keys(self, host: str, path: str) -> list[str]:
        """The keys that could fit a url, longest first: suffixes of its host at a dot, with prefixes of its path."""
        if not host and not path:
            return []
        labels = host.split(".") if len(host) < 10_000 else host.rsplit(".", max(self.labels) + 1)
        whole = len(labels)
        hosts = [".".join(labels[-k:]) for k in self.labels if k <= whole]
        found = [h + path[:n] for h in hosts for n in self.paths if n <= len(path)]
        return sorted(set(found), key=lambda k: (-len(k), k))


@dataclass
class Bloom:
    bits: int
    hashes: int
    seed: int
    data: np.ndarray = field(repr=False)

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key, seed=self.seed)
        a, b = h & (2**64 - 1), h >> 64 | 1
        return [((a + i * b) & (2**64 - 1)) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key))

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))


@dataclass
class Cascade:
    """Exact membership for the keys it was built over."""

    levels: list[Bloom] = field(default_factory=list)
    rest: frozenset[str] = frozenset()  # listed keys beyond the last level, normally none

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return key in self.rest if len(self.levels) % 2 == 0 else key not in self.rest


MAX_BITS = 1 << 31  # 256 MB a level; a longer list is an error, not a wrong answer
BLOCK = 1 << 14  # words of 32 bits that come to the driver as one row of 64 KB


def build_bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """A Bloom filter of the n rows of keys(key). Tasks return the words they touch, Spark ORs them by place and packs them,
    and what the driver gathers is the filter's own bytes, 64 KB a row: at most MAX_BITS, in 4 096 rows, however long the
    corpus is. The driver holds a level twice while it is put together."""
    bits, hashes = Bloom.shape(n, rate)
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits; more than {MAX_BITS} are not broadcast")
    empty = Bloom(bits, hashes, seed, np.empty(0, dtype=np.uint8))

    def place(batches):
        for b in batches:
            found = np.array([p for k in b.column(0).to_pylist() for p in empty.places(k)], dtype=np.int64)
            word, bit = found >> 5, np.left_shift(1, found & 31)
            words, back = np.unique(word, return_inverse=True)
            values = np.zeros(len(words), dtype=np.int64)
            np.bitwise_or.at(values, back, bit)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values)], names=["word", "value"])

    def pack(table: pa.Table) -> pa.Table:
        held = np.zeros(BLOCK, dtype="<u4")
        held[np.asarray(table["word"]) % BLOCK] = np.asarray(table["value"])
        return pa.table({"block": table["block"][:1], "bytes": pa.array([held.tobytes()], pa.binary())})

    touched = keys.select("key").mapInArrow(place, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    blocks = touched.withColumn("block", F.floor(F.col("word") / BLOCK)).groupBy("block").applyInArrow(pack, "block long, bytes binary")
    data = np.zeros((bits + 31) // 32, dtype="<u4")
    for block, held in blocks.collect():
        own = data[block * BLOCK : (block + 1) * BLOCK]
        own[:] = np.frombuffer(held, dtype="<u4")[: len(own)]
    return Bloom(bits, hashes, seed, data.view(np.uint8))


def build_cascade(universe: DataFrame, listed: DataFrame, n_universe: int, seed: int, max_levels: int = 24) -> Cascade:
    """universe(key): every key that will be asked for, repeats allowed, n_universe rows; listed(key): distinct.

    The first level's rate is |listed| / |universe|, so that about as many false positives are left as keys are
    listed; the others' is a half. Every level so has about |listed| keys, whatever the size of the corpus.
    """
    cascade = Cascade()
    inside, outside = listed.select("key"), None
    n_inside = inside.count()
    if not n_inside:
        return Cascade([], frozenset())
    for level in range(max_levels):
        now = inside if level % 2 == 0 else outside
        n = n_inside if level % 2 == 0 else n_outside
        rate = min(0.5, max(1e-9, n_inside / max(1, n_universe))) if level == 0 else 0.5
        bloom = build_bloom(now, n, rate, seed + level)
        cascade.levels.append(bloom)
        passes = _passing(bloom)
        if level == 0:
            outside = materialize(universe.mapInArrow(passes, "key string").distinct().join(listed, "key", "left_anti"), "cascade")
            n_outside = outside.count()
            if not n_outside:
                return cascade
        elif level % 2:
            inside = materialize(inside.mapInArrow(passes, "key string"), "cascade")
            n_inside = inside.count()
            if not n_inside:
                return cascade
        else:
            outside = materialize(outside.mapInArrow(passes, "key string"), "cascade")
            n_outside = outside.count()
            if not n_outside:
                return cascade
    left = (inside if max_levels % 2 == 0 else outside).limit(100_001).collect()
    if len(left) > 100_000:
        raise ValueError("the cascade has not closed")
    cascade.rest = frozenset(r[0] for r in left)
    return cascade


def _passing(bloom: Bloom):
    def run(batches):
        for b in batches:
            keys = [k for k in b.column("key").to_pylist() if k in bloom]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    return run


def url_verdicts(
    pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_column: str = "page_id"
) -> DataFrame:
    """Judge every url by rules (verdict, host, path).

    A rule fits its host and all subdomains if the url's path starts with the rule's; of those that fit, the longest
    wins; a key that is both allowed and blocked is blocked. A url in no list gets `default`. Returns the id, host,
    path, rule (its host and path joined, else null), verdict. Null urls and those without `://` have an empty host
    and path, fit no rule and get the default. One row out for each row in; an empty table gives an empty table.

    One cascade holds the blocked keys and one the allowed ones. The universe of both is every key of the corpus of a
    shape that some rule has. No url is joined to a rule.
    """
    spark: SparkSession = pages.sparkSession
    shapes = Shapes.of([(h, p) for _, h, p in rules])
    slim = pages.select(id_column, "url")

    def keyed(batches):
        for b in batches:
            keys = list({k for u in b.column("url").to_pylist() for k in shapes.keys(*parts(u))})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    universe = slim.mapInArrow(keyed, "key string")
    n_universe = slim.count() * max(1, len(shapes.labels) * len(shapes.paths))
    cascades = {}
    for seed, verdict in ((1000, "block"), (2000, "allow")):
        rows = sorted({h + p for v, h, p in rules if v == verdict})
        listed = spark.createDataFrame([(k,) for k in rows], "key string")
        cascades[verdict] = build_cascade(universe, listed, n_universe, seed)
    blocked, allowed = cascades["block"], cascades["allow"]

    def run(batches):
        for b in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                rule, verdict = None, default
                for key in shapes.keys(host, path):
                    if key in blocked:
                        rule, verdict = key, "block"
                    elif key in allowed:
                        rule, verdict = key, "allow"
                    if rule is not None:
                        break
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(verdict)
            arrays = [b.column(id_column), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_column, "host", "path", "rule", "verdict"])

    fields = T._parse_datatype_string("host string, path string, rule string, verdict string").fields
    return slim.mapInArrow(run, T.StructType([slim.schema[id_column], *fields]))
