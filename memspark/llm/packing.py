"""Best-fit packing of tokenized documents into sequences: pieces above a third of the capacity are matched, at most
two a sequence, and smaller ones go best-fit, longest first, into the gaps that are left.

Which pieces share a sequence depends on their lengths alone. So the plan is made from how many pieces there are of
each length, at most `capacity` numbers however large the corpus is, and it is a list of patterns with multiplicities.
Pieces get a rank among those of their length, and (length, rank) looks up the sequence and the place in it.
"""

from __future__ import annotations

import bisect
import os
import zlib
from dataclasses import dataclass
from itertools import islice
from struct import pack
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sliced

CACHE_WORDS = 400_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids by white-space separated word, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space, and no token, character composition or special token spans any, so a text's ids
    are its words' ids joined. Likewise it parts letters from a full stop or comma after them and lower-cases, so such
    forms of a word share its ids. Words recur all the time; forms are kept, and beyond twice
    CACHE_WORDS the first CACHE_WORDS of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.word_ends = frozenset(i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>"))
        self.known: dict[bytes, bytes] = {}
        self.ends = dict(zip((b".", b","), self.raw([b".", b","]), strict=True))

    def raw(self, words: list[bytes]) -> list[bytes]:
        """Ids of words. Lower-case ASCII letters are what the model itself reads; other letters go joined by spaces,
        and are told apart by the tokens that end words; the rest goes one by one."""
        found: dict[bytes, list[int]] = {w: [t.id for t in self.model.tokenize(w.decode())] for w in words if w.isalpha() and w.islower()}
        rest = [w for w in words if w not in found]
        letters = [w for w in rest if letters_alone(w)]
        for k in range(0, len(letters), 200):
            some, parts, part = letters[k : k + 200], [], []
            for i in self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids:
                part.append(i)
                if i in self.word_ends:
                    parts.append(part)
                    part = []
            if len(parts) == len(some) and not part:
                found.update(zip(some, parts, strict=True))
        rest = [w for w in rest if w not in found]
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in rest], add_special_tokens=False)
        found.update((w, e.ids) for w, e in zip(rest, encoded, strict=True))
        return [pack(f"<{len(ids)}I", *ids) for ids in map(found.__getitem__, words)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.known) > 2 * CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS))
        known = self.known
        parts = [list(map(known.get, ws)) for ws in split]
        holes = [(ws, ps, [k for k, p in enumerate(ps) if p is None]) for ws, ps in zip(split, parts, strict=True) if None in ps]
        forms = [(w, *stem(w)) for w in {ws[k] for ws, _, ks in holes for k in ks}]
        stems = list({c for _, c, _ in forms if c not in known})
        known.update(zip(stems, self.raw(stems), strict=True))
        for w, c, end in forms:
            known[w] = known[c] + self.ends[end] if end else known[c]
        for ws, ps, ks in holes:
            for k in ks:
                ps[k] = known[ws[k]]
        return [b"".join(ps) for ps in parts]

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]


def stem(word: bytes) -> tuple[bytes, bytes]:
    """The form of a word that stands for it, and the full stop or comma that follows."""
    core, end = (word[:-1], word[-1:]) if word[-1:] in (b".", b",") else (word, b"")
    if core.isalpha():  # ASCII letters alone
        return core.lower(), end
    return (core, end) if end and letters_alone(core) else (word, b"")


def letters_alone(word: bytes) -> bool:
    """Whether a word is letters alone, also once it is composed and lower-cased."""
    text = word.decode("utf-8", "surrogatepass")
    return text.isalpha() and normalize("NFC", text).lower().isalpha()


def chunks(texts: list[str], size: int):
    """Runs of texts of about `size` characters: what is split into words at a time."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces of at most `capacity` ids, end_id included."""

    def run(batches):
        encoder, end = Encoder.of(path), np.array([end_id], dtype="<u4").tobytes()
        for b in sliced(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for at, some in chunks(texts, 200_000):
                rows, found = [], []
                for i, ids in enumerate(encoder.encode(some)):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        cut = ids[k : k + 4 * capacity]
                        rows.append(at + i)
                        found.append((k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array([x[n] for x in found], k) for n, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *arrays], names=names)

    fields = T._parse_datatype_string("piece int, start long, length long, ids_crc32 long").fields
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))


@dataclass
class Bins:
    """`count` sequences filled alike: runs of (length, pieces of it), and the ids left free."""

    count: int
    runs: list[tuple[int, int]]
    gap: int


def plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Patterns that place counts[length] pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[Bins] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # greedy matching: the longest with the longest that fits beside it
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else None
        if b is None:
            done.append(Bins(left[a], [(a, 1)], capacity - a))
            left[a] = 0
        elif b < a:
            n = min(left[a], left[b])
            done.append(Bins(n, [(a, 1), (b, 1)], capacity - a - b))
            left[a] -= n
            left[b] -= n
        elif left[a] > 1:
            done.append(Bins(left[a] // 2, [(a, 2)], capacity - 2 * a))
            left[a] %= 2
        elif k > 0:
            b = large[k - 1]
            done.append(Bins(1, [(a, 1), (b, 1)], capacity - a - b))
            left[a] -= 1
            left[b] -= 1
        else:
            done.append(Bins(1, [(a, 1)], capacity - a))
            left[a] = 0
        large = [n for n in large if left[n]]
    gaps: dict[int, list[Bins]] = {}
    order: list[int] = []

    def put(bins: Bins) -> None:
        if bins.gap not in gaps:
            gaps[bins.gap] = []
            bisect.insort(order, bins.gap)
        gaps[bins.gap].append(bins)

    for bins in done:
        put(bins)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):  # best fit, longest first
        c = left[n]
        while c:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                per = capacity // n
                if c // per:
                    put(Bins(c // per, [(n, per)], capacity - per * n))
                if c % per:
                    put(Bins(1, [(n, c % per)], capacity - c % per * n))
                break
            gap = order[k]
            bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            per = gap // n
            full = min(bins.count, c // per)
            if full:
                put(Bins(full, [*bins.runs, (n, per)], gap - per * n))
                c -= full * per
            rest = bins.count - full
            if rest and c:  # c < per
                put(Bins(1, [*bins.runs, (n, c)], gap - c * n))
                c, rest = 0, rest - 1
            if rest:
                put(Bins(rest, bins.runs, gap))
    return [bins for same in gaps.values() for bins in same]


def places(patterns: list[Bins]) -> np.ndarray:
    """Rows of (length, first rank, pieces a sequence, first sequence, offset), sorted: where ranks of a length go."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bins in patterns:
        offset = 0
        for n, per in bins.runs:
            rank = used.get(n, 0)
            rows.append((n, rank, per, base, offset))
            used[n] = rank + bins.count * per
            offset += n * per
        base += bins.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(found: DataFrame, salts: int) -> DataFrame:
    """found with `rank`, 0, 1, ... within each length. Pieces of a length are dealt over salts, numbered within each,
    and shifted by the counts of the salts before, so that a length many pieces share is no one task's work."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return (
        salted.withColumn("within", within)
        .join(shifts, ["length", "salt"])
        .select(*found.columns, (F.col("within") - 1 + F.col("shift")).alias("rank"))
    )


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the
    end id alone. Only documents longer than the capacity are cut, into pieces of the capacity and a shorter last one.
    Repeated rows are documents of their own. Sequences have no gaps, ids run from 0. An empty table gives no rows.
    """
    found = materialize(pieces(docs, path, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().limit(capacity + 1).collect()}
    table = places(plan(counts, capacity))
    salts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # as fine as the cluster deals rows
    span = 1 << 40
    keys = table[:, 0] * span + table[:, 1]
    names = found.columns

    def run(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c), dtype=np.int64) for c in ("length", "rank"))
            at = table[np.searchsorted(keys, length * span + rank, "right") - 1]
            step = rank - at[:, 1]
            sequence, offset = at[:, 3] + step // at[:, 2], at[:, 4] + step % at[:, 2] * length
            own = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = T._parse_datatype_string("sequence_id long, offset long").fields
    return ranked(found, salts).mapInArrow(run, T.StructType([*found.schema.fields, *fields]))
