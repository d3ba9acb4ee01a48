"""Benchmark decontamination: suffix arrays over shards of the training words, in which every suffix of every test
item is binary-searched. This gives the longest verbatim matches and where they are, and from them the words hit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, sliced

#: ASCII letters and digits make words, lower-cased, and so does all beyond ASCII; the rest of ASCII parts them.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


@dataclass(frozen=True)
class TestSet:
    """Items' words as numbers from 1 up; the corpus's other words are 0."""

    codes: dict[bytes, int]
    items: list[tuple[str, np.ndarray]]
    window: int

    @staticmethod
    def of(rows: list[tuple[str, str | None]], window: int) -> TestSet:
        codes: dict[bytes, int] = {}
        items = []
        for item, text in rows:
            ws = words_of(text)
            if ws:
                items.append((item, np.array([codes.setdefault(w, len(codes) + 1) for w in ws], dtype=np.int64)))
        return TestSet(codes, items, window)

    def least(self) -> int:
        """Words in the shortest window."""
        return min((min(self.window, len(x)) for _, x in self.items), default=0)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text sorted by at least their first `depth` numbers, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(0, n - k)] = rank[k:] + 1
        kinds, new = np.unique(rank * (int(rank.max(initial=0)) + 2) + follow, return_inverse=True)
        rank, k = new.astype(np.int64), 2 * k
        if len(kinds) == n:
            break
    return np.argsort(rank, kind="stable")


def narrowed(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray, after: bool) -> np.ndarray:
    """By binary search, all intervals of the suffix array at once: the first place in each where the word at `depth` is
    not below the wanted one, or with `after` where it is above."""
    low, high = low.copy(), high.copy()
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        found = text[order[mid] + depth]
        below = found <= wanted[live] if after else found < wanted[live]
        low[live] = np.where(below, mid + 1, low[live])
        high[live] = np.where(below, high[live], mid)
    return low


def search(text: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in the item, place in the text) of every occurrence of every window: each test suffix narrows its
    interval of the suffix array word by word, all suffixes side by side, to the length of its item's window."""
    sizes = np.array([len(x) for _, x in tests.items], dtype=np.int64)
    windows = np.minimum(sizes, tests.window)
    words = np.concatenate([x for _, x in tests.items])
    item = np.repeat(np.arange(len(sizes)), sizes - windows + 1)  # of each suffix that a window begins
    start = np.concatenate([np.arange(n - w + 1) for n, w in zip(sizes, windows, strict=True)])
    at = start + np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes - windows + 1)
    order = suffix_array(text, tests.window)
    padded = np.concatenate([text, np.full(tests.window + 1, -1, dtype=np.int64)])
    heads = padded[order]
    low, high = np.searchsorted(heads, words[at], "left"), np.searchsorted(heads, words[at], "right")
    done = []
    for depth in range(1, tests.window + 1):
        live = low < high
        item, start, at, low, high = item[live], start[live], at[live], low[live], high[live]
        whole = windows[item] == depth
        counts = (high - low)[whole]
        first = np.cumsum(counts) - counts
        spread = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(low[whole], counts)
        done.append((np.repeat(item[whole], counts), np.repeat(start[whole], counts), order[spread]))
        item, start, at, low, high = item[~whole], start[~whole], at[~whole], low[~whole], high[~whole]
        if not len(item):
            break
        wanted = words[at + depth]
        low, high = (narrowed(padded, order, low, high, depth, wanted, after) for after in (False, True))
    return tuple(map(np.concatenate, zip(*done, strict=True)))


def match_shard(texts: list[str | None], tests: TestSet) -> list[tuple]:
    """For each text: number of words, merged spans of words hit as flat [begin, end, ...], numbers of the items found,
    length and first word of its longest verbatim match.

    Only words of the test set can match, so the suffix array is built over the runs of such words that are as long as
    the shortest window; nothing else of the shard could begin or continue a match.
    """
    least = tests.least()
    sizes = np.zeros(len(texts), dtype=np.int64)
    kept: list[np.ndarray] = []
    origin: list[np.ndarray] = []
    at = 0
    for i, text in enumerate(texts):
        ws = words_of(text)
        n = sizes[i] = len(ws)
        if least and n >= least:
            ids = np.fromiter(map(tests.codes.get, ws, repeat(0)), dtype=np.int64, count=n)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= least:
                    kept += [ids[a:b], np.zeros(1, dtype=np.int64)]
                    origin += [np.arange(at + a, at + b), np.array([-1])]
        at += n
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    longest: dict[int, tuple[int, int]] = {}
    if kept:
        text, place = np.concatenate(kept), np.concatenate(origin)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        item, start, found = search(text, tests)
        words = place[found]
        doc = np.searchsorted(offsets, words, "right") - 1
        begin = words - offsets[doc]
        by = np.lexsort((begin, begin - start, item, doc))  # windows that follow each other in item and text are one match
        doc, item, start, begin = doc[by], item[by], start[by], begin[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start) != 1) | (np.diff(begin) != 1)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts, len(by))[1:] - 1  # none if nothing is found
        for k, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            i, a = int(doc[k]), int(begin[k])
            b = int(begin[last]) + min(tests.window, len(tests.items[item[k]][1]))
            spans.setdefault(i, []).append((a, b))
            items.setdefault(i, set()).add(int(item[k]))
            longest[i] = max(longest.get(i, (0, 0)), (b - a, -a))
    out = []
    for i in range(len(texts)):
        best = longest.get(i)
        out.append((int(sizes[i]), merged(spans.get(i, ())), sorted(items.get(i, ())), best[0] if best else 0, -best[1] if best else None))
    return out


def merged(spans) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def test_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most about block_bytes of text; what the driver holds and broadcasts at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        chosen = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield [(r[0], r[1]) for r in chosen.collect()]


FIELDS = "n_words long, spans array<long>, items array<string>, longest long, longest_at long"


def matches(
    docs: DataFrame, items: DataFrame, window: int = 10, columns: tuple[str, ...] = ("doc_id",), text: str = "text", block_bytes: int = 64 << 20
) -> DataFrame:
    """The given columns of docs with n_words, spans (merged, flat [begin, end) pairs of words hit), items (ids as text),
    longest, longest_at (length and first word of the longest verbatim match).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A window is `window` consecutive words of an
    item, or a whole shorter item. Items without words and null texts match nothing; a text without words has n_words 0
    and nothing else. Rows are independent, so repeated rows each get their result. Empty tables give empty results,
    and an empty test set leaves all documents clean.

    One pass over the texts without a shuffle: a run of texts of an Arrow batch is a shard with its own suffix array. The test set is
    broadcast in blocks of block_bytes; with more than one block, there is a pass over the texts for each.
    """
    source = docs.select(*columns, *([text] if text not in columns else []))
    plain = source.schema.fields
    fields = T._parse_datatype_string(FIELDS).fields
    added = [f.name for f in fields]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64())
    for number, block in enumerate(test_blocks(items, block_bytes)):

        def run(batches, tests=TestSet.of(block, window), own=source.columns[: len(plain)], again=number > 0):
            labels = [item for item, _ in tests.items]
            for b in sliced(batches, text):
                shard = match_shard(b.column(text).to_pylist(), tests)
                found = [(n, spans, [labels[k] for k in ks], *rest) for n, spans, ks, *rest in shard]
                if again:
                    old = zip(*(b.column(c).to_pylist() for c in added), strict=True)
                    found = [joined(x, y) for x, y in zip(old, found, strict=True)]
                arrays = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *arrays], names=[*own, *added])

        source = source.mapInArrow(run, T.StructType([*plain, *fields]))
    return source.select(*columns, *added)


def joined(x: tuple, y: tuple) -> tuple:
    spans = merged([*zip(x[1][::2], x[1][1::2], strict=True), *zip(y[1][::2], y[1][1::2], strict=True)])
    best = max((x[3], -(x[4] or 0), x[4]), (y[3], -(y[4] or 0), y[4]), key=lambda t: t[:2])
    return x[0], spans, sorted({*x[2], *y[2]}, key=lambda i: (i is None, i or "")), best[0], best[2]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest and longest_at of each document.

    A row out for each row in, null ids and repeated rows too; what `matches` says of null texts, items without words and
    empty tables holds. A null item_id counts as an item and adds nothing to the hash."""
    found = matches(docs, items, window)
    edges = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(edges, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
        F.col("longest_at").alias("longest_match_at"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs, all columns, without the rows that hold a window of an item; rows are judged one by one, so null ids and
    repeated rows stay if they are clean, and null texts are."""
    source, names = numbered(docs)
    found = matches(source, items, window, tuple(names.values()), names["text"])
    return found.where(F.size("spans") == 0).select(*names.values()).toDF(*docs.columns)
