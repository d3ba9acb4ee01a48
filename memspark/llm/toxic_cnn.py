"""Toxicity: a convolutional text classifier over hashed word embeddings, with filters of several widths and max
pooling, trained in numpy on a bounded sample, its thresholds calibrated by the language that the text seems to be in."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample
from .decontam import words_of
from .packing import chunks

BUCKETS = 1 << 18
SIZE, WIDTHS, FILTERS = 8, (1, 2, 3), 8
CACHE_WORDS = 300_000
START, STEP = 0.05, 0.1

#: Frequent function words, by language.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as his on be at by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht",
    "fr": "le les et des en un du une que est pour qui dans au pas sur avec",
    "es": "el los y del las un por con no una su para es al lo como más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_of = {w.encode(): k for k, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()}
SIGNS = {w: k for w, k in _of.items() if sum(w.decode() in ws.split() for ws in FUNCTION_WORDS.values()) == 1}


def language(counts: Counter) -> int:
    """Number in LANGUAGES of the language whose own function words a text has most of."""
    found = [0] * len(FUNCTION_WORDS)
    for w, k in SIGNS.items():
        found[k] += counts.get(w, 0)
    best = max(range(len(found)), key=found.__getitem__)
    return best if found[best] else len(FUNCTION_WORDS)


def buckets(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its first four, five and six characters."""
    text = word.decode("utf-8", "surrogatepass")
    starts = (text, "4" + text[:4], "5" + text[:5], "6" + text[:6])
    return tuple(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS for s in starts)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x SIZE
    filters: list[np.ndarray]  # by width: width x SIZE x FILTERS
    shifts: list[np.ndarray]  # by width: FILTERS
    weights: np.ndarray  # over all pooled filters
    bias: float
    cuts: list[float] = field(default_factory=lambda: [0.0] * len(LANGUAGES))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.embedding[ids].sum(axis=1)

    def tables(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """What a word adds to each filter at each place of its width."""
        return [[vectors @ f[k] for k in range(len(f))] for f in self.filters]

    def pooled(self, tables: list[list[np.ndarray]], texts: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter, at least 0, over each of texts, given as rows of tables; a row a text."""
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), dtype=np.float32)
        for some, ids, starts in stretches(texts):
            for w in range(len(WIDTHS)):
                top, _ = self.tops(tables[w], w, ids, starts)
                cut = slice(w * FILTERS, (w + 1) * FILTERS)
                for row, values in zip(some, top, strict=True):  # a long text comes in several stretches
                    out[row, cut] = np.maximum(out[row, cut], values)
        return out

    def tops(self, parts: list[np.ndarray], w: int, ids: np.ndarray, starts: np.ndarray, places: bool = False):
        """Largest responses of the filters of the w-th width over texts that lie in ids behind each other, each followed
        by the number 0 of the gap between texts; and the places in ids where they are, -1 if nothing fits."""
        width, n = WIDTHS[w], len(ids)
        ends = np.append(starts[1:], n) - 1  # of the texts; their gaps are there
        response = np.full((n, FILTERS), -np.inf, dtype=np.float32)
        last = n - width + 1
        if last > 0:
            response[:last] = parts[0][ids[:last]] + self.shifts[w]
            for k in range(1, width):
                response[:last] += parts[k][ids[k : last + k]]
        for back in range(width):  # windows that reach a gap
            response[np.maximum(ends - back, 0)] = -np.inf
        top = np.maximum.reduceat(response, starts, axis=0)
        if not places:
            return top, None
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        rows, columns = np.nonzero((response == top[owner]) & np.isfinite(response))
        where = np.full(top.shape, -1, dtype=np.int64)
        where[owner[rows[::-1]], columns[::-1]] = rows[::-1]  # the first of equal ones
        return top, where


def stretches(texts: list[np.ndarray], size: int = 100_000):
    """(rows of texts, ids, starts): about `size` words at a time, each text followed by a gap, numbered 0. A text longer
    than that comes in stretches that overlap by the widest filter."""
    rows, parts, total = [], [], 0
    for row, ids in enumerate(texts):
        for at in range(0, max(1, len(ids)), size):
            part = ids[at : at + size + max(WIDTHS) - 1]
            rows.append(row)
            parts.append(part)
            total += len(part) + 1
            if total >= size:
                yield joined(rows, parts)
                rows, parts, total = [], [], 0
    if rows:
        yield joined(rows, parts)


def joined(rows: list[int], parts: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    gap = np.zeros(1, dtype=np.int64)
    return rows, np.concatenate([x for p in parts for x in (p, gap)]), starts


class Words:
    """Numbers of words from 1 up, 0 being the gap between texts, and the filter tables of those numbers; the commonest
    words recur all the time."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.tables: list[list[np.ndarray]] = model.tables(np.zeros((1, SIZE), dtype=np.float32))

    def number(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.__init__(self.model)
        known = self.known
        new = list(set().union(*(filterfalse(known.__contains__, ws) for ws in texts)))
        if new:
            known.update(zip(new, range(len(known) + 1, len(known) + len(new) + 1), strict=True))
            more = self.model.tables(self.model.vectors(np.array([buckets(w) for w in new], dtype=np.int64)))
            self.tables = [[np.concatenate([a, b]) for a, b in zip(x, y, strict=True)] for x, y in zip(self.tables, more, strict=True)]
        return [np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in texts]


def train(
    features: np.ndarray, ids: list[np.ndarray], y: np.ndarray, epochs: int = 5, least_steps: int = 400, rate: float = 0.02, seed: int = 3
) -> Model:
    """Fit on labels 0, 1 and texts as numbers of words, from 1 up; features[number] are a word's buckets.

    Embeddings, filters and weights all start small and random and are learned by back-propagation through the pooled
    places. Buckets of fewer than two texts stay at zero, so that words never met say nothing.
    """
    draw = np.random.default_rng(seed)
    totals = np.bincount(y, minlength=2).astype(float)
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for own in ids:
        seen[np.unique(features[np.unique(own)])] += 1
    used = seen >= 2
    embedding = np.zeros((BUCKETS, SIZE), dtype=np.float32)
    embedding[used] = draw.normal(0, START, (int(used.sum()), SIZE))
    filters = [draw.normal(0, 0.5 / np.sqrt(width), (width, SIZE, FILTERS)).astype(np.float32) for width in WIDTHS]
    shifts = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    weights = np.tile(np.where(np.arange(FILTERS) % 4 < 3, 0.3, -0.3), len(WIDTHS)).astype(np.float32)
    model = Model(embedding, filters, shifts, weights, -1.0)
    if len(set(y.tolist())) < 2:
        model.bias = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        model.weights[:] = 0
        return model
    moments: dict[str, list[np.ndarray]] = {}
    steps = 0

    def adam(name: str, gradient: np.ndarray) -> np.ndarray:
        m = moments.setdefault(name, [np.zeros_like(gradient), np.zeros_like(gradient)])
        m[0] = 0.9 * m[0] + 0.1 * gradient
        m[1] = 0.99 * m[1] + 0.01 * gradient**2
        return rate * (m[0] / (1 - 0.9**steps)) / (np.sqrt(m[1] / (1 - 0.99**steps)) + 1e-6)

    slopes = np.full(BUCKETS, 1e-8, dtype=np.float32)  # sums of squared gradients, by bucket
    balance = len(y) / (2 * np.maximum(1, totals))
    for _ in range(max(epochs, -(-least_steps // -(-len(y) // 32))) if epochs else 0):  # a small sample is gone over more often
        order = draw.permutation(len(y))
        for at in range(0, len(order), 32):
            steps += 1
            batch = order[at : at + 32]
            _, own, starts = joined([*batch], [ids[i] for i in batch])
            kinds, local = np.unique(own, return_inverse=True)
            vectors = model.vectors(features[kinds])
            vectors[kinds == 0] = 0
            tables = model.tables(vectors)
            found = [model.tops(tables[w], w, local, starts, places=True) for w in range(len(WIDTHS))]
            pooled = np.maximum(np.concatenate([top for top, _ in found], axis=1), 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
            error = ((p - y[batch]) * balance[y[batch]] / len(batch)).astype(np.float32)
            back = error[:, None] * model.weights[None, :] * (pooled > 0)
            change = np.zeros_like(vectors)
            for w, width in enumerate(WIDTHS):
                g, where = back[:, w * FILTERS : (w + 1) * FILTERS], found[w][1]
                text, column = np.nonzero((g != 0) & (where >= 0))
                value = g[text, column]
                g_filter = 1e-3 * model.filters[w]
                for k in range(width):
                    hit = local[where[text, column] + k]
                    np.add.at(g_filter[k].T, column, vectors[hit] * value[:, None])
                    np.add.at(change, hit, model.filters[w][k][:, column].T * value[:, None])
                model.shifts[w] -= adam(f"s{w}", g.sum(axis=0)).astype(np.float32)
                model.filters[w] -= adam(f"f{w}", g_filter).astype(np.float32)
            model.weights -= adam("weights", error @ pooled + 1e-3 * model.weights).astype(np.float32)
            model.bias -= float(adam("bias", np.array([error.sum()]))[0])
            moved = np.flatnonzero(np.abs(change).sum(axis=1) * (kinds > 0))
            touched = features[kinds[moved]].ravel()
            rows = np.repeat(change[moved], features.shape[1], axis=0)
            live = used[touched]
            touched, rows = touched[live], rows[live]
            np.add.at(slopes, touched, (rows**2).mean(axis=1))
            np.subtract.at(model.embedding, touched, STEP * rows / np.sqrt(slopes[touched])[:, None])
    return model


def logits(model: Model, texts: list[list[bytes]], words: Words | None = None) -> np.ndarray:
    words = words or Words(model)
    numbered = words.number(texts)
    return (model.pooled(words.tables, numbered) @ model.weights + model.bias).astype(float)


def best_cut(values: np.ndarray, y: np.ndarray, care: float = 3.0) -> float | None:
    """The middle of the cuts with the best mean accuracy of both labels, that on clean texts counting `care` times;
    None without both."""
    bad, good = np.sort(values[y == 1]), np.sort(values[y == 0])
    if not len(bad) or not len(good):
        return None
    edges = np.unique(values)
    tries = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
    value = 1 - np.searchsorted(bad, tries, "left") / len(bad) + care * np.searchsorted(good, tries, "left") / len(good)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return float((tries[best[0]] + tries[best[-1]]) / 2)


def calibrate(values: np.ndarray, y: np.ndarray, languages: np.ndarray, least: int = 5) -> list[float]:
    """A cut for each language: its own where it has `least` examples of both labels, else the cut of all together."""
    common = best_cut(values, y)
    common = 0.0 if common is None else common
    cuts = []
    for k in range(len(LANGUAGES)):
        own = languages == k
        enough = min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least
        cuts.append(best_cut(values[own], y[own]) if enough else common)
    return cuts


def numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets of each word by its number, and the texts as numbers; number 0 is no word."""
    words = sorted(set().union(*texts)) if texts else []
    number = {w: i for i, w in enumerate(words, 1)}
    features = np.array([(0, 0, 0, 0), *map(buckets, words)], dtype=np.int64)
    return features, [np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in texts]


def fit(rows: list[tuple[int, int, str]], calibration: float = 0.25) -> Model:
    """rows: (doc_id, label, text). A share of the rows, by hash, is kept from training and sets the cuts."""
    rows = sorted(rows)
    texts, y = [words_of(t) for _, _, t in rows], np.array([v for _, v, _ in rows], dtype=int)
    aside = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % 1000 < 1000 * calibration for i, _, _ in rows], dtype=bool)
    model = train(*numbers([t for t, a in zip(texts, aside, strict=True) if not a]), y[~aside])
    if len(rows):
        kept = np.flatnonzero(aside) if len(set(y[aside].tolist())) > 1 else np.arange(len(rows))
        values = logits(model, [texts[i] for i in kept])
        languages = np.array([language(Counter(texts[i])) for i in kept])
        model.cuts = calibrate(values, y[kept], languages)
    return model


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, limit: int = 3_000, max_chars: int = 60_000, at: float = 0.5
) -> DataFrame:
    """Score the whole text of every document for toxicity.

    Returns doc_id, held_out, score (0..1), predicted (1 if score >= at), language (as the text seems). The model
    learns from at most `limit` labelled documents of each label, as said in labelled_sample. A text at its language's
    cut has score 0.5. Null and empty texts, and texts without words, have pooled responses of 0. Without labels every
    score is 0.5 less an epsilon, that is not toxic. Repeated rows are scored alike; an empty table gives an empty table.
    """
    sample = labelled_sample(docs, labels, "toxic", limit, max_chars)
    model = fit([(r[0], r[1], r[2]) for r in sample.collect()])

    def run(batches):
        words = Words(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            found, spoken = [], []
            for _, some in chunks(texts, 2_000_000):
                split = [words_of(t) for t in some]
                found.append(logits(model, split, words))
                spoken += [language(Counter(ws)) for ws in split]
            values = np.concatenate(found) if found else np.zeros(0)
            shifted = values - np.array(model.cuts)[spoken] - 1e-9 if len(values) else values
            score = 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))
            named = pa.array([LANGUAGES[k] for k in spoken], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), named], names=["doc_id", "score", "language"])

    fields = T._parse_datatype_string("score double, language string").fields
    scored = docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "language")
