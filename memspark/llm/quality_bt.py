"""Quality classifier: a Bradley-Terry model learns a score from pairs of which the first document is preferred, by
logistic loss on the difference of their features; a quantile of all documents' scores is the threshold."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, materialize
from .weak_rules import DIGITS, LOWER, SPACE, UPPER, repeated_trigram_words

FEATURES = (
    "symbols", "pipes", "exclaims", "upper", "digits", "repeats", "adjacent", "dup_lines", "word_length", "variety",
    "log_words", "log_line_words", "short_words", "long_words", "bare_marks", "commas", "stops", "empty",
)


def features(text: str | None) -> np.ndarray:
    """Measures of a whole text, each in 0..1 or so; a null text is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        out = np.zeros(len(FEATURES))
        out[-1] = 1
        return out
    chars = len(text) - sum(map(text.count, SPACE))
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    kinds = set(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    share = lambda x: np.log1p(50 * x / n) / 4
    return np.array(
        [
            share(sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))),
            share(raw.count(b"|")),
            share(raw.count(b"!")),
            upper / max(1, upper + lower),
            digits / chars,
            repeated_trigram_words(words) / n,
            sum(map(operator.eq, words, islice(words, 1, None))) / n,
            1 - len(set(lines)) / len(lines),
            min(chars / n, 20) / 10,
            len(kinds) / min(n, 400),
            np.log1p(n) / 8,
            np.log1p(n / len(lines)) / 5,
            float((sizes <= 1).mean()),
            float((sizes >= 15).mean()),
            (raw.count(b" | ") + raw.count(b" - ")) / n,
            min(1.0, 5 * raw.count(b",") / n),
            min(1.0, 5 * raw.count(b".") / n),
            0.0,
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their squares."""
    return np.concatenate([x, x * x], axis=-1)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, penalty: float = 1e-2, seed: int = 5) -> Model:
    """Bradley-Terry: P(i over j) = sigmoid(w . (x_i - x_j)), by Newton's method on pairs (label 1, label 0)."""
    width = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(width)
    if len(good) and len(bad):
        draw = np.random.default_rng(seed)
        z = np.clip((x - mean) / scale, -8, 8)
        d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
            gradient = d.T @ p / pairs - penalty * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(width)
            step = np.linalg.solve(hessian, gradient)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
    return Model(mean, scale, w)


def threshold(utilities: np.ndarray, y: np.ndarray, levels: np.ndarray, cuts: np.ndarray) -> tuple[float, float]:
    """(level, cut): the quantile of all documents' utilities that best parts the labels, by the mean of both labels'
    accuracies; the middle one of equally good cuts."""
    good, bad = np.sort(utilities[y == 1]), np.sort(utilities[y == 0])
    if not len(good) or not len(bad) or not len(cuts):
        return 0.0, -np.inf
    kept = 1 - np.searchsorted(good, cuts, "left") / len(good)
    gone = np.searchsorted(bad, cuts, "left") / len(bad)
    value = kept + gone
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = best[len(best) // 2]
    return float(levels[k]), float(cuts[k])


def quality_scores(
    docs: DataFrame, labels: DataFrame, limit: int = 5_000, max_chars: int = 200_000, at: float = 0.3
) -> DataFrame:
    """Score the whole text of every document for quality.

    Returns doc_id, held_out, score (0..1), predicted (1 if score >= at), utility (the Bradley-Terry score) and level
    (the quantile that is the threshold). The model learns from at most `limit` labelled documents of each label, as
    said in labelled_sample, texts of over max_chars characters not among them. The candidates for the threshold are the
    quantiles 0.001 to 0.999 of the utilities of all documents, whatever share of them is bad; a document just at the threshold has score `at`, and the others' odds against it follow the model. Null and empty
    texts are scored by the feature that says so. Without labels of both kinds every utility is 0 and every document
    is predicted 1. Repeated rows are scored alike; an empty table gives an empty table.
    """
    sample = labelled_sample(docs, labels, "quality", limit, max_chars)

    def measure(batches):
        for b in batches:
            found = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.select("label", "text").mapInArrow(measure, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    x = expand(np.array([r[1] for r in rows], dtype=float).reshape(-1, len(FEATURES)))
    y = np.array([r[0] for r in rows], dtype=int)
    model = fit(x, y)

    def score(batches):
        for b in batches:
            found = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            own = np.clip((expand(found) - model.mean) / model.scale, -8, 8) @ model.weights
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own)], names=["doc_id", "utility"])

    slim = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("utility", T.DoubleType())])
    scored = materialize(slim.mapInArrow(score, schema), "utilities")
    levels = np.arange(1, 1000) / 1000
    cuts = scored.agg(F.percentile_approx("utility", levels.tolist(), 20_000)).first()[0] or []
    own = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights
    level, cut = threshold(own, y, levels[: len(cuts)], np.array(cuts))
    if not np.isfinite(cut):
        cut = -1.0
    odds = F.lit((1 - at) / at) * F.exp(-(F.col("utility") - F.lit(cut)))
    value = 1 / (1 + odds)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        value.alias("score"),
        (value >= at).cast("int").alias("predicted"),
        "utility",
        F.lit(level).alias("level"),
    )
