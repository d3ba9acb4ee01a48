"""Quality rules as weak supervision: each rule votes or abstains, expectation-maximisation estimates how each rule
votes on good and on bad documents, and the posterior probability of "good" replaces all-must-pass filtering."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered, sliced

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOL_WORD = re.compile(rb"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")
ENDS = (".", "!", "?", ":", ";", '"', "\u201d", "\u00bb", "\u2026", "\u3002")
STOPS = (b".", b"!", b"?", "\u2026".encode(), "\u3002".encode())

#: The rules, by the way of going bad that they look for; each way is looked for by several.
KINDS = {
    "clutter": ("symbols", "symbol_words", "line_ends", "stops"),
    "repetition": ("repeats", "dup_lines", "variety"),
    "shape": ("case", "exclaim", "word_length", "letters"),
}
RULES = tuple(rule for rules in KINDS.values() for rule in rules)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_trigram_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    code = {w: i for i, w in enumerate(set(words))}
    size = len(code)
    if size == n:
        return 0
    ids = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=n)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # the cube would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The base counts of a text and the votes of RULES: 1 good, -1 bad, 0 abstains. A null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at [\x20\x09-\x0D]
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_trigram_words(words)
    base = (n, chars, symbols, dup_lines, repeats)
    if n == 0:
        return base, (-1,) * len(RULES)
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    exclaims = raw.count(b"!")

    def vote(value: float, good: float, bad: float) -> int:
        """Small is good."""
        return 1 if value <= good else -1 if value >= bad else 0

    mean = chars / n
    kinds = len(set(words)) / min(n, 200)  # long texts repeat words, and that isn't held against them
    ended = sum(line.rstrip(SPACE).endswith(ENDS) for line in lines) / len(lines)
    stops = sum(w.endswith(STOPS) for w in words) / n
    return base, (
        vote(symbols / n, 0.01, 0.1),
        vote(len(SYMBOL_WORD.findall(raw)) / n if symbols else 0.0, 0.02, 0.2),
        1 if ended >= 0.8 else -1 if ended < 0.5 else 0,
        1 if 0.02 <= stops <= 0.25 else -1 if stops < 0.005 or stops > 0.6 else 0,
        vote(repeats / n, 0.25, 0.4),
        vote(dup_lines / len(lines), 0.35, 0.6) if len(lines) > 1 else 0,
        1 if kinds >= 0.5 else -1 if kinds < 0.3 else 0,
        vote(upper / max(1, upper + lower), 0.15, 0.4),
        vote(exclaims / n, 0.02, 0.15),
        1 if 3 <= mean <= 10 else -1 if mean < 2 or mean > 16 else 0,
        vote(digits / max(1, chars), 0.2, 0.5),
    )


def prior_votes() -> np.ndarray:
    """P(vote -1, 0, 1 | class) by [class, rule, vote] before any document is seen; "good" is the first class."""
    prior = np.empty((1 + len(KINDS), len(RULES), 3))
    prior[0], prior[1:] = (0.01, 0.12, 0.87), (0.02, 0.13, 0.85)
    for k, rules in enumerate(KINDS.values()):
        for rule in rules:
            prior[1 + k, RULES.index(rule)] = (0.6, 0.15, 0.25)
    return prior


def fit_votes(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, strength: float = 50.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and how many documents have each.

    The latent classes are "good" and a bad class for each of KINDS: documents go bad in ways that have little in
    common, and one bad class would call the rarer ways good. Given the class, rules vote independently. Returns the
    posterior probability of "good" by pattern, the classes' shares (good first), and P(vote | class) as [class, rule,
    vote -1/0/1]: what EM finds a rule's votes to be worth, a false alarm being [0, rule, 0].

    No rule decides alone by decree: each of a way's rules is believed to miss some of its documents and to speak up
    against some good ones, as far as the data don't say otherwise. The prior beliefs weigh as `strength` documents of
    each class, so that an empty or tiny table gives a defined answer.
    """
    prior, n_bad = prior_votes(), len(KINDS)
    share_prior = np.array([0.8, *[0.2 / n_bad] * n_bad])
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    conditional, share = prior, share_prior
    good = np.full(len(patterns), -1.0)
    for _ in range(rounds):
        logs = np.log(share)[:, None] + np.einsum("prv,crv->cp", onehot, np.log(conditional))
        each = np.exp(logs - logs.max(axis=0, initial=-np.inf)) if len(patterns) else np.empty((1 + n_bad, 0))
        each = each / each.sum(axis=0)
        done = np.abs(each[0] - good).max(initial=0) < 1e-9
        good = each[0]
        if done:
            break
        weights = each * counts
        seen = np.einsum("cp,prv->crv", weights, onehot) + strength * prior
        conditional = seen / seen.sum(axis=2, keepdims=True)
        totals = weights.sum(axis=1) + strength * share_prior
        share = totals / totals.sum()
    return good, share, conditional


def measured(source: DataFrame, text: str, names: list[str]) -> DataFrame:
    """The columns `names` of source with the base counts and the votes of its column `text`, written once."""
    added = [*[T.StructField(c, T.LongType()) for c in BASE], T.StructField("votes", T.StringType())]
    schema = T.StructType([*[source.schema[c] for c in names], *added])

    def run(batches):
        for batch in sliced(batches, text):
            found = [measure(x) for x in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in names]
            columns += [pa.array([x[0][i] for x in found], pa.int64()) for i in range(len(BASE))]
            columns.append(pa.array(["".join("012"[v + 1] for v in x[1]) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in added]])

    return materialize(source.mapInArrow(run, schema), "votes")


def judged(found: DataFrame, threshold: float) -> DataFrame:
    """What `measured` returns with base_failed, kept and posterior.

    Votes are counted over all documents; only the counts by vote pattern, at most 3 ** len(RULES) rows however many
    documents there are, come to the driver, and as many posteriors are broadcast.
    """
    rows = found.groupBy("votes").count().orderBy("votes").limit(3 ** len(RULES)).collect()
    patterns = np.array([[int(c) - 1 for c in r[0]] for r in rows], dtype=int).reshape(len(rows), len(RULES))
    good, _, _ = fit_votes(patterns, np.array([r[1] for r in rows], dtype=float))
    pairs = [(r[0], float(p)) for r, p in zip(rows, good, strict=True)]
    posteriors = found.sparkSession.createDataFrame(pairs, "votes string, posterior double")
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * repeats > 50 * n)
    known = found.join(F.broadcast(posteriors), "votes")
    return known.select(*found.columns, failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior")


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Judge every document by its whole text.

    Returns doc_id, the base counts (long), base_failed, kept, posterior (double) and votes (string, a digit a rule:
    0 against, 1 abstains, 2 for). One row out for each row in, repeated rows and null ids included; a null or empty
    text has no words and fails. An empty table gives an empty table.
    """
    found = judged(measured(docs.select("doc_id", "text"), "text", ["doc_id"]), threshold)
    return found.select("doc_id", *BASE, "base_failed", "kept", "posterior", "votes")


def kept(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows that `judge` rejects. Rows are judged one by one, so repeated rows and null
    ids go or stay by their own text; null, empty and wordless texts go. An empty table gives an empty table."""
    source, names = numbered(docs)
    found = judged(measured(source, names["text"], list(names.values())), threshold)
    return found.where("kept").select(*names.values()).toDF(*docs.columns)
