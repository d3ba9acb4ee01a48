"""Lexical scoring. Each function returns a row a record that scores, with `id` and `score`."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as tx

#: Weights of the structured leg.
STRUCTURED = {"id": 1.20, "kind": 0.80, "ns": 0.40, "scope": 0.40, "predicate": 0.75, "subject": 0.70, "object": 0.65}
PHRASE, PART = 0.55, 0.22


def top(scored: DataFrame, k: int, id_column: str = "id", score: str = "score", digits: int | None = 9) -> DataFrame:
    """The k best by score, ties by id: a bounded heap in each task, then one merge."""
    shown = scored if digits is None else scored.withColumn(score, F.round(score, digits))
    return shown.orderBy(F.desc(score), id_column).limit(k)


def overlap(records: DataFrame, query: str, content: Column) -> DataFrame:
    return records.withColumn("score", tx.overlap(query, content)).where("score > 0")


def shared_tokens(records: DataFrame, query: str, content: Column) -> DataFrame:
    """Number of distinct tokens shared with the query, if any."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(tx.query_tokens(query)))])
    return records.withColumn("score", F.size(F.array_intersect(wanted, tx.tokens(content)))).where("score > 0")


def _only(words: Column, term: str) -> Column:
    return F.filter(words, lambda w: w == term)


def matched_terms(query: str, words: Column) -> Column:
    """struct(tf of each distinct query token, length): what BM25 needs of a text's tokens, without exploding them."""
    terms = sorted(set(tx.query_tokens(query)))
    counts = [F.size(_only(words, t)).alias(f"t{i}") for i, t in enumerate(terms)]
    return F.struct(F.size(words).alias("n"), *counts)


def bm25(records: DataFrame, query: str, content: Column, candidates: Column | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of each record. Statistics count every record that has a token, candidates or not; a term the query
    repeats counts as often; only scores above 0 stay.

    The texts are reduced to the query's term counts in one scan, so nothing of the size of the corpus is shuffled:
    the statistics are one row.
    """
    repeats = Counter(tx.query_tokens(query))
    terms = sorted(repeats)
    # The tokens are a projection of their own, so that they are made once for all the terms.
    counted = records.withColumn("__w", tx.tokens(content)).withColumn("__m", matched_terms(query, F.col("__w"))).drop("__w")
    stats = counted.where("__m.n > 0").agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.avg("__m.n").alias("__avg"),
        *[F.count_if(F.col(f"__m.t{i}") > 0).alias(f"__df{i}") for i in range(len(terms))],
    )
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        tf, df = F.col(f"__m.t{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__m.n") / F.col("__avg")))
        score = score + F.when(tf > 0, part * float(repeats[term])).otherwise(0.0)
    kept = counted if candidates is None else counted.where(candidates)
    joined = kept.join(F.broadcast(stats))  # one row
    return joined.withColumn("score", score).where("score > 0").drop("__m", *stats.columns)


def bag_cosine(records: DataFrame, query: str, content: Column) -> DataFrame:
    """Cosine of token counts."""
    wanted = Counter(tx.query_tokens(query))
    size = sum(c * c for c in wanted.values()) ** 0.5
    records, words = records.withColumn("__w", tx.tokens(content)), F.col("__w")
    terms = sorted(wanted)
    product = sum((F.size(_only(words, t)) * float(wanted[t]) for t in terms), F.lit(0.0))
    ordered = F.array_sort(words)
    # Squares of counts: in the sorted tokens a token's count grows with each repeat, and a square is a sum of odd numbers.
    squares = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("s")),
        lambda a, w: F.struct(
            w.alias("w"),
            F.when(a["w"] == w, a["c"] + 1).otherwise(F.lit(1).cast("long")).alias("c"),
            (a["s"] + 2 * F.when(a["w"] == w, a["c"] + 1).otherwise(F.lit(1).cast("long")) - 1).alias("s"),
        ),
        lambda a: a["s"],
    )
    return records.withColumn("__p", product).where("__p > 0").withColumn("score", F.col("__p") / (F.sqrt(squares) * size)).drop("__p", "__w")


def substring_leg(records: DataFrame, query: str, content: Column) -> DataFrame:
    """0.55 for the whole query as a substring and 0.22 for each distinct token as one; also `hits`, tokens found."""
    parts = [tx.contains(content, t) for t in sorted(set(tx.query_tokens(query)))]
    hits = sum((p.cast("int") for p in parts), F.lit(0))
    phrase = tx.contains(content, " ".join(query.lower().split())).cast("int")
    return records.withColumn("hits", hits).withColumn("score", phrase * PHRASE + F.col("hits") * PART)


def structured_score(wanted: dict[str, list[str] | str], has_time: Column, conf: Column) -> Column:
    """Points for each filter that a record matches, a tenth for a time, and 0.15 of the confidence."""
    score = F.lit(0.0)
    for name, value in wanted.items():
        column = F.col(name)
        if isinstance(value, list):
            hit = column.isin(value)
        elif name == "object":
            hit = F.contains(F.lower(column), F.lit(value.lower()))
        elif name in ("predicate", "subject"):
            hit = F.lower(column) == value.lower()
        else:
            hit = column == value
        score = score + F.when(hit, STRUCTURED[name]).otherwise(0.0)
    return score + has_time.cast("int") * 0.10 + F.least(conf, F.lit(1.0)) * 0.15


def gate(structured: Column, boundary: Column, hits: Column, has_query: bool, explicit_boundary: bool) -> Column:
    """Whether a record may pass the leg: a token hit, 1.0 by structure, or both boundary filters written in the query."""
    if not has_query:
        return F.lit(True)
    passes = (hits > 0) | (structured >= 1.0)
    return passes | (boundary >= 0.8) if explicit_boundary else passes


def leg_text(records: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, search_text) of records(id, payload): the greatest of its vectors' texts(id, source_text), else its payload,
    lower-cased."""
    own = texts.groupBy("id").agg(F.max("source_text").alias("t"))
    return records.join(own, "id", "left").select("id", F.lower(F.coalesce("t", "payload")).alias("search_text"))


def current_page(scored: DataFrame, limit: int, history: bool = False) -> DataFrame:
    """The best rows of scored(id, status, score) that are current: the page is full if enough are, since what is not
    current goes before the cut. With `history` all count."""
    from memspark.plans.query import current

    return top(scored if history else scored.where(current(F.col("status"))), limit)


def hydrated(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """hits(id, score), which a limit has cut, with the ids of their evidence(id, evidence), joined by commas. Evidence of
    other records is left in its scan, and a hit's is what one record names."""
    own = evidence.join(F.broadcast(hits.select("id")), "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))
    return hits.join(own, "id", "left").select("id", "score", F.coalesce("evidence", F.lit("")).alias("evidence"))
