"""How much of a source its records, packs and codes keep, and probes made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as tx

from .lexical import top


def compression(sources: DataFrame) -> DataFrame:
    """source tokens / kept tokens of sources(id, source_tokens, kept_tokens); 1 for a source without tokens."""
    ratio = F.when(F.col("source_tokens") == 0, 1.0).otherwise(F.col("source_tokens") / F.greatest("kept_tokens", F.lit(1)))
    return sources.select("id", F.round(ratio, 6).alias("ratio"))


def reconstruction(cases: DataFrame) -> DataFrame:
    """Share of cases(required, recovered) whose required fields are all recovered; 1 without cases."""
    whole = F.size(F.array_except("required", "recovered")) == 0
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.round(F.coalesce(F.avg(whole.cast("int")), F.lit(1.0)), 6).alias("rate"))


def retention(facts: DataFrame, triples: DataFrame) -> DataFrame:
    """Mean over facts(case, subject, relation, object) of the best share of their parts that one triple of the case has."""
    t = triples.select("case", *[F.col(c).alias(f"t_{c}") for c in ("subject", "relation", "object")])
    parts = sum((F.coalesce(F.col(c) == F.col(f"t_{c}"), F.lit(False)).cast("int") for c in ("subject", "relation", "object")), F.lit(0))
    keys = ["case", "subject", "relation", "object"]
    best = facts.join(t, "case", "left").groupBy(*keys).agg(F.max(parts / 3).alias("m"))
    return best.agg(F.count(F.lit(1)).alias("facts"), F.round(F.coalesce(F.avg("m"), F.lit(1.0)), 6).alias("retention"))


def cloze(texts: DataFrame, seed: int) -> DataFrame:
    """texts(id, content) with `answer`, the most telling token (one with a digit, else a capital, else the longest,
    the first of equals), `probe`, the text with it masked, and `place`, an order that the seed shuffles."""
    words = F.filter(F.split("content", r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    rank = F.transform(
        words,
        lambda w, i: F.struct(
            F.when(w.rlike(r"\d"), 0).when(w.rlike(r"^\p{Lu}"), 1).otherwise(2).alias("r"), (-F.length(w)).alias("l"), i.alias("i"), w.alias("w")
        ),
    )
    answer = F.array_min(rank)["w"]
    masked = F.expr("replace(content, answer, '____')")
    made = texts.withColumn("answer", answer).where("answer is not null")
    return made.select("id", "answer", masked.alias("probe"), F.xxhash64("id", F.lit(seed)).alias("place"))


def readable_hits(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Best of chunks(id, content, quoted): 1 for the whole phrase, the share of the query's terms, 0.25 for quotes."""
    score = tx.contains(F.col("content"), query).cast("int") + tx.overlap(query, F.col("content"))
    scored = chunks.withColumn("score", score).where("score > 0")
    return top(scored.withColumn("score", F.col("score") + F.when(F.col("quoted"), 0.25).otherwise(0.0)), k)


def grounded(claims: DataFrame, entities: DataFrame, query: str) -> DataFrame:
    """claims(id, subject) with score 1 if the label of their entity(id, label) shares a token with the query, else 0."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(tx.query_tokens(query)))])
    hit = entities.select(F.col("id").alias("subject"), F.arrays_overlap(tx.tokens(F.col("label")), wanted).alias("hit"))
    return claims.join(hit, "subject", "left").select("id", F.when(F.col("hit"), 1.0).otherwise(0.0).alias("score"))


def aliases(ids: DataFrame, least: int = 2, tokens: int = 3) -> DataFrame:
    """(segment, n, saved): segments of ids(id) that recur and are long, where writing an alias instead saves tokens."""
    parts = ids.select(F.explode(F.split("id", ":")).alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    cost = tx.token_estimate(F.col("segment"))
    saved = F.col("n") * (cost - 1) - (cost + 1)
    return parts.where((F.col("n") >= least) & (cost >= tokens)).select("segment", "n", saved.alias("saved")).where("saved > 0")


def spliced(rows: DataFrame, facts: DataFrame, limit: int, every: int = 4) -> DataFrame:
    """rows(q, id, rank) with at most limit / 5 of facts(q, id, rank) spread in: the k-th fact comes after 4 k rows."""
    r = rows.withColumn("at", F.col("rank").cast("double"))
    f = facts.where(F.col("rank") <= limit // 5).withColumn("at", F.col("rank") * every + 0.5)
    both = r.withColumn("origin", F.lit("raw")).unionByName(f.withColumn("origin", F.lit("fact")))
    place = F.row_number().over(Window.partitionBy("q").orderBy("at", "id"))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("q", "id", "origin", "place")


def shared_words(a: Column, b: Column) -> Column:
    """Jaccard similarity of the tokens of two texts; 0 without any."""
    x, y = F.array_distinct(tx.tokens(a)), F.array_distinct(tx.tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def temporal_retention(cases: DataFrame, facts: DataFrame, claims: DataFrame, timed: DataFrame) -> DataFrame:
    """(case_id, retention) of cases(case_id): the share of its facts(case_id, fact, tokens) that are recovered, by a record
    with a time in timed(case_id), or by a claim of claims(case_id, tokens) that has all tokens. A fact without tokens is
    never recovered; a case without facts has lost nothing."""
    said = claims.select("case_id", F.col("tokens").alias("has"))
    j = facts.join(said, "case_id", "left").groupBy("case_id", "fact").agg(
        F.bool_or(F.coalesce(F.size(F.array_except("tokens", "has")) == 0, F.lit(False))).alias("said"), (F.max(F.size("tokens")) > 0).alias("any")
    )
    known = timed.select("case_id", F.lit(True).alias("timed")).distinct()
    kept = F.col("any") & (F.col("said") | F.coalesce("timed", F.lit(False)))
    shares = j.join(known, "case_id", "left").groupBy("case_id").agg(F.avg(kept.cast("double")).alias("share"))
    return cases.join(shares, "case_id", "left").select("case_id", F.coalesce("share", F.lit(1.0)).alias("retention"))


def provenance_retention(cases: DataFrame, claims: DataFrame, spans: DataFrame, raws: DataFrame) -> DataFrame:
    """(case_id, retention) of cases(case_id): the share of its claims(case_id, claim, span), a row a span named, of which
    some span(span, raw_id) is of a raw record that is there; 1 without claims."""
    sound = spans.join(raws.select("raw_id"), "raw_id", "left_semi").select("span", F.lit(True).alias("sound")).distinct()
    per = claims.join(sound, "span", "left").groupBy("case_id", "claim").agg(F.bool_or(F.coalesce("sound", F.lit(False))).alias("sound"))
    shares = per.groupBy("case_id").agg(F.avg(F.col("sound").cast("double")).alias("share"))
    return cases.join(shares, "case_id", "left").select("case_id", F.coalesce("share", F.lit(1.0)).alias("retention"))
