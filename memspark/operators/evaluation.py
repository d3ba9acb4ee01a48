"""Retrieval metrics, run comparison, gates, and packs under a budget."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import fusion


def track(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """A row a case of gold(case_id, id): hit, first rank, reciprocal rank, recall and nDCG of ranked(case_id, id, rank)
    within k. The ideal of nDCG has as many places as there are gold or ranked rows, whichever are fewer; cases with
    nothing found score 0."""
    top = ranked.where(F.col("rank") <= k)
    met = top.join(gold.withColumn("gold", F.lit(True)), ["case_id", "id"], "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if("gold").alias("found"),
        F.min(F.when(F.col("gold"), F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("gold"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    sizes = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("gold"))
    j = sizes.join(met, "case_id", "left")
    places = F.least("gold", F.coalesce("shown", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1).cast("long"), places)), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    found = F.coalesce("found", F.lit(0))
    return j.select(
        "case_id", (found > 0).alias("hit"), "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        (found / F.col("gold")).alias("recall"), F.when(places > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def summary(tracked: DataFrame, *by: str) -> DataFrame:
    """Hit rate, MRR, recall and nDCG, 0 without cases."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return tracked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), mean(F.col("hit").cast("int")).alias("hit_rate"), mean("rr").alias("mrr"), mean("recall").alias("recall"), mean("ndcg").alias("ndcg")
    )


def percentile_of(values: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """Nearest-rank percentile: the value at index round((n - 1) p), halves to even."""
    placed = fusion.placed(values.select(*by, value), *by, value, column="__at")
    sizes = placed.groupBy(*by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    wanted = sizes.select(*by, (F.col("__first") + F.bround((F.col("__n") - 1) * F.lit(p)).cast("long")).alias("__at"))
    return placed.join(wanted, [*by, "__at"]).select(*by, F.col(value).alias("value"))


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(case_id, change, delta) of two runs(case_id, status, metric): added, removed, changed or same."""
    x = a.select("case_id", F.col("status").alias("sa"), F.col("metric").alias("ma"))
    y = b.select("case_id", F.col("status").alias("sb"), F.col("metric").alias("mb"))
    change = F.when(F.col("sa").isNull(), "added").when(F.col("sb").isNull(), "removed").when(F.col("sa") != F.col("sb"), "changed").otherwise("same")
    return x.join(y, "case_id", "full_outer").select("case_id", change.alias("change"), (F.col("mb") - F.col("ma")).alias("delta"))


def gate(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(metric, rule, bound, actual, passed) of rules (metric, equals | minimum | maximum, bound); a metric that is
    missing fails."""
    spark = metrics.sparkSession
    table = F.broadcast(spark.createDataFrame(rules, "metric string, rule string, bound double"))
    j = table.join(metrics.withColumnRenamed("value", "actual"), "metric", "left")
    ok = F.when(F.col("rule") == "equals", F.col("actual") == F.col("bound")).when(F.col("rule") == "minimum", F.col("actual") >= F.col("bound")).otherwise(F.col("actual") <= F.col("bound"))
    return j.select("metric", "rule", "bound", "actual", F.coalesce(ok, F.lit(False)).alias("passed"))


def greedy_fill(costs: list[int], budget: int, used: int = 0) -> list[bool]:
    """Take each item that still fits; one that doesn't is skipped, and the next is tried."""
    out = []
    for cost in costs:
        fits = used + cost <= budget
        used += cost if fits else 0
        out.append(fits)
    return out


def context_pack(items: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """items(pack, pos, id, cost) with `included`, filling each pack's budget in order of pos. A pack is one reader's
    candidate list, cut by its retriever, so a group is bounded."""

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        return table.append_column("included", pa.array(greedy_fill(table.column("cost").to_pylist(), budget, header), pa.bool_()))

    return items.groupBy("pack").applyInArrow(fill, items.select("*").withColumn("included", F.lit(True)).schema)


def character_context(items: DataFrame, budget: int) -> DataFrame:
    """Lines `- text` of each pack until its characters run out, the last one cut: items(pack, pos, text)."""
    w = Window.partitionBy("pack").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.lit("- "), "text")
    lined = items.withColumn("line", line).withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    kept = lined.where(F.col("before") < budget)
    return kept.select("pack", "pos", F.expr(f"left(line, cast({budget} - before as int))").alias("line"))


def pack_score(packs: DataFrame) -> DataFrame:
    """Score of context packs(pack, records, included, source_cost, cost, budget): traceability, fit and compression."""
    coverage = F.when(F.col("records") == 0, 1.0).otherwise(F.col("included") / F.col("records"))
    fit = F.when((F.col("budget") <= 0) | (F.col("cost") <= F.col("budget")), 1.0).otherwise(F.col("budget") / F.greatest("cost", F.lit(1)))
    compression = F.least(F.lit(1.0), F.when(F.col("source_cost") > 0, F.col("source_cost") / F.greatest("cost", F.lit(1))).otherwise(1.0))
    total = 0.40 * coverage + 0.25 * fit + 0.20 * compression + 0.15 * coverage
    return packs.select("pack", F.round(coverage, 6).alias("coverage"), F.round(fit, 6).alias("fit"), F.round(compression, 6).alias("compression"), F.round(total, 6).alias("overall"))


def pattern_scores(patterns: DataFrame, terms: list[str], operation: str | None, max_age_days: int, min_trust: float) -> DataFrame:
    """Rank patterns(pattern_id, terms, operation, trust, age_days, successes) for a task."""
    asked = F.array(*[F.lit(t) for t in sorted(set(terms))])
    union = F.size(F.array_union(asked, "terms"))
    similarity = F.when(union > 0, F.size(F.array_intersect(asked, "terms")) / union).otherwise(0.0)
    match = F.lit(False) if operation is None else F.coalesce(F.lower("operation") == operation.lower(), F.lit(False))
    score = similarity * 0.55 + match.cast("int") * 0.15 + F.col("trust") * 0.20 + F.greatest(F.lit(0.0), 1 - F.col("age_days") / max_age_days) * 0.05
    score = score + F.least(F.lit(0.05), F.log1p(F.col("successes").cast("double")) * 0.02)
    kept = patterns.where((F.col("age_days") <= max_age_days) & (F.col("trust") >= min_trust) & ((similarity > 0) | match))
    return kept.select("pattern_id", score.alias("score"))


def chained(events: DataFrame) -> DataFrame:
    """Whether each event of a ledger(run, seq, payload, previous, hash) follows the one before and hashes rightly."""
    w = Window.partitionBy("run").orderBy("seq")
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    ok = (F.col("previous") == before) & (F.col("hash") == F.sha2(F.concat_ws("|", "previous", "payload"), 256))
    return events.withColumn("ok", ok)


@pandas_udf(StringType())
def shown_double(values: pd.Series) -> pd.Series:
    """A double with 17 significant digits and no trailing zeros."""
    return values.map(lambda x: f"{x:.17g}")


def with_lines(candidates: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """candidates(rank, id, score, and a column a channel) with the line each adds to a fingerprint; a null channel is none."""
    sources = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), shown_double(F.col(c).cast("double"))) for c in sorted(channels)])
    return candidates.withColumn("line", F.concat_ws("\t", F.col("rank").cast("string"), "id", shown_double(F.col("score").cast("double")), sources))


def fingerprint() -> Column:
    """SHA-256 of the lines (`with_lines`) of candidates, in order of rank: an aggregate over a bounded list."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"])
    return F.sha2(F.array_join(lines, "\n"), 256)


CODECS = {"zlib": (lambda b: zlib.compress(b, 9), zlib.decompress), "bz2": (bz2.compress, bz2.decompress), "lzma": (lzma.compress, lzma.decompress)}


def lossless(texts: DataFrame) -> DataFrame:
    """texts(id, content) as (id, codec, packed, sha256): the codec that packs each text shortest, ties by name."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("content").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                _, codec, packed = min((len(p := pack(raw)), name, p) for name, (pack, _) in CODECS.items())
                rows.append((codec, packed, hashlib.sha256(raw).hexdigest()))
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *arrays], names=["id", "codec", "packed", "sha256"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "content").mapInArrow(run, f"id {kind}, codec string, packed binary, sha256 string")


def restored(packed: DataFrame) -> DataFrame:
    """(id, content, intact) from what `lossless` returns."""

    def run(batches):
        for b in batches:
            raws = [CODECS[c][1](p) for c, p in zip(b.column("codec").to_pylist(), b.column("packed").to_pylist(), strict=True)]
            ok = [hashlib.sha256(r).hexdigest() == h for r, h in zip(raws, b.column("sha256").to_pylist(), strict=True)]
            texts = pa.array([r.decode("utf-8", "surrogatepass") for r in raws], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), texts, pa.array(ok, pa.bool_())], names=["id", "content", "intact"])

    kind = packed.schema["id"].dataType.simpleString()
    return packed.mapInArrow(run, f"id {kind}, content string, intact boolean")


def bundles(cases: DataFrame) -> DataFrame:
    """(run, cases, bundle) of cases(run, case): SHA-256 over the sorted hashes of a run's canonical cases."""
    hashes = cases.select("run", F.sha2("case", 256).alias("h"))
    return hashes.groupBy("run").agg(F.count(F.lit(1)).alias("cases"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("bundle"))


def narratives(packs: DataFrame, states: DataFrame, claims: DataFrame, limit: int, lens: str = "general") -> DataFrame:
    """(pack, text) of packs(pack): the fields of its first state(pack, pos, fields), else its first `limit` claims(pack, pos,
    subject, predicate, object), else that there is nothing. Claims are cut by rank before they are gathered."""
    first = states.groupBy("pack").agg(F.min_by("fields", "pos").alias("f"))
    shown = F.array_join(F.transform(F.map_entries("f"), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    rank = F.row_number().over(Window.partitionBy("pack").orderBy("pos"))
    cut = claims.withColumn("rank", rank).where(F.col("rank") <= limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "subject", "predicate", "object").alias("said")))), lambda s: s["said"])
    told = cut.groupBy("pack").agg(F.array_join(lines, "; ").alias("told"))
    j = packs.join(first.select("pack", shown.alias("state")), "pack", "left").join(told, "pack", "left")
    return j.select("pack", F.concat(F.lit(f"[{lens}] "), F.coalesce("state", "told", F.lit("No narrative context available."))).alias("text"))
