"""Deletes, supersession, eligibility and ledgers of decisions: each a join against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete(records: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of records(id) and of edges(src, dst) without ids(id)."""
    gone = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return records.join(ids, "id", "left_anti"), gone.select(*edges.columns)


def soft_delete(records: DataFrame, targets: DataFrame) -> DataFrame:
    """records with status deleted_soft for targets(id, ns, scope, generation). A target that is missing, lies beyond
    the boundary or has another generation than planned refuses the whole; deleting twice changes nothing."""
    r = records.select("id", F.col("ns").alias("n"), F.col("scope").alias("s"), F.col("generation").alias("g"))
    bad = targets.join(r, "id", "left").where(F.col("n").isNull() | (F.col("n") != F.col("ns")) | (F.col("s") != F.col("scope")) | (F.col("g") != F.col("generation")))
    if not bad.isEmpty():
        raise ValueError("a target is missing, beyond the boundary, or stale")
    hit = targets.select("id", F.lit(True).alias("__hit"))
    return records.join(hit, "id", "left").withColumn("status", F.when(F.col("__hit"), "deleted_soft").otherwise(F.col("status"))).drop("__hit")


def superseded_generations(records: DataFrame, active: DataFrame, protected: DataFrame) -> DataFrame:
    """records(id, document, source_ref) of sources in active(source_ref, document) that are of another document and
    not protected(id): those to mark as superseded."""
    a = active.select("source_ref", F.col("document").alias("__a"))
    return records.join(a, "source_ref").where(F.col("document") != F.col("__a")).join(protected, "id", "left_anti").drop("__a")


def pending(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records whose current content is not in the index: what an indexer still has to write, however often it ran."""
    return records.join(index.select("id", "source_hash"), ["id", "source_hash"], "left_anti")


def eligibility(ns: str, scope: str, moment: Column, kinds: tuple[str, ...], derived: tuple[str, ...]) -> Column:
    """The first reason why a candidate may not enter a context, null for one that may."""
    return (
        F.when((F.col("ns") != ns) | (F.col("scope") != scope), "boundary")
        .when(~F.col("kind").isin(*kinds), "kind")
        .when(~F.col("state").isin("supported", "verified"), "trust")
        .when(~F.col("current"), "not_current")
        .when((F.col("occurred_at") > moment) | F.coalesce(F.col("valid_until") <= moment, F.lit(False)), "time")
        .when(F.col("kind").isin(*derived) & F.col("product_id").isNull(), "derived_without_product")
    )


def with_latest_decision(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals(proposal_id, ...) with the status of their latest decision, `pending` without any."""
    last = decisions.groupBy("proposal_id").agg(F.max(F.struct("decision_id", "status"))["status"].alias("status"))
    return proposals.join(last, "proposal_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def transitions(events: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """events(run, seq, status) with `ok`: whether each status may follow the one before; the first must be open."""
    w = Window.partitionBy("run").orderBy("seq")
    before = F.lag("status").over(w)
    table = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return events.withColumn("ok", F.when(before.isNull(), F.col("status") == "open").otherwise(F.array_contains(table, F.concat(before, F.lit(">"), F.col("status")))))


def quota_pack(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """rows(pack, lane, rank) within their lane's quota."""
    limit = F.create_map(*[x for lane, n in quotas.items() for x in (F.lit(lane), F.lit(n))])[F.col("lane")]
    nth = F.row_number().over(Window.partitionBy("pack", "lane").orderBy("rank"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= F.coalesce(limit, F.lit(0)))


def ratchet(candidate: DataFrame, baseline: DataFrame, margin: float, tolerance: float) -> DataFrame:
    """One row: whether candidate(category, metric) improves on baseline by more than the margin on average and drops
    by more than the tolerance in no category; a category that is missing or not finite fails."""
    j = baseline.withColumnRenamed("metric", "was").join(candidate, "category", "left")
    sound = F.coalesce(~F.isnan("metric") & (F.col("metric") >= F.col("was") - tolerance), F.lit(False))
    return j.agg(F.round(F.avg(F.col("metric") - F.col("was")), 6).alias("gain"), F.coalesce(F.bool_and(sound), F.lit(False)).alias("sound")).select("gain", "sound", (F.col("sound") & (F.col("gain") > margin)).alias("accepted"))
