"""Rank fusion over hits(leg, id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.scratch import materialize

K = 60
#: Weights of the four channels.
CHANNELS = {"lexical": 0.40, "semantic": 0.35, "graph": 0.15, "temporal": 0.10}


def weighted(channels: DataFrame, weights: dict[str, float] = CHANNELS) -> DataFrame:
    """Weighted sum of channel columns; rows at 0 or below go."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return channels.withColumn("score", total).where("score > 0")


def deduplicated(hits: DataFrame) -> DataFrame:
    """The best hit of each (leg, id)."""
    return hits.groupBy("leg", "id").agg(F.max("score").alias("score"))


def ranked(hits: DataFrame) -> DataFrame:
    """Rank within a leg, by score, ties by id."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("score"), "id")))


def ranked_whole(hits: DataFrame) -> DataFrame:
    """`ranked` for legs of any length: places in one range-partitioned order, less where each leg begins."""
    rows = placed(hits.withColumn("__down", -F.col("score")), "leg", "__down", "id", column="__place")
    first = rows.groupBy("leg").agg(F.min("__place").alias("__first"))  # a row a leg
    return rows.join(F.broadcast(first), "leg").withColumn("rank", F.col("__place") - F.col("__first") + 1).drop("__down", "__place", "__first")


def reciprocal(hits: DataFrame, weights: dict[str, float] | None = None, k: int = K, positive: bool = False, whole: bool = False) -> DataFrame:
    """Sum over legs of weight / (k + rank); a leg of weight 0 keeps its records with nothing added.

    Legs are lists a retriever returned, cut at its limit, so a leg is a bounded window; `whole` is for legs that are not.
    """
    rows = deduplicated(hits.where("score > 0") if positive else hits)
    rows = ranked_whole(rows) if whole else ranked(rows)
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.create_map(*[x for leg, w in weights.items() for x in (F.lit(leg), F.lit(float(w)))])[F.col("leg")], F.lit(1.0))
    return rows.groupBy("id").agg(
        F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("leg")), ",").alias("legs")
    )


def split(candidates: DataFrame, budget: int, trace_limit: int) -> DataFrame:
    """selected up to the budget and rejected up to the trace limit, by rank."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    top = candidates.orderBy(F.desc("score"), "id").limit(max(budget, min(trace_limit, 128)))
    return top.withColumn("rank", rank).withColumn("decision", F.when(F.col("rank") <= budget, "selected").otherwise("rejected"))


def splice(primary: DataFrame, secondary: DataFrame, limit: int, reserve: int) -> DataFrame:
    """Fill the last `reserve` of `limit` places with rows of secondary that primary doesn't have.

    Both are (id, score); their heads, which are all that matters, are written once. Novel rows follow the head with scores just below its least; unused places go to primary.
    """
    order = Window.orderBy(F.desc("score"), "id")
    cut = lambda df, n, name: materialize(df.select("id", "score").orderBy(F.desc("score"), "id").limit(n), name)
    p = cut(primary, limit, "primary").withColumn("rn", F.row_number().over(order))
    novel = cut(secondary, limit + reserve, "secondary").join(p.where(F.col("rn") <= limit - reserve), "id", "left_anti").orderBy(F.desc("score"), "id").limit(reserve)
    novel = novel.withColumn("i", F.row_number().over(order))
    used = novel.agg(F.count(F.lit(1)).alias("used"))
    head = p.join(F.broadcast(used)).where(F.col("rn") <= limit - F.col("used"))
    low = head.agg(F.min("score").alias("low"))
    tail = novel.join(F.broadcast(low)).select("id", (F.coalesce("low", F.lit(0.0)) - F.col("i") * 1e-4).alias("score"), F.lit("secondary").alias("origin"))
    kept = head.join(tail.select("id"), "id", "left_anti").select("id", "score", F.lit("primary").alias("origin"))
    return kept.unionByName(tail)


def placed(rows: DataFrame, *order, column: str = "rank") -> DataFrame:
    """rows with their place, from 1, in a total order. Rows are dealt out by range and numbered in each part; only the
    counts of the parts, a row a part, are summed up, so no task holds them all."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "placed")  # ranges are sampled, so they must be drawn once
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__nth", nth).join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def date_diverse(rows: DataFrame, limit: int) -> DataFrame:
    """(id, day, rank): the first row of each day in rank order, then the others."""
    heads = rows.groupBy("day").agg(F.min("rank").alias("first"))
    return rows.join(heads, "day").orderBy((F.col("rank") > F.col("first")).cast("int"), "rank").limit(limit).drop("first")
