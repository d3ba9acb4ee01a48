"""A plan as DataFrames: one hit list a leg, fused by reciprocal rank, then gated by eligibility. Only the limits of
the legs and of the result are actions' work; nothing is collected on the way."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import temporal as tm
from memspark.functions import text as tx
from memspark.operators import fusion, graph, grounding, lexical, traversal, vectors
from memspark.scratch import materialize

from .query import Plan, apply_filters, current


@dataclass
class Stores:
    """records(id, kind, ns, scope, status, conf, content, t0, ...), vectors(id, embedding), edges(src, predicate, dst).

    With relations(id, src, predicate, dst, source), canonical ones, and entities(id, ns, scope), the graph leg walks these under
    budgets; grounding(src, predicate, dst, ns, scope) leads from claims and relations to entities. With nodes and
    node_index, as `grounding.nearest_nodes` has them, nodes near the query are a leg of their own. texts(id, source_text)
    is what records' vectors were made of, and is searched in place of their content."""

    records: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    relations: DataFrame | None = None
    entities: DataFrame | None = None
    grounding: DataFrame | None = None
    nodes: DataFrame | None = None
    node_index: DataFrame | None = None
    model: str = ""
    texts: DataFrame | None = None


def sql_leg(stores: Stores, plan: Plan) -> DataFrame:
    f = plan.filters
    rows = apply_filters(stores.records.where(current(F.col("status"))), f)
    if stores.texts is not None:
        searched = lexical.leg_text(rows.select("id", F.col("content").alias("payload")), stores.texts)
        rows = rows.drop("content").join(searched.withColumnRenamed("search_text", "content"), "id")
    wanted = {"id": list(f.ids), "kind": list(f.kinds), "ns": f.ns, "scope": f.scope, "predicate": f.predicate, "subject": f.subject, "object": f.object}
    wanted = {k: v for k, v in wanted.items() if v}
    boundary = 0.4 * (bool(f.ns) + bool(f.scope))
    base = lexical.structured_score(wanted, F.lit(False), F.lit(0.0))
    rows = lexical.substring_leg(rows, plan.residual, F.col("content")) if plan.residual else rows.withColumn("hits", F.lit(0)).withColumn("score", F.lit(0.0))
    rows = rows.withColumn("__s", base).where((F.col("__s") + F.col("score")) > 0)
    rows = rows.where(lexical.gate(F.col("__s"), F.lit(boundary), F.col("hits"), bool(plan.residual), plan.explicit_boundary))
    total = F.col("score") + lexical.structured_score(wanted, F.col("t0").isNotNull(), F.col("conf"))
    return rows.withColumn("score", total).select("id", "score")


def vector_leg(stores: Stores, plan: Plan, embedding: list[float]) -> DataFrame:
    f = plan.filters
    rows = stores.vectors
    bonus = 0.05 * sum(map(bool, (f.ids, f.kinds, f.ns, f.scope, f.predicate, f.subject, f.object)))
    eligible = apply_filters(stores.records.where(current(F.col("status"))), f).select("id")
    return vectors.nearest(rows.join(eligible, "id", "left_semi"), embedding, plan.limits["vector"], bonus=F.lit(bonus)).select("id", "score")


def graph_leg(stores: Stores, plan: Plan, seeds: DataFrame, hops: int = 1) -> DataFrame:
    scored = seeds.select("id", F.lit(0.22).alias("score"))
    return graph.leg_scores(graph.k_hop(stores.edges, seeds.select("id"), hops), stores.edges, scored).select("id", "score")


def relation_leg(stores: Stores, plan: Plan, semantic: DataFrame | None = None, nodes: DataFrame | None = None, hops: int = 3) -> DataFrame:
    """(id, score, hop, path) of the records that relations lead to from the query's entities, at most 500.

    Lexical seeds are the entities that the records with the query's words stand for, entities among them ending the
    search; semantic ones are those that the records `semantic`(id) stand for, and the `nodes`(id). Records that a filter
    refuses are walked over but not returned."""
    spark, limit = stores.records.sparkSession, plan.limits["graph"]
    live = stores.records.where(current(F.col("status")))
    score = tx.overlap(plan.residual, F.col("content"))
    words = lexical.top(apply_filters(live, plan.filters).withColumn("score", score).where("score > 0"), traversal.seed_limit(limit)).select("id")
    none = spark.createDataFrame([], "id string")
    meant = [x.select("id") for x in (semantic, nodes) if x is not None]
    meant = none if not meant else meant[0] if len(meant) == 1 else meant[0].unionByName(meant[1])
    empty = spark.createDataFrame([], "src string, predicate string, dst string, ns string, scope string")
    held = stores.grounding if stores.grounding is not None else empty
    ends = stores.relations.select(F.col("source").alias("id"), "src", "dst")

    def ground(seeds: DataFrame, most: int, direct: bool) -> DataFrame:
        return grounding.ground_seeds(seeds, stores.entities, live, held, ends, most, direct)

    room = traversal.seed_room(not meant.isEmpty(), limit)
    reached = traversal.traverse(
        spark, stores.relations, ground(words, room, True), ground(meant, traversal.SEEDS, False), hops, limit, none if semantic is None else semantic.select("id")
    )
    return traversal.hits(reached, apply_filters(live, plan.filters), score)


def node_hits(stores: Stores, plan: Plan, embedding: list[float]) -> DataFrame:
    """(node, id, score) of the records of the graph nodes nearest to the query, among those that pass the filters."""
    near = grounding.nearest_nodes(stores.nodes, stores.node_index, embedding, stores.model, plan.limits["graph"])
    allowed = apply_filters(stores.records.where(current(F.col("status"))), plan.filters)
    return grounding.node_leg(near, stores.nodes, allowed).select("node", "id", "score")


def temporal_leg(stores: Stores, plan: Plan, reference: datetime) -> DataFrame:
    rows = apply_filters(stores.records.where(current(F.col("status"))), plan.filters)
    return rows.withColumn("score", tm.decay(F.col("t0"), F.lit(reference))).where("score > 0").select("id", "score")


def retrieve(stores: Stores, plan: Plan, embedding: list[float] | None = None, reference: datetime | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, legs): the plan's budget of records, best first. Records that are not current are dropped after
    ranking and not replaced, so fewer than the budget may come."""
    hits, near, legs = None, None, list(plan.legs)
    limits = dict(plan.limits)
    if "graph" in legs and stores.nodes is not None and stores.node_index is not None and embedding is not None:
        near = materialize(node_hits(stores, plan, embedding), "node-hits")
        legs.append("graph_node")
        limits["graph_node"] = limits["graph"]
    for leg in legs:
        if leg == "sql":
            rows = sql_leg(stores, plan)
        elif leg == "vector":
            rows = vector_leg(stores, plan, embedding)
        elif leg == "graph_node":
            rows = near.groupBy("id").agg(F.max("score").alias("score"))
        elif leg == "graph" and stores.relations is not None:
            semantic = vector_leg(stores, plan, embedding).select("id") if "vector" in plan.legs else None
            rows = relation_leg(stores, plan, semantic, None if near is None else near.select(F.col("node").alias("id"))).select("id", "score")
        elif leg == "graph":
            rows = graph_leg(stores, plan, sql_leg(stores, plan).orderBy(F.desc("score"), "id").limit(50))
        else:
            rows = temporal_leg(stores, plan, reference)
        rows = lexical.top(rows, limits[leg]).select(F.lit(leg).alias("leg"), "id", "score")
        hits = rows if hits is None else hits.unionByName(rows)
    fused = fusion.reciprocal(hits, weights).orderBy(F.desc("score"), "id").limit(plan.budget)
    fused = materialize(fused, "fused")  # at most a budget; sent to the records, which are never a side that a task holds
    kept = stores.records.where(current(F.col("status"))).select("id").join(F.broadcast(fused.select("id")), "id", "left_semi").distinct()
    return fused.join(F.broadcast(kept), "id", "left_semi")


def recall(stores: Stores, plan: Plan, texts: DataFrame, budget_tokens: int, **options) -> DataFrame:
    """What `retrieve` finds with its texts(id, content), as long as they fit the budget of tokens."""
    from memspark.operators.evaluation import context_pack

    found = retrieve(stores, plan, **options).join(texts, "id")
    from pyspark.sql import Window

    placed = found.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("pack", F.lit(0))
    return context_pack(placed.withColumn("cost", tx.token_estimate(F.col("content"))), budget_tokens)
