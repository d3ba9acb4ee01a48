"""Graph nodes as text and vectors, the leg they make, and the grounding of record seeds in entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.scratch import materialize

from . import graph, vectors
from .lexical import top

NODE_TEXT = "node-text/1"
#: Properties that say nothing of a node's meaning.
SKIPPED = ("agent_id", "confidence", "entity_type", "epistemic_basis", "ext", "facets", "record_kind", "status", "synthetic")
SEEDS = 300


def node_text(kind: Column, label: Column, properties: Column) -> Column:
    """Kind, label and the properties (a map of strings) by sorted key, blank and skipped ones left out; of parts that
    differ in case alone the first stays."""
    entries = F.filter(F.array_sort(F.map_entries(properties)), lambda e: e["value"].isNotNull() & ~e["key"].isin(*SKIPPED))
    parts = F.concat(F.array(kind, label), F.transform(entries, lambda e: e["value"]))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    low = F.transform(parts, F.lower)
    return F.array_join(F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1), " ")


def source_hash(text: Column, model: str) -> Column:
    """Binds a stored vector to its text, its model and the form of the text."""
    return F.sha2(F.concat_ws("\0", F.lit(NODE_TEXT), F.lit(model), text, F.lit("")), 256)


def nearest_nodes(nodes: DataFrame, index: DataFrame, query: list[float], model: str, k: int, where: Column | None = None, least: float = 0.0) -> DataFrame:
    """(id, score) of the k nodes(id, kind, label, properties, status) nearest by cosine, of index(id, embedding,
    source_hash). Deleted nodes and vectors of another text or model are left out before the cut, as is what `where` (of a
    node) refuses. Vectors become scores before they meet their nodes, by a merge, so no task holds a whole side; texts
    are made of nodes whose vector scores, where they meet."""
    alive = nodes.where(F.col("status") != "deleted_soft")
    alive = alive if where is None else alive.where(where)
    scored = vectors.scored(index, query).select("id", F.col("source_hash").alias("held"), "score")
    met = scored.join(alive.select("id", "kind", "label", "properties").hint("merge"), "id")
    due = source_hash(node_text(F.col("kind"), F.col("label"), F.col("properties")), model)
    fresh = met.where((F.length("held") == 64) & F.startswith("held", due))  # equal; as an equality it would be a join key, made of every node
    return top(fresh.select("id", "score"), k).where(F.col("score") > least)


def node_leg(nearest: DataFrame, nodes: DataFrame, records: DataFrame, include_raw: bool = False) -> DataFrame:
    """Hits (leg, node, id, score, reason) of the records(id, kind) that the nearest nodes come from: nodes(id,
    source_record_id), a node without one being its own record. Records that a filter took away lose their hits. Nearest
    nodes are few and sent to both, which are scanned where they are."""
    near = nodes.select("id", F.coalesce("source_record_id", "id").alias("record")).join(F.broadcast(nearest), "id").withColumn("__n", F.monotonically_increasing_id())
    allowed = records if include_raw else records.where("kind != 'RAW'")
    kept = allowed.select(F.col("id").alias("record")).join(F.broadcast(near), "record").dropDuplicates(["__n"])
    return kept.select(F.lit("graph_node").alias("leg"), F.col("id").alias("node"), F.col("record").alias("id"), "score", F.format_string("graph_node_semantic=%.4f", "score").alias("reason"))


def ground_seeds(seeds: DataFrame, entities: DataFrame, records: DataFrame, grounding: DataFrame, relations: DataFrame, limit: int, prefer_direct: bool = False) -> DataFrame:
    """(id) of the entities that record seeds(id) stand for, at most `limit`, by id.

    Of the seeds the 300 least ids count. An entity(id, ns, scope) among them stands for itself. A claim of records(id,
    kind, ns, scope, subject, object) stands for the entity that a grounding edge(src, predicate, dst, ns, scope) `about` or
    `object` names and the claim too; a relation, if it is among the canonical relations(id, src, dst), for those that
    `subject` and `object` name. With `prefer_direct` entities that stand for themselves end the search. Only ends of
    canonical relations stay. Everything is one boundary's: edge, record and entity share ns and scope.
    """
    chosen = materialize(seeds.select("id").distinct().orderBy("id").limit(SEEDS), "seeds")
    direct = entities.join(F.broadcast(chosen), "id", "left_semi").select("id").orderBy("id").limit(limit)
    found = direct
    if not prefer_direct or direct.isEmpty():
        own = records.join(F.broadcast(chosen), "id", "left_semi")
        claims = own.where("kind = 'CLM'").select(F.col("id").alias("src"), "ns", "scope", F.inline(F.array(F.struct(F.lit("about").alias("predicate"), F.col("subject").alias("dst")), F.struct(F.lit("object").alias("predicate"), F.col("object").alias("dst")))))
        canonical = relations.join(F.broadcast(chosen), "id", "left_semi").select("id", F.col("src").alias("a"), F.col("dst").alias("b"))
        rels = own.where("kind = 'REL'").select("id", "ns", "scope").join(canonical, "id")
        rels = rels.select(F.col("id").alias("src"), "ns", "scope", F.inline(F.array(F.struct(F.lit("subject").alias("predicate"), F.col("a").alias("dst")), F.struct(F.lit("object").alias("predicate"), F.col("b").alias("dst")))))
        same = ["src", "predicate", "dst", "ns", "scope"]
        met = grounding.select(same).join(F.broadcast(claims.unionByName(rels).select(same)), same, "left_semi")  # at most two rows a seed
        named = met.select(F.col("dst").alias("id"), "ns", "scope")
        ends = entities.join(F.broadcast(named), ["id", "ns", "scope"], "left_semi").select("id")
        found = direct.unionByName(ends.distinct().orderBy("id").limit(limit))
    found = F.broadcast(materialize(found.distinct(), "grounded"))  # at most twice limit; sent to the relations, whose ends are not shuffled
    ends = None
    for end in ("src", "dst"):
        at = relations.select(F.col(end).alias("id")).join(found, "id", "left_semi")
        ends = at if ends is None else ends.unionByName(at)
    return ends.distinct().orderBy("id").limit(limit)


def neighbour_name_score(edges: DataFrame, tokens: list[str], exact: bool = False) -> DataFrame:
    """(id, score): the share of a node's distinct neighbours whose id holds one of the tokens, or with `exact` is one."""
    near = graph.both_ways(edges.select("src", "dst")).distinct()
    hit = F.lit(False)
    for t in tokens:
        hit = hit | (F.lower("v") == t.lower() if exact else F.contains(F.lower("v"), F.lit(t.lower())))
    return near.groupBy(F.col("u").alias("id")).agg(F.avg(hit.cast("double")).alias("score"))


def episodes(rows: DataFrame, ns: str | None = None, scope: str | None = None, agent: str | None = None, at: Column | None = None, history: bool = False) -> DataFrame:
    """Episodes(ns, scope, agent, recorded_at, expired_at, status) of a boundary that were live at a moment, or without one
    are active; all of them with `history`. A blank end is open, a malformed one hides the episode."""
    from memspark.functions import temporal as tm

    for name, value in (("ns", ns), ("scope", scope), ("agent", agent)):
        if value:
            rows = rows.where(F.col(name) == value)
    if at is not None:
        missing = F.col("expired_at").isNull() | (F.trim("expired_at") == "")
        return rows.where(tm.visible_at(F.col("recorded_at"), tm.instant(F.col("expired_at")), missing, at))
    return rows if history else rows.where("status = 'active'")


def upserted(writes: DataFrame) -> DataFrame:
    """Nodes after writes(id, seq, kind, label, confidence, created_at, updated_at, synthetic) in order of seq. The last
    real write says what a node is; before any, the first synthetic one does, with the widest times. Confidence is the
    largest since the last real write. Aggregates only: a hot node is combined before the shuffle."""
    real = writes.where(~F.col("synthetic")).groupBy("id").agg(F.max("seq").alias("last"))
    rows = writes.join(real, "id", "left")
    is_last = F.col("seq") == F.col("last")
    one = lambda c: F.coalesce(F.max(F.when(is_last, F.col(c))), F.min_by(c, "seq"))
    return rows.groupBy("id").agg(
        one("kind").alias("kind"),
        F.left(one("label"), F.lit(180)).alias("label"),
        F.max(F.when(F.col("last").isNull() | (F.col("seq") >= F.col("last")), F.col("confidence"))).alias("confidence"),
        F.coalesce(F.max(F.when(is_last, F.col("created_at"))), F.min("created_at")).alias("created_at"),
        F.coalesce(F.max(F.when(is_last, F.col("updated_at"))), F.max("updated_at")).alias("updated_at"),
        F.bool_and("synthetic").alias("synthetic"),
    )
