"""Graph operators over nodes(id, ...) and edges(src, predicate, dst, ...). Hops are joins; a hop's frontier is a
DataFrame, and every traversal is bounded by a number of hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.scratch import materialize


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (u, v) and the edge's other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), *rest)
    return there.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), *rest))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree), 0 for nodes without edges. An edge gives both its ends, so edges are made once."""
    counted = edges.select(F.explode(F.array("src", "dst")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, nodes["id"] == counted["u"], "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False, broadcast_rows: int = 100_000) -> DataFrame:
    """(id, hop): the fewest edges from a seed(id) to each node within `hops`.

    Edges are written once, as they are. A frontier of at most broadcast_rows nodes is sent to them, so a hop is a scan and
    what is shuffled is the nodes it finds, each once a task; a larger one is joined with a salt, so a hub's edges are many
    tasks'. Ids compress so well that the size of their files says nothing, so what is larger is never broadcast."""
    held = materialize(edges.select("src", "dst"), "steps")  # read once a hop
    salt = F.pmod(F.xxhash64("src", "dst"), F.lit(16)).cast("int")
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    frontier = materialize(seen, "hop")
    known = 0
    for hop in range(1, hops + 1):
        ids, found = frontier.select("id"), None
        new = ids.count()  # of written rows
        few, known = new <= broadcast_rows, known + new
        for here, there in (("src", "dst"),) if directed else (("src", "dst"), ("dst", "src")):
            at = ids.withColumnRenamed("id", here)
            if few:
                met = held.join(F.broadcast(at), here, "left_semi")
            else:
                salted = at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
                met = held.withColumn("salt", salt).join(salted.hint("merge"), [here, "salt"], "left_semi")
            met = met.select(F.col(there).alias("id"))
            found = met if found is None else found.unionByName(met)
        past = F.broadcast(seen) if known <= broadcast_rows else seen.hint("merge")
        frontier = materialize(found.distinct().join(past, "id", "left_anti").select("id", F.lit(hop).alias("hop")), "hop")
        seen = seen.unionByName(frontier)
    return seen


def budgeted_hops(edges: DataFrame, seeds: DataFrame, hops: int, edge_budget: int) -> DataFrame:
    """Like k_hop, but each hop takes only its best edges by confidence, ties by the edge's ends; with each node's parent."""
    steps = materialize(both_ways(edges), "steps")  # read once a hop
    seen = seeds.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        met = frontier.join(steps, frontier["id"] == steps["u"]).join(seen.select(F.col("id").alias("v")), "v", "left_anti")
        best = met.orderBy(F.desc("confidence"), "u", "v").limit(edge_budget)
        found = best.groupBy(F.col("v").alias("id")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("u").alias("u")))["u"].alias("parent"))
        frontier = materialize(found.select("id", F.lit(hop).alias("hop"), "parent"), "hop")
        seen = seen.unionByName(frontier)
    return seen


def activation(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.72, broadcast_rows: int = 100_000) -> DataFrame:
    """(id, activation, hop): the largest product of decay and confidence over paths of at most `hops` edges from
    seeds(id, score), and the fewest edges that reach it. Edges are written once, as they are; of those between the same nodes
    a hop takes the best anyway. A frontier of at most broadcast_rows nodes is sent to them."""
    held = materialize(edges.select("src", "dst", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("c")), "steps")  # read once a hop
    best = seeds.select("id", F.col("score").alias("a"), F.lit(0).alias("hop"))
    frontier = best
    for hop in range(1, hops + 1):
        few, moved = frontier.limit(broadcast_rows + 1).count() <= broadcast_rows, None
        for here, there in (("src", "dst"), ("dst", "src")):
            at = frontier.select(F.col("id").alias(here), "a")
            met = held.join(F.broadcast(at) if few else at.hint("merge"), here).select(F.col(there).alias("id"), (F.col("a") * decay * F.col("c")).alias("a"))
            moved = met if moved is None else moved.unionByName(met)
        moved = materialize(moved.groupBy("id").agg(F.max("a").alias("a")).withColumn("hop", F.lit(hop)), "activation")
        frontier = moved
        best = best.unionByName(moved)
    top = best.groupBy("id").agg(F.max(F.struct("a", (-F.col("hop")).alias("h"))).alias("m"))
    return top.select("id", F.col("m.a").alias("activation"), (-F.col("m.h")).alias("hop")).where("activation > 0")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id connected to each node that has an edge, by min-label propagation with jumps."""
    steps = both_ways(edges.select("src", "dst")).distinct()
    least = steps.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"))
    labels = materialize(least.select("id", F.least("id", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = steps.join(labels, steps["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["id"] == near["u"]).select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = lower.select(F.col("id").alias("j"), F.col("label").alias("further"))
        now = materialize(lower.join(jump, lower["label"] == jump["j"], "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels")
        if now.where("label != was").isEmpty():
            return now.select("id", F.col("label").alias("component"))
        labels = now.select("id", "label")
    raise RuntimeError("components have not settled")


def visible(rows: DataFrame, moment: Column, start: str = "t0", end: str = "t1") -> DataFrame:
    """Rows that hold at a moment: from their start to their end, the end excluded; without an end they are open."""
    return rows.where((F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment)))


def kinds(rows: DataFrame, column: str, most: int = 100) -> list[str] | None:
    """What stands before the first colon of ids, each once; None if it is of more than `most` kinds."""
    found = rows.select(F.substring_index(column, ":", 1).alias("kind")).where("kind is not null").distinct().limit(most + 1).collect()
    return [r.kind for r in found] if len(found) <= most else None


def of_kinds(column: str, some: list[str] | None) -> Column:
    """Whether an id is of some kinds; any id is where these are None."""
    return F.lit(True) if some is None else F.coalesce(F.substring_index(column, ":", 1).isin(some), F.lit(False))


def eligible(records: DataFrame, references: DataFrame, leaves: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """Current records whose references, and those' references, are current too: records(id, current, ...),
    references(id, ref). Each round adds ids, so the rounds end, however deep references are nested. Records that nothing
    refers to may come as leaves(id, current, ref, ...), a row with its one reference, where an id's rows agree; they take
    no part in the rounds and are judged last, by what they refer to.

    Only references to, and records of, a kind of ids that is in question are shuffled: a round reads references to the kinds
    that the last one reached, and ids of a kind that no record refers to are not carried on. At most broadcast_rows ids are
    sent to the rows; more are merged with them, whatever the size of their files says."""

    def meet(rows: DataFrame, ids: DataFrame, n: int, key: str, how: str) -> DataFrame:
        ids = ids.select(F.col("id").alias(key))
        return rows.join(F.broadcast(ids) if n <= broadcast_rows else ids.hint("merge"), key, how)

    named = kinds(references, "ref")
    bad = materialize(records.where(~F.col("current")).select("id"), "ineligible")
    known = bad.count()  # of written rows
    frontier = bad.where(of_kinds("id", named))
    while True:
        here, new = kinds(frontier, "id"), frontier.count()
        if not new:
            break
        reached = materialize(meet(references.where(of_kinds("ref", here)), frontier, new, "ref", "left_semi").select("id"), "reached")
        frontier = materialize(meet(reached.where(of_kinds("id", named)).distinct(), bad, known, "id", "left_anti"), "ineligible")
        bad, known = bad.unionByName(reached), known + reached.count()
    touched = kinds(bad, "id")
    kept = meet(records.where(of_kinds("id", touched)), bad, known, "id", "left_anti")
    if touched is not None:
        kept = kept.unionByName(records.where(~of_kinds("id", touched)))
    if leaves is not None:
        current = leaves.where(F.coalesce("current", F.lit(True)))
        kept = kept.unionByName(meet(current, bad, known, "ref", "left_anti").drop("ref"))
    return kept.drop("current")


def leg_scores(reached: DataFrame, edges: DataFrame, lexical: DataFrame) -> DataFrame:
    """Graph leg: lexical + min(0.6, 0.1 per neighbour) + 0.5 for a seed, of reached(id, hop) and lexical(id, score)."""
    near = both_ways(edges.select("src", "dst")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    joined = reached.join(near, reached["id"] == near["u"], "left").join(lexical.select("id", F.col("score").alias("lex")), "id", "left")
    score = F.coalesce("lex", F.lit(0.0)) + F.least(F.lit(0.6), F.coalesce("n", F.lit(0)) * 0.1) + F.when(F.col("hop") == 0, 0.5).otherwise(0.0)
    return joined.select("id", "hop", score.alias("score"))


def best_of_each(rows: DataFrame, key: str, order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """Rows of which the first n by key and order are among: the first n of each salt of a key, so a key that a third of the
    rows share is cut in many tasks before its rows meet."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    nth = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order))
    return rows.withColumn("__salt", salt).withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__salt", "__nth")


def recurring(facts: DataFrame, least: int) -> DataFrame:
    """Observations: (subject, predicate) that `least` or more episodes support; facts(subject, predicate, episode)."""
    return facts.groupBy("subject", "predicate").agg(F.countDistinct("episode").alias("episodes")).where(F.col("episodes") >= least)


def new_versions(products: DataFrame, stored: DataFrame) -> DataFrame:
    """products(product, fingerprint) with the version each gets: the stored one if its fingerprint is the latest, else one more."""
    last = stored.groupBy("product").agg(F.max("version").alias("v"), F.max_by("fingerprint", "version").alias("f"))
    joined = products.join(last, "product", "left")
    same = F.col("fingerprint").eqNullSafe(F.col("f"))
    return joined.select("product", "fingerprint", F.when(same, F.col("v")).otherwise(F.coalesce("v", F.lit(0)) + 1).alias("version"), (~same).alias("written"))


# Predicates by family, and those that traversal may follow.
FAMILIES = {
    "epistemic": ("supports", "contradicts", "corrects", "refutes", "corroborates", "derived_from", "unverified_by"),
    "causal": ("caused_by", "causes", "motivated_by", "because", "reason", "resulted_in", "leads_to"),
    "temporal": ("precedes", "follows", "before", "after", "then", "occurred_at", "valid_during", "supersedes"),
    "provenance": ("provenance", "evidence", "excerpt_of", "contributed", "produced"),
    "facet": ("who", "what", "when", "where", "why", "how", "then"),
}
ADMITTED = (
    *FAMILIES["epistemic"], *FAMILIES["causal"], *FAMILIES["temporal"],
    "affiliated_with", "attended", "collaborates_with", "connects", "depends_on", "governs", "has", "knows", "leads", "likes", "located_in", "manages",
    "member_of", "mentions", "mentored", "mentors", "met", "next_scale_node", "owns", "references", "related_to", "reports_to", "requires",
    "reviews_with", "uses", "uses_domain", "went_to", "works_at", "works_with",
)


def family(predicate: Column) -> Column:
    """The family of a predicate, `semantic` for those in none."""
    name = F.lower(F.trim(F.coalesce(predicate, F.lit(""))))
    out = F.when(name.isin(*FAMILIES["epistemic"]), "epistemic")
    for kind in ("causal", "temporal", "provenance", "facet"):
        out = out.when(name.isin(*FAMILIES[kind]), kind)
    return out.otherwise("semantic")


def admitted(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("predicate").isin(*ADMITTED))


def node_page(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(direction, predicate, other, label) of one node's edges."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), "predicate", F.col("dst").alias("other"))
    into = edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), "predicate", F.col("src").alias("other"))
    return out.unionByName(into).join(nodes.select(F.col("id").alias("other"), "label"), "other", "left").select("direction", "predicate", "other", "label")


def motifs(edges: DataFrame) -> DataFrame:
    """(motif, n): edges, two-edge paths, forks and joins. Pairs are counted from each node's degrees, never listed; an edge
    gives both its ends, so edges are made once."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(end).alias("id"), F.lit(o).alias("o"), F.lit(1 - o).alias("i")) for end, o in (("src", 1), ("dst", 0))])))
    d = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    totals = d.agg(
        F.sum("o").alias("edge"), F.sum(F.col("o") * F.col("i")).alias("path"), F.sum(F.expr("o * (o - 1) div 2")).alias("fork"), F.sum(F.expr("i * (i - 1) div 2")).alias("join")
    )
    return totals.select(F.inline(F.array(*[F.struct(F.lit(m).alias("motif"), F.coalesce(m, F.lit(0)).alias("n")) for m in ("edge", "path", "fork", "join")])))
