"""Probes of a graph: questions that its own motifs ask, with the nodes that answer them, and their split for tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.scratch import materialize, sent

from . import graph

PROBE = "motif string, query string, expected array<string>, sources array<string>, episodes array<string>, action string"
# Facets in order, predicates that dispute.
FACETS = ("who", "what", "when", "where", "why", "how", "then")
DISPUTES = ("contradicts", "refutes")
CONTINUATIONS, SALTS = 3, 8
DIGITS = 4  # of a hash, by which cases are counted
PROBES = 200_000  # of a task that looks for those with the same answer


def probe(motif: Column | str, query: Column, expected: Column, sources: Column, action: Column | str = "retrieve", episodes: Column | None = None) -> list[Column]:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    known = lambda x: F.array_distinct(F.filter(x, lambda v: F.coalesce(v != "", F.lit(False))))
    return [
        column(motif).alias("motif"), query.alias("query"), known(expected).alias("expected"), known(sources).alias("sources"),
        (F.array().cast("array<string>") if episodes is None else known(episodes)).alias("episodes"), column(action).alias("action"),
    ]


def labelled(rows: DataFrame, nodes: DataFrame, n: int, *ends: str) -> DataFrame:
    """Rows with all their ends among n nodes, and the labels of these."""
    for end in ends:
        rows = rows.join(sent(nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), n), end)
    return rows


def paths(edges: DataFrame) -> DataFrame:
    """(first, second, start, middle, end, sources) of two-edge paths over three nodes: each edge with the first three, by id,
    that leave its end. Three a node are kept before they meet its edges, so a hub adds three paths an edge, not all pairs."""
    w = Window.partitionBy("src").orderBy("id")
    out = graph.best_of_each(edges.select("src", "id", "dst", "source"), "src", [F.asc("id")], CONTINUATIONS)
    out = out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= CONTINUATIONS)
    out = out.select(F.col("src").alias("middle"), F.col("id").alias("second"), F.col("dst").alias("end"), F.col("source").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    into = edges.select(F.col("src").alias("start"), F.col("dst").alias("middle"), F.col("id").alias("first"), F.col("source").alias("a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    both = into.join(out.hint("merge"), ["middle", "salt"]).where("start != middle and middle != end and start != end")
    return both.select("first", "second", "start", "middle", "end", F.array("a", "b").alias("sources"))


def generated(nodes: DataFrame, edges: DataFrame, links: DataFrame, trust: DataFrame) -> DataFrame:
    """(case_id, *PROBE) of nodes(id, label, source, facets), edges(id, src, predicate, dst, edge_kind, source), links(node,
    episode, source) and trust(id, state): all of what is live. Seven families: facets to recover, causes, times, disputes,
    two-edge paths, provenance, and claims without evidence that must not be asserted. Of probes of one family with the same
    answer the first counts, by the id of its edge or episode."""
    nodes = materialize(nodes.select("id", "label", "source", "facets"), "nodes")
    n = nodes.count()  # of written rows
    edges = materialize(labelled(edges.select("id", "src", "predicate", "dst", "edge_kind", "source"), nodes, n, "src", "dst"), "edges")
    facets = F.filter(F.array(*map(F.lit, FACETS)), lambda f: F.array_contains("facets", f))
    asked = nodes.where(F.size(F.array_distinct("facets")) > 1)
    out = asked.select(F.col("id").alias("by"), *probe("five_w_one_h_then", F.concat(F.lit("Recover the "), F.array_join(facets, ", "), F.lit(" context for "), "label"), F.array("id"), F.array("source")))

    family = F.when(graph.family(F.col("predicate")) == "semantic", F.col("edge_kind")).otherwise(graph.family(F.col("predicate")))
    motif = F.when(family.isin("causal", "temporal"), family).when(F.lower("predicate").isin(*DISPUTES), "contradiction")
    said = F.concat(F.lit("What does "), "src_label", F.lit(" "), "predicate", F.lit(" with respect to "), "dst_label", F.lit("?"))
    typed = edges.withColumn("family", motif).where("family is not null")
    action = F.when(F.col("family") == "contradiction", "surface_dispute").otherwise("retrieve")
    out = out.unionByName(typed.select(F.col("id").alias("by"), *probe(F.col("family"), said, F.array("src", "dst"), F.array("source"), action)))

    hops = labelled(paths(edges), nodes, n, "start", "middle", "end")
    trace = F.concat(F.lit("Trace from "), "start_label", F.lit(" through "), "middle_label", F.lit(" to "), "end_label")
    out = out.unionByName(hops.select(F.concat_ws(" ", "first", "second").alias("by"), *probe("multi_hop", trace, F.array("start", "middle", "end"), F.col("sources"))))

    held = links.select(F.col("node").alias("id"), "episode", F.col("source").alias("from")).join(sent(nodes.select("id", "label"), n), "id")
    which = F.concat(F.lit("Which episode supports or produced "), "label", F.lit("?"))
    out = out.unionByName(held.select(F.col("episode").alias("by"), *probe("provenance", which, F.array("id"), F.array("from"), episodes=F.array("episode"))))

    bare = trust.where("state = 'unverified'").select("id").distinct().join(sent(nodes, n), "id")
    asserted = F.concat(F.lit("Can this be asserted as established knowledge: "), "label", F.lit("?"))
    out = out.unionByName(bare.select(F.col("id").alias("by"), *probe("unsupported", asserted, F.array("id"), F.array("source"), "abstain_or_qualify")))

    rest = [c for c in out.columns if c not in ("by", "motif", "expected")]
    # Answers hardly repeat: probes meet before they are sorted, not after, and few a task, so that none spills.
    parts = max(1, -(-3 * (n + edges.count()) // PROBES))  # of written rows
    met = out.where(F.size("expected") > 0).repartition(parts, "motif", "expected")
    one = met.groupBy("motif", "expected").agg(F.min(F.struct("by", *rest)).alias("x")).select("motif", "expected", *[F.col(f"x.{c}") for c in rest])
    material = F.concat_ws("\x1f", "motif", "query", F.array_join("expected", "\x1e"), F.array_join("sources", "\x1e"), F.array_join("episodes", "\x1e"), "action")
    return one.withColumn("case_id", F.concat(F.lit("graph:"), "motif", F.lit(":"), F.left(F.sha2(material, 256), F.lit(16))))


def split(probes: DataFrame, sample: int, seed: int = 1234) -> DataFrame:
    """(case_id, motif, side) of at most `sample` probes each for `dev` and `holdout`, disjoint, in turn from each motif. A
    fifth of a motif, one at least, is held out, by the hash of seed and case. Cases are counted by motif and the first digits
    of their hash; the counts say which of these bins hold the places that a side may take, and only those are ordered, so a
    motif of any size is neither sorted nor shuffled."""
    if sample < 1:
        raise ValueError("a sample of one at least")
    rows = materialize(probes.select("case_id", "motif"), "probes")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), "case_id"), 256)
    rows = rows.withColumn("order", order).withColumn("bin", F.left("order", F.lit(DIGITS)))
    bins = rows.groupBy("motif", "bin").agg(F.count(F.lit(1)).alias("n"))  # at most 65 536 a motif
    motif, so_far = Window.partitionBy("motif"), Window.partitionBy("motif").orderBy("bin")
    bins = bins.withColumns({"before": F.sum("n").over(so_far) - F.col("n"), "held": F.greatest(F.lit(1), F.floor(F.sum("n").over(motif) / 5))})
    begun, ended = F.col("before"), F.col("before") + F.col("n")
    bins = materialize(bins.where((begun < sample) | ((begun < F.col("held") + sample) & (ended > F.col("held")))).select("motif", "bin", "before", "held"), "bins")
    nth = F.row_number().over(Window.partitionBy("motif", "bin").orderBy("order", "case_id"))
    rows = rows.join(F.broadcast(bins), ["motif", "bin"]).withColumn("at", F.col("before") + nth - 1)
    rows = rows.withColumns({"side": F.when(F.col("at") < F.col("held"), "holdout").otherwise("dev"), "turn": F.when(F.col("at") < F.col("held"), F.col("at")).otherwise(F.col("at") - F.col("held"))})
    rows = materialize(rows.where(F.col("turn") < sample).select("case_id", "motif", "side", "turn"), "turns")
    out = None
    for side in ("dev", "holdout"):
        some = rows.where(F.col("side") == side).orderBy("turn", "motif").limit(sample).select("case_id", "motif", "side")
        out = some if out is None else out.unionByName(some)
    return out
