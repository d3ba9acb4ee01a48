"""Trust, reconciliation, identity and provenance as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.scratch import materialize

#: Predicates that hold several objects at once.
MULTIVALUED = ("aliases", "content", "depends_on", "interests", "likes", "member_of", "owns", "requires", "roles", "supports", "tags")
#: What is wrong with a link of a provenance chain, in the order that it is found.
DEFECTS = (
    "no_evidence_links", "span_record_missing", "referenced_record_is_not_a_span", "span_carries_no_raw_id", "raw_record_missing",
    "referenced_record_is_not_raw", "raw_carries_no_string_content", "span_offsets_outside_raw_content",
)


def independent(source_ref: Column, agent: Column, model_output: Column, direct: Column) -> Column:
    """Whether an episode is evidence on its own: no model output, no directly written record, no assistant's chat
    turn, and no agent's own account of itself."""
    chat = F.coalesce(source_ref.rlike("^chat://.*/assistant$"), F.lit(False))
    own = F.coalesce(source_ref == F.concat(F.lit("agent://"), agent), F.lit(False))
    return ~(F.coalesce(model_output, F.lit(False)) | F.coalesce(direct, F.lit(False)) | chat | own)


def evidence_key(source_ref: Column, content_hash: Column, episode: Column) -> Column:
    """Episodes with one key corroborate once."""
    return F.coalesce(source_ref, content_hash, episode)


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """evidence(id, key, independent, active) to (id, support, active): distinct independent keys, any active episode."""
    return evidence.groupBy("id").agg(F.count_distinct(F.when(F.col("independent"), F.col("key"))).alias("support"), F.bool_or("active").alias("active"))


def trust(claims: DataFrame, evidence: DataFrame, challenges: DataFrame) -> DataFrame:
    """(id, state) of claims(id, status) from evidence and challenges(id, kind: superseded, refuted, contested).

    The first that applies: superseded, refuted, contested, stale (episodes, but none active), unverified if it is a
    hypothesis, verified by two independent keys, supported by one, else unverified.
    """
    counts = evidence_counts(evidence).withColumnRenamed("active", "any_active")
    raised = challenges.groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    joined = claims.join(counts, "id", "left").join(raised, "id", "left")
    has = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    state = (
        F.when((F.col("status") == "superseded") | has("superseded"), "superseded")
        .when((F.col("status") == "contradicted") | has("refuted"), "refuted")
        .when(has("contested"), "contested")
        .when(~F.coalesce("any_active", F.lit(True)), "stale")
        .when(F.col("status") == "hypothetical", "unverified")
        .when(F.coalesce("support", F.lit(0)) >= 2, "verified")
        .when(F.coalesce("support", F.lit(0)) >= 1, "supported")
        .otherwise("unverified")
    )
    return joined.select("id", state.alias("state"), F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def assertable(states: DataFrame) -> DataFrame:
    return states.where(F.col("state").isin("supported", "verified"))


def reconcile(claims: DataFrame) -> DataFrame:
    """claims(ns, scope, subject, predicate, id, object, t0, conf, cardinality) to a row a claim: winner and relation.

    Of two or more claims of one subject and predicate the winner has a time, the latest one, then the highest
    confidence and id. The others are its duplicates if their object is the same; else superseded if the winner's time
    is strictly later, and contradicted if it isn't or either lacks one. Multivalued predicates keep every object.
    """
    by = ["ns", "scope", "subject", "predicate"]
    order = F.struct(F.col("t0").isNotNull().alias("h"), F.col("t0").alias("t"), F.col("conf").alias("c"), F.col("id").alias("i"), F.col("object").alias("o"))
    groups = claims.groupBy(*by).agg(F.max(order).alias("w"), F.count(F.lit(1)).alias("claims"))
    joined = claims.join(groups.where("claims > 1"), by)
    later = F.coalesce(F.col("w.t") > F.col("t0"), F.lit(False))
    relation = (
        F.when(F.col("id") == F.col("w.i"), "winner")
        .when(F.col("object").eqNullSafe(F.col("w.o")), "duplicate")
        .when(F.col("cardinality") == "multivalued", "kept")
        .when(later, "superseded")
        .otherwise("contradicted")
    )
    return joined.select(*by, "id", F.col("w.i").alias("winner"), relation.alias("relation"))


def cardinality(predicate: Column, declared: Column | None = None) -> Column:
    built_in = F.when(F.lower(F.trim(predicate)).isin(*MULTIVALUED), "multivalued").otherwise("functional")
    return built_in if declared is None else F.coalesce(F.lower(F.trim(declared)), built_in)


def merge_candidates(mentions: DataFrame) -> DataFrame:
    """mentions(boundary, term, node, alias): for each term of a boundary that some node has as an alias, the node with
    most canonical votes, and the others as candidates to merge into it; 0.6 sure if it is canonical, else 0.4."""
    votes = mentions.groupBy("boundary", "term", "node").agg(F.count_if(~F.col("alias")).alias("canonical"), F.count_if(F.col("alias")).alias("aliases"))
    lead = votes.groupBy("boundary", "term").agg(
        F.min(F.struct((-F.col("canonical")).alias("c"), (-F.col("aliases")).alias("a"), "node")).alias("lead"), F.count(F.lit(1)).alias("n"), F.max("aliases").alias("m")
    )
    kept = lead.where("n > 1 and m > 0").select("boundary", "term", F.col("lead.node").alias("into"), (-F.col("lead.c")).alias("votes"))
    joined = votes.join(kept, ["boundary", "term"]).where("node != into and (aliases > 0 or votes = 0)")
    return joined.select("boundary", "term", "node", "into", F.when(F.col("votes") > 0, 0.6).otherwise(0.4).alias("confidence"))


def canonical(merges: DataFrame, rounds: int = 6) -> DataFrame:
    """(node, root) of accepted merges(node, into), one a node: where following them ends, within 2 ** rounds steps.
    Pointers are doubled each round; a cycle is cut off where the bound is."""
    at = materialize(merges.select("node", F.col("into").alias("root")), "canonical")
    for _ in range(rounds):
        further = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
        now = materialize(at.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "canonical")
        if now.where("moved").isEmpty():
            break
        at = now.select("node", "root")
    return now.select("node", "root")


def chains(records: DataFrame, spans: DataFrame, raws: DataFrame) -> DataFrame:
    """A row a link: records(id, evidence array) to spans(span_id, kind, raw_id, start, end) to raws(raw_id, kind,
    content), with the text or the defect. Offsets count code points from 0."""
    links = records.select("id", F.posexplode_outer("evidence").alias("pos", "span_id"))
    s = spans.select("span_id", F.col("kind").alias("span_kind"), "raw_id", "start", "end")
    r = raws.select("raw_id", F.col("kind").alias("raw_kind"), "content")
    j = links.join(s, "span_id", "left").join(r, "raw_id", "left")
    checks = (
        F.col("span_id").isNull(), F.col("span_kind").isNull(), F.col("span_kind") != "SPAN", F.coalesce("raw_id", F.lit("")) == "", F.col("raw_kind").isNull(),
        F.col("raw_kind") != "RAW", F.col("content").isNull(),
        ~F.coalesce((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("content")), F.lit(False)),
    )
    defect = F.when(checks[0], DEFECTS[0])
    for check, name in zip(checks[1:], DEFECTS[1:], strict=True):
        defect = defect.when(check, name)
    text = F.when(defect.isNull(), F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")))
    return j.select("id", "pos", "span_id", defect.alias("defect"), text.alias("text"))


def completeness(links: DataFrame) -> DataFrame:
    """complete, total and share of records whose links are all sound; the share of nothing is 1."""
    each = links.groupBy("id").agg(F.bool_and(F.col("defect").isNull()).alias("ok"))
    totals = each.agg(F.count_if("ok").alias("complete"), F.count(F.lit(1)).alias("total"))
    return totals.withColumn("share", F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("complete") / F.col("total")), 6))


def revalidated(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """merges(node, into) with `state`: accepted while both nodes(id) exist, else conflict."""
    known = nodes.select("id").distinct().withColumn("there", F.lit(True))
    for end in ("node", "into"):
        merges = merges.join(known.toDF(end, f"__{end}"), end, "left")
    both = F.coalesce(F.col("__node") & F.col("__into"), F.lit(False))
    return merges.select("node", "into", F.when(both, "accepted").otherwise("conflict").alias("state"))
