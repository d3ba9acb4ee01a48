"""Reasoning patterns: whether what they were learned from still holds, and how often they were of use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of knowledge that is no longer active.
INACTIVE = ("contradicted", "superseded", "deprecated", "deleted_soft", "stale")
CAUSES = ("outcome", "verification", "evidence", "knowledge")


def fingerprint(payload: Column) -> Column:
    return F.sha2(payload, 256)


def validity(patterns: DataFrame, statuses: DataFrame, verifications: DataFrame, records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern, valid, cause, what): whether each pattern's provenance is current, and if not, the first cause and the least id.

    patterns(pattern, run, outcome, ns, scope, verifications, evidence, knowledge): evidence maps record ids to the
    fingerprints they had. A pattern falls when the latest of statuses(outcome, seq, status) is not `accepted` or there is none;
    when one of its verifications(id, run, current) is missing, of another run or not current; when one of records(id, ns,
    scope, payload) is gone, beyond its boundary or has another fingerprint; when one of nodes(id, ns, scope, status) is gone,
    beyond its boundary or inactive. Each cause is an equi-join of what the patterns name with what is there, so what a change
    touches is found without looking at other patterns. Empty and null lists name nothing; repeated names count once."""
    own = patterns.select("pattern", "run", "outcome", "ns", "scope", "verifications", "evidence", "knowledge")
    last = statuses.groupBy("outcome").agg(F.max_by("status", "seq").alias("status"))
    out = own.select("pattern", "outcome").join(last, "outcome", "left").where(~F.col("status").eqNullSafe(F.lit("accepted")))
    bad = out.select("pattern", F.lit(0).alias("cause"), F.col("outcome").alias("what"))

    named = own.select("pattern", "run", F.explode(F.array_distinct("verifications")).alias("id"))
    there = verifications.select("id", F.col("run").alias("own"), "current")
    kept = F.col("own").eqNullSafe(F.col("run")) & F.coalesce("current", F.lit(False))
    bad = bad.unionByName(named.join(there, "id", "left").where(~kept).select("pattern", F.lit(1).alias("cause"), F.col("id").alias("what")))

    inside = F.col("own_ns").eqNullSafe(F.col("ns")) & F.col("own_scope").eqNullSafe(F.col("scope"))
    named = own.select("pattern", "ns", "scope", F.explode("evidence").alias("id", "expected"))
    there = records.select("id", F.col("ns").alias("own_ns"), F.col("scope").alias("own_scope"), fingerprint(F.col("payload")).alias("found"))
    same = inside & F.col("found").eqNullSafe(F.col("expected")) & F.col("found").isNotNull()
    bad = bad.unionByName(named.join(there, "id", "left").where(~same).select("pattern", F.lit(2).alias("cause"), F.col("id").alias("what")))

    named = own.select("pattern", "ns", "scope", F.explode(F.array_distinct("knowledge")).alias("id"))
    there = nodes.select("id", F.col("ns").alias("own_ns"), F.col("scope").alias("own_scope"), "status")
    active = inside & F.coalesce(~F.col("status").isin(*INACTIVE), F.lit(False))
    bad = bad.unionByName(named.join(there, "id", "left").where(~active).select("pattern", F.lit(3).alias("cause"), F.col("id").alias("what")))

    first = bad.groupBy("pattern").agg(F.min(F.struct("cause", "what")).alias("f"))
    name = F.get(F.array(*map(F.lit, CAUSES)), F.col("f.cause"))
    return own.select("pattern").join(first, "pattern", "left").select("pattern", F.col("f").isNull().alias("valid"), name.alias("cause"), F.col("f.what").alias("what"))


def use_counts(uses: DataFrame, results: DataFrame, disagreements: DataFrame) -> DataFrame:
    """(pattern, uses, successes, failures, disagreements) of uses(use, pattern), results(use, succeeded), one a use at most, and
    later disagreements(use, succeeded), which count as results too."""
    tally = lambda rows, name: rows.groupBy("use").agg(F.count_if("succeeded").alias(f"{name}_yes"), F.count_if(~F.col("succeeded")).alias(f"{name}_no"))
    rows = uses.join(tally(results, "r"), "use", "left").join(tally(disagreements, "d"), "use", "left").fillna(0, ["r_yes", "r_no", "d_yes", "d_no"])
    return rows.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("uses"), F.sum(F.col("r_yes") + F.col("d_yes")).alias("successes"), F.sum(F.col("r_no") + F.col("d_no")).alias("failures"),
        F.sum(F.col("d_yes") + F.col("d_no")).alias("disagreements"),
    )
