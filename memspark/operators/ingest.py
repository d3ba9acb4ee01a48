"""What a write decides before it is made: batch operations by key, telemetry checks, projections, ids of a document, merge
proposals, reasoning nodes and verified outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import knowledge

BATCH = 10_000
CHECKS = 500_000  # verifications of a task


def plan_batches(items: DataFrame, stored: DataFrame, most: int = BATCH) -> DataFrame:
    """(key, n, digest, state) of the operations whose items(key, item, payload) came in, beside stored(key, digest): new,
    replay (the same items under the same key), conflict (others), or too_large, which gets no digest. Counts come first, so
    no group of more than `most` items is gathered."""
    sized = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    line = F.struct("item", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("h"))
    fits = items.join(sized.where(F.col("n") <= most).select("key"), "key", "left_semi")
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda s: F.concat_ws("\t", s["item"].cast("string"), s["h"]))
    digests = fits.groupBy("key").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
    known = stored.select("key", F.col("digest").alias("held"))
    j = sized.join(digests, "key", "left").join(known, "key", "left")
    state = F.when(F.col("n") > most, "too_large").when(F.col("held").isNull(), "new").when(F.col("held") == F.col("digest"), "replay").otherwise("conflict")
    return j.select("key", "n", "digest", state.alias("state"))


def pending_items(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items(key, item) that no finished one stands for, so a run that broke off goes on where it was."""
    return items.join(done.select("key", "item"), ["key", "item"], "left_anti")


def telemetry_fault() -> Column:
    """Why a retrieval event(run_id, query, source_kind, candidate_ids, ranks, scores) can't be appended, else null."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    differs = lambda c: F.col(c).isNotNull() & (F.size(c) != F.size("candidate_ids"))
    out = F.when(blank("run_id"), "run_id").when(blank("query"), "query").when(blank("source_kind"), "source_kind")
    return out.when(differs("ranks"), "ranks").when(differs("scores"), "scores")


def projections(writes: DataFrame) -> DataFrame:
    """The last of writes(record_id, projection_kind, text, token_count, seq) of each record and kind."""
    last = writes.groupBy("record_id", "projection_kind").agg(F.max_by(F.struct("text", "token_count"), "seq").alias("w"))
    return last.select("record_id", "projection_kind", "w.*")


def namespaced(rid: Column, suffix: Column) -> Column:
    """head:tail as head:suffix:tail, an id without a colon as id:suffix."""
    at = F.instr(rid, ":")
    return F.when(at == 0, F.concat_ws(":", rid, suffix)).otherwise(F.concat_ws(":", F.left(rid, at - 1), suffix, F.substring(rid, at + 1, F.length(rid))))


def namespaced_batch(records: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(document, id, ...) and references(document, id, ref) with the document in their ids; a reference to what
    the batch does not hold stays as it is."""
    renamed = lambda c: namespaced(F.col(c), F.col("document").cast("string"))
    held = records.select("document", F.col("id").alias("ref"), F.lit(True).alias("held"))
    j = references.join(held, ["document", "ref"], "left")
    refs = j.select("document", renamed("id").alias("id"), F.when(F.col("held"), renamed("ref")).otherwise(F.col("ref")).alias("ref"))
    return records.withColumn("id", renamed("id")), refs


def classified_merges(proposals: DataFrame, ledger: DataFrame) -> DataFrame:
    """(canonical, alias, status, reason) of proposals(canonical, alias) to a ledger(canonical, alias, status) of one
    boundary. What was accepted or split keeps its status. A proposal of a node to itself is refused; one whose reverse is
    proposed or accepted, whose alias another node has absorbed, or that would close a circle is a conflict.

    A circle closes where the canonical node resolves to the alias. An alias inside that chain is absorbed already, so only
    the chain's end has to be looked at.
    """
    p = proposals.select("canonical", "alias").distinct()
    accepted = ledger.where("status = 'accepted'").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    same = ledger.select("canonical", "alias", F.col("status").alias("held"))
    back = ledger.where("status in ('proposed', 'accepted')").select(F.col("alias").alias("canonical"), F.col("canonical").alias("alias"), F.lit(True).alias("reversed")).distinct()
    taken = accepted.select("alias", F.col("canonical").alias("taken"))
    roots = knowledge.canonical(accepted.select(F.col("alias").alias("node"), F.col("canonical").alias("into"))).select(F.col("node").alias("canonical"), "root")
    j = p.join(same, ["canonical", "alias"], "left").join(back, ["canonical", "alias"], "left").join(taken, "alias", "left").join(roots, "canonical", "left")
    reason = (
        F.when(F.col("canonical") == F.col("alias"), "self")
        .when(F.col("held").isin("accepted", "split"), F.lit(None))
        .when(F.col("reversed"), "reverse")
        .when(F.col("taken").isNotNull() & (F.col("taken") != F.col("canonical")), "absorbed")
        .when(F.col("root") == F.col("alias"), "cycle")
    )
    status = F.when(reason == "self", "refused").when(reason.isNotNull(), "conflict").when(F.col("held").isin("accepted", "split"), F.col("held")).otherwise("proposed")
    return j.select("canonical", "alias", status.alias("status"), reason.alias("reason"))


def appended_nodes(stored: DataFrame, added: DataFrame) -> DataFrame:
    """added(run, node, pos, ref) with the place each takes in its run after stored(run, node, seq), in order of pos. A node
    whose ref is no node of its own run, stored or added, is refused and takes none."""
    last = stored.groupBy("run").agg(F.max("seq").alias("last"))
    known = stored.select("run", F.col("node").alias("ref")).unionByName(added.select("run", F.col("node").alias("ref"))).distinct().withColumn("known", F.lit(True))
    j = added.join(known, ["run", "ref"], "left").withColumn("accepted", F.col("ref").isNull() | F.coalesce("known", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("run", "accepted").orderBy("pos", "node"))
    placed = j.withColumn("nth", nth).join(last, "run", "left")
    return placed.select("run", "node", "accepted", F.when(F.col("accepted"), F.coalesce("last", F.lit(0)) + F.col("nth")).alias("seq"))


def verified_outcomes(outcomes: DataFrame, verifications: DataFrame) -> DataFrame:
    """(outcome, checks, accepted) of outcomes(outcome, run, verification), a row a verification named: accepted if it names
    some, and each is there, of its run, passed and not retried since: verifications(verification, run, verdict, retry_of).

    Tasks are as many as verifications need; outcomes that name none are dealt by themselves, not all to one task."""
    parts = max(1, -(-verifications.count() // CHECKS))
    met = lambda df: df.repartition(parts, "verification").hint("merge")
    retried = met(verifications.where("retry_of is not null").select(F.col("retry_of").alias("verification"), F.lit(True).alias("retried"))).distinct()
    v = verifications.select("verification", F.col("run").alias("of"), "verdict")
    rows = outcomes.withColumn("named", F.col("verification")).withColumn("verification", F.coalesce("verification", F.concat(F.lit("\0"), F.col("outcome").cast("string"))))
    j = met(rows).join(met(v), "verification", "left").join(retried.hint("merge"), "verification", "left")
    good = F.col("named").isNotNull() & (F.col("of") == F.col("run")) & (F.col("verdict") == "passed") & F.col("retried").isNull()
    checks = F.count("named")
    return j.select("outcome", "named", good.alias("good")).repartition(parts, "outcome").groupBy("outcome").agg(checks.alias("checks"), ((checks > 0) & F.bool_and(F.coalesce("good", F.lit(False)))).alias("accepted"))
