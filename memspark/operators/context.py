"""Contexts for a task: what may enter one, why the rest may not, and what fits its budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from memspark.scratch import materialize

CANDIDATE = (
    "candidate_id string, kind string, text string, ns string, scope string, trust_state string, occurred_at timestamp, valid_until timestamp, "
    "current boolean, record_ids array<string>, episode_ids array<string>, entity_ids array<string>, product_id string, task_tags array<string>"
)
# Kinds in order of rank, those that are derived, and trust states by rank.
KINDS = ("fact", "entity", "episode", "observation", "entity_summary", "community_summary")
DERIVED = ("entity_summary", "community_summary", "observation")
TRUST = {"verified": 2, "supported": 1}
TERM = r"[\p{L}\p{N}_]+"


def supported(candidates: DataFrame, current: DataFrame, most: int = 100_000) -> DataFrame:
    """Candidates all of whose record_ids are among current(id); one without any stays. Only names of records that are not
    current are looked for, each once; while they are at most `most` they are sent to the candidates, so a record that a
    third of them cite is no one task's."""
    cited = candidates.select(F.explode("record_ids").alias("id")).distinct()
    gone = materialize(cited.join(current.select("id"), "id", "left_anti"), "not-current")
    if gone.limit(most + 1).count() <= most:
        gone = F.broadcast(gone)
    keyed = materialize(candidates.withColumn("__key", F.monotonically_increasing_id()), "candidates")
    bad = keyed.select("__key", F.explode("record_ids").alias("id")).join(gone, "id", "left_semi").select("__key").distinct()
    return keyed.join(bad, "__key", "left_anti").drop("__key")


def blank(column: str) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def reason(ns: str, scope: str, moment: Column) -> Column:
    """The first reason why a candidate may not enter a context, null for one that may."""
    listed = lambda name: F.coalesce(F.size(name) == 0, F.lit(True)) | F.coalesce(F.exists(name, lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(False))
    missing = F.lit(False)
    for name in ("candidate_id", "kind", "text", "ns", "scope", "trust_state"):
        missing = missing | blank(name)
    missing = missing | listed("record_ids") | listed("episode_ids") | F.col("occurred_at").isNull() | (F.col("product_id").isNotNull() & blank("product_id"))
    kind = F.lower(F.trim("kind"))
    return (
        F.when(missing, "malformed")
        .when((F.trim("ns") != ns) | (F.trim("scope") != scope), "boundary")
        .when(~kind.isin(*KINDS), "kind")
        .when(~F.lower(F.trim("trust_state")).isin(*TRUST), "trust")
        .when(~F.coalesce("current", F.lit(True)), "not_current")
        .when((F.col("occurred_at") > moment) | F.coalesce(F.col("valid_until") <= moment, F.lit(False)), "time")
        .when(kind.isin(*DERIVED) & F.col("product_id").isNull(), "derived_without_product")
    )


def task_score(task: str, text: Column, tags: Column) -> Column:
    """How many of the task's terms the text or a tag has."""
    import regex

    wanted = sorted({t.lower() for t in regex.findall(TERM, task)})
    if not wanted:
        return F.lit(0)
    said = F.concat_ws(" ", text, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), F.regexp_extract_all(F.lower(said), F.lit(f"({TERM})"), F.lit(1))))


def judged(candidates: DataFrame, task: str, ns: str, scope: str, moment: Column, most: int = 1_000_000) -> DataFrame:
    """A row a candidate id and line, with `copies`: `reason` is why it does not enter, null if it may. What agrees in all that
    a context shows is one line; two lines of one id are in conflict, and neither enters."""
    rows = candidates.withColumn("reason", reason(ns, scope, moment)).withColumns({
        "task_score": task_score(task, F.col("text"), F.col("task_tags")), "kind": F.lower(F.trim("kind")), "trust_state": F.lower(F.trim("trust_state")),
    })
    at = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at")
    payload = F.struct("candidate_id", "entity_ids", "episode_ids", "kind", at, "product_id", "record_ids", "task_score", "text", "trust_state")
    rows = rows.withColumn("line", F.concat(F.lit("ITEM|"), F.to_json(payload, {"ignoreNullFields": "false"})))
    # Ids hardly repeat: only those that do, found by the hash of the id, have lines to compare, and their rows alone meet.
    rows = materialize(rows.select("candidate_id", "kind", "trust_state", "occurred_at", "task_score", "reason", "line", F.xxhash64("candidate_id").alias("__id")), "lines")
    again = materialize(rows.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"), "repeated")
    few = again.limit(most + 1).count() <= most
    again = F.broadcast(again) if few else again.hint("merge")
    names = [c for c in rows.columns if c != "__id"]
    alone = rows.join(again, "__id", "left_anti").select(*names, F.lit(1).cast("long").alias("copies"))
    same = rows.join(again, "__id", "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    lines = same.where("reason is null").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    both = same.join(lines, "candidate_id", "left")
    both = both.withColumn("reason", F.when(F.col("lines") > 1, F.coalesce("reason", F.lit("conflicting_candidate_id"))).otherwise(F.col("reason"))).drop("lines")
    return alone.unionByName(both.select(alone.columns))


def rejected(rows: DataFrame) -> DataFrame:
    """(reason, n) of judged rows; further copies of a line that may enter are duplicates."""
    extra = rows.where("reason is null and copies > 1").select(F.lit("duplicate_candidate").alias("reason"), (F.col("copies") - 1).alias("n"))
    return rows.where("reason is not null").select("reason", F.col("copies").alias("n")).unionByName(extra).groupBy("reason").agg(F.sum("n").alias("n"))


def ranked(rows: DataFrame) -> DataFrame:
    """Judged rows that may enter, with their `key` in order: trust, terms of the task, latest first, kind, id."""
    trust = F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])[F.col("trust_state")]
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    key = F.struct((-trust).alias("trust"), (-F.col("task_score")).alias("task"), (-F.unix_micros("occurred_at")).alias("at"), place.alias("kind"), F.col("candidate_id").alias("id"))
    return rows.where("reason is null").withColumn("key", key)


def fitting(rows: DataFrame, room: int, taken: set[str], chunk: int, choose: Callable[[Row], None]) -> int:
    """Take each of rows(key, candidate_id, bytes) in order of key that still fits, as long as anything can; returns the room
    left. The rows come in chunks, each cut by heaps in the tasks to what could fit, so the driver holds one chunk."""
    last = None
    while True:
        some = rows.where(F.col("bytes") <= room)
        if last is not None:
            some = some.where(F.col("key") > F.struct(*[F.lit(x) for x in last]))
        got = some.orderBy("key").limit(chunk).collect()
        for r in got:
            if r.bytes <= room and r.candidate_id not in taken:
                taken.add(r.candidate_id)
                room -= r.bytes
                choose(r)
        if len(got) < chunk:
            return room
        last = got[-1].key


def assembled(rows: DataFrame, header: str, budget: int, reserve: int, chunk: int = 10_000) -> DataFrame:
    """(pos, candidate_id, line): the lines of a context of at most `budget` tokens, a token being four bytes, after its header.

    Facts come first, by rank, in the reserve; then all others and the facts left by rank, where they fit. A line is taken
    whole or not at all. A header that does not fit is refused."""
    size = len(header.encode())
    if -(-size // 4) > budget:
        raise ValueError("the budget is too small for the header")
    slim = materialize(ranked(rows).select("key", "candidate_id", "kind", "line", (F.octet_length("line") + 1).cast("long").alias("bytes")), "ranked")
    narrow = slim.select("key", "candidate_id", "kind", "bytes")
    chosen: list[tuple[int, str]] = []  # of lines that fit the budget
    taken: set[str] = set()
    take = lambda r: chosen.append((len(chosen), r.candidate_id))
    limit = min(4 * budget, 4 * min(budget, -(-size // 4) + min(reserve, budget - -(-size // 4))))
    left = fitting(narrow.where("kind = 'fact'"), limit - size, taken, chunk, take)
    fitting(narrow, 4 * budget - limit + left, taken, chunk, take)
    order = rows.sparkSession.createDataFrame(chosen, "pos int, candidate_id string")
    return slim.join(F.broadcast(order), "candidate_id").select("pos", "candidate_id", "line")
