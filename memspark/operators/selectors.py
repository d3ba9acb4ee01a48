"""Term index, source selection by matching, event grouping: what no chain of joins expresses runs in small groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def terms(nodes: DataFrame, label: Column, longest: int = 4, stop: tuple[str, ...] = ("the", "a", "an", "of", "and")) -> DataFrame:
    """(node, token) of each label: lower-cased words; a label of stop words alone, or of too many words, gives none."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    real = F.filter(words, lambda w: ~w.isin(*stop))
    kept = F.when((F.size(real) > 0) & (F.size(words) <= longest), F.array_distinct(words))
    return nodes.select(F.col("id").alias("node"), F.explode(kept).alias("token"))


def matching(edges: list[tuple[str, str]]) -> int:
    """Size of a maximum matching of seeds to tokens, by augmenting paths."""
    by: dict[str, list[str]] = {}
    for seed, token in sorted(set(edges)):
        by.setdefault(seed, []).append(token)
    held: dict[str, str] = {}

    def place(seed: str, tried: set[str]) -> bool:
        for token in by[seed]:
            if token not in tried:
                tried.add(token)
                if token not in held or place(held[token], tried):
                    held[token] = seed
                    return True
        return False

    return sum(place(seed, set()) for seed in sorted(by))


@arrow_udf(T.LongType())
def agreement(pairs: pa.Array) -> pa.Array:
    """Size of a maximum matching of each list of struct(seed, token)."""
    return pa.array([matching([(p["seed"], p["token"]) for p in some]) for some in pairs.to_pylist()], pa.int64())


def agreeing_sources(support: DataFrame, least: int) -> DataFrame:
    """support(raw, seed, token) to (raw, agreement, edges): sources of which a maximum matching pairs `least` or more
    seeds with query tokens. A source's seeds for one query are one row, as small as the query is; rows are matched in
    Arrow batches, so that a source costs no group of its own, and those of fewer pairs, seeds or tokens are not matched."""
    pairs = support.select("raw", F.struct("seed", "token").alias("pair")).groupBy("raw").agg(F.collect_set("pair").alias("pairs"))
    names = lambda n: F.size(F.array_distinct(F.col(f"pairs.{n}")))
    enough = pairs.where((F.size("pairs") >= least) & (names("seed") >= least) & (names("token") >= least))
    found = enough.select("raw", agreement("pairs").alias("agreement"), F.size("pairs").cast("long").alias("edges"))
    return found.where(F.col("agreement") >= least)


def group_events(rows: list[tuple], likeness: float, anchors: int) -> list[int]:
    """rows(id, day, ordinal, tokens) in order of time: each joins the first group with a member of its day, its
    ordinal, or alike by Jaccard with enough shared tokens, else begins one."""
    groups: list[list[tuple]] = []
    out = []
    for row in rows:
        _, day, ordinal, tokens = row
        for k, members in enumerate(groups):
            if any(same(day, ordinal, set(tokens or ()), m, likeness, anchors) for m in members):
                break
        else:
            k = len(groups)
            groups.append([])
        groups[k].append(row)
        out.append(k)
    return out


def same(day, ordinal, tokens: set, member: tuple, likeness: float, anchors: int) -> bool:
    _, other_day, other_ordinal, other_tokens = member
    other = set(other_tokens or ())
    shared = len(tokens & other)
    if ordinal is not None and other_ordinal is not None:
        return ordinal == other_ordinal
    return day is not None and day == other_day and shared >= 1 or shared >= anchors and shared / len(tokens | other) >= likeness


def same_events(rows: DataFrame, likeness: float = 0.72, anchors: int = 2) -> DataFrame:
    """rows(question, id, at, day, ordinal, tokens) with `event`, the least id of the group. For rows that a retriever
    has cut at a limit a question: each question is one group in one task, quadratic in its rows. Whole logs go to
    same_day_events."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        cells = list(zip(*(table.column(c).to_pylist() for c in ("id", "day", "ordinal", "tokens")), strict=True))
        found = group_events(cells, likeness, anchors)
        first: dict[int, object] = {}
        for k, cell in zip(found, cells, strict=True):
            first[k] = min(first.get(k, cell[0]), cell[0])
        return pa.table({"question": table.column("question"), "id": table.column("id"), "event": [first[k] for k in found]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("question", "id", "at", "day", "ordinal", "tokens").groupBy("question").applyInArrow(run, f"question {kinds['question']}, id {kinds['id']}, event {kinds['id']}")


def same_day_events(rows: DataFrame) -> DataFrame:
    """rows(question, id, day, token) with `event`: what same_events gives for rows of one token and no ordinal. Those of
    a question, day and token are one event, named by its least id; a row without a day is its own."""
    least = rows.where("day is not null").groupBy("question", "day", "token").agg(F.min("id").alias("least"))
    r, e = rows.alias("r"), least.alias("e")
    same_key = F.col("r.question").eqNullSafe(F.col("e.question")) & (F.col("r.day") == F.col("e.day")) & (F.col("r.token") == F.col("e.token"))
    return r.join(e, same_key, "left").select("r.question", "r.id", F.coalesce("e.least", "r.id").alias("event"))
