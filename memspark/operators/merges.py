"""A ledger of identity merges, replayed in order: what a decision does depends on those before it that touch its nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.scratch import materialize

from . import graph

OPERATION = "seq long, op string, ns string, scope string, canonical string, alias string"
MERGE = "ns string, scope string, canonical string, alias string, status string, reason string"
ACTIVE, KEPT = ("proposed", "accepted"), ("accepted", "split")
STEPS = 64  # merges that are followed, as in `knowledge.canonical`


class Ledger:
    """The merges of one boundary. Each accepted merge is looked up by its alias; of several, the least canonical counts."""

    def __init__(self, merges: dict[tuple[str, str], tuple[str, str | None]]):
        self.merges = merges
        self.into: dict[str, list[str]] = {}
        for (canonical, alias), (status, _) in merges.items():
            if status == "accepted":
                self.into.setdefault(alias, []).append(canonical)

    def refusal(self, canonical: str, alias: str, own: bool) -> str | None:
        """Why a merge may not be active; `own`: the merge itself is being decided and does not stand in its own way."""
        if self.merges.get((alias, canonical), ("",))[0] in ACTIVE:
            return "reverse"
        taken = [c for c in self.into.get(alias, ()) if not (own and c == canonical)]
        if taken and min(taken) != canonical:
            return "absorbed"
        node, seen = canonical, {canonical}
        for _ in range(STEPS):
            above = self.into.get(node)
            if not above or own and (min(above), node) == (canonical, alias):
                return None
            node = min(above)
            if node == alias:
                return "cycle"
            if node in seen:
                return None
            seen.add(node)
        return None

    def put(self, canonical: str, alias: str, status: str, reason: str | None) -> tuple[str, str | None]:
        before = self.merges.get((canonical, alias), ("",))[0]
        if before == "accepted" and status != "accepted":
            self.into[alias].remove(canonical)
        if status == "accepted" and before != "accepted":
            self.into.setdefault(alias, []).append(canonical)
        self.merges[canonical, alias] = (status, reason)
        return status, reason

    def apply(self, op: str, canonical: str | None, alias: str | None) -> tuple[str, str | None]:
        """What becomes of a decision: the merge's status after it, or refused, and why."""
        if not canonical or not alias:
            return "refused", "blank"
        if canonical == alias:
            return "refused", "self"
        held = self.merges.get((canonical, alias))
        if op == "propose":
            if held and held[0] in KEPT:
                return held
            why = self.refusal(canonical, alias, False)
            return self.put(canonical, alias, "conflict" if why else "proposed", why)
        if held is None or op not in ("accept", "split"):
            return "refused", "unknown"
        if op == "split":
            return self.put(canonical, alias, "split", None)
        if held[0] == "accepted":
            return held
        if held[0] == "split":
            return "refused", "split"
        why = self.refusal(canonical, alias, True)
        return self.put(canonical, alias, "conflict" if why else "accepted", why)


def replayed(operations: DataFrame, ledger: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(operations with status and reason, the ledger after them) of operations in order of seq on a ledger: see OPERATION
    and MERGE; seq is one number an operation.

    propose stores a merge as proposed, or as a conflict if its reverse is active, its alias is absorbed by another node, or
    it would close a circle; what was accepted or split stays. accept judges anew and accepts or finds a conflict; split
    undoes a merge and keeps its row. Only decisions that share nodes matter to each other, so each connected component of a
    boundary's merges, old and new, is replayed by itself; one of over `most` rows is refused, as its order is one chain.
    Merges that no operation's component touches stay as they are."""
    names = [x.strip().split(" ")[0] for x in OPERATION.split(",")]
    trimmed = [F.trim(c).alias(c) if c in ("canonical", "alias") else F.col(c) for c in names]
    ops = materialize(operations.select(*trimmed), "operations")
    held = ledger.select([x.strip().split(" ")[0] for x in MERGE.split(",")])
    place = lambda c: F.concat_ws("\x1f", "ns", "scope", F.coalesce(c, F.lit("")))
    ends = ops.select(place("canonical").alias("src"), place("alias").alias("dst")).unionByName(held.select(place("canonical").alias("src"), place("alias").alias("dst")))
    parts = materialize(graph.components(ends.distinct()), "components")
    rows = ops.withColumns({"status": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    rows = rows.unionByName(held.withColumns({"seq": F.lit(None).cast("long"), "op": F.lit(None).cast("string")}))
    rows = materialize(rows.withColumn("id", place("canonical")).join(parts, "id").drop("id"), "dealt")
    largest = rows.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} merges are connected; replay is bounded at {most}")
    columns = [*names, "status", "reason"]

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        text = lambda x: None if pd.isna(x) else x
        old, new = group[group.op.isna()], group[group.op.notna()].sort_values("seq")
        state = Ledger({(r.canonical, r.alias): (r.status, text(r.reason)) for r in old.itertuples()})
        ns, scope = group.ns.iloc[0], group.scope.iloc[0]
        out = [(r.seq, r.op, ns, scope, r.canonical, r.alias, *state.apply(r.op, text(r.canonical), text(r.alias))) for r in new.itertuples()]
        out += [(None, None, ns, scope, c, a, *m) for (c, a), m in state.merges.items()]
        return pd.DataFrame(out, columns=columns)

    done = rows.groupBy("component").applyInPandas(replay, OPERATION + ", status string, reason string")
    done = materialize(done, "replayed")
    return done.where("op is not null"), done.where("op is null").drop("seq", "op")
