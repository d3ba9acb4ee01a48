"""Contexts against brute force: supports, reasons, conflicts, the reserve, and budgets that chunks must not change."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.operators import context as cx

NOW = datetime(2024, 1, 10)


def row(i, kind="fact", text="some words", trust="verified", at=datetime(2024, 1, 1), records=("r1",), episodes=("e1",), ns="n", until=None, current=True, product=None, tags=()):
    return (i, kind, text, ns, "s", trust, at, until, current, list(records), list(episodes), [], product, list(tags))


def judged(spark, rows, task="a task"):
    return cx.judged(spark.createDataFrame(rows, cx.CANDIDATE), task, "n", "s", F.lit(NOW))


def test_every_support_must_be_current(spark):
    rows = spark.createDataFrame([row("a"), row("b", records=["r1", "r2"]), row("c", records=[]), row("d", records=["gone"]), row("d", records=["r2"])], cx.CANDIDATE)
    current = spark.createDataFrame([("r1",), ("r2",)], "id string")
    for most in (100_000, 0):
        assert sorted(r.candidate_id for r in cx.supported(rows, current, most).collect()) == ["a", "b", "c", "d"]
        assert sorted(r.candidate_id for r in cx.supported(rows, current.where("id = 'r1'"), most).collect()) == ["a", "c"]


def test_the_first_reason_counts(spark):
    rows = [
        row("ok"), row(" ", ns="other"), row("no text", text=None), row("no episode", episodes=[]), row("blank record", records=["r", " "]), row("place", ns="other", kind="note"), row("kind", kind="note", trust="x"),
        row("trust", trust="unverified", current=False), row("old", current=False, at=datetime(2025, 1, 1)), row("future", at=datetime(2025, 1, 1)), row("ended", until=NOW), row("derived", kind="observation"),
        row("fine", kind=" Observation ", product="p", trust="SUPPORTED"), row("twice"), row("twice"), row("differs"), row("differs", text="other words"),
    ]
    found = judged(spark, rows).collect()
    assert {r.candidate_id: r.reason for r in found} == {
        "ok": None, " ": "malformed", "no text": "malformed", "no episode": "malformed", "blank record": "malformed", "place": "boundary", "kind": "kind", "trust": "trust", "old": "not_current",
        "future": "time", "ended": "time", "derived": "derived_without_product", "fine": None, "twice": None, "differs": "conflicting_candidate_id",
    }
    counts = {r.reason: r.n for r in cx.rejected(judged(spark, rows)).collect()}
    assert counts["duplicate_candidate"] == 1 and counts["conflicting_candidate_id"] == 2 and counts["malformed"] == 4


def test_terms_are_words_of_any_script(spark):
    rows = [row("a", text="Über die Brücke_1"), row("b", tags=["ÜBER", "x"]), row("c", text="uber")]
    assert {r.candidate_id: r.task_score for r in judged(spark, rows, "über brücke_1 über").collect()} == {"a": 2, "b": 1, "c": 0}


def by_hand(rows, task, header, budget, reserve):
    terms = set(task.split())
    items = []
    for r in rows:
        score = len(terms & set(r[2].split()))
        line = {"candidate_id": r[0], "entity_ids": [], "episode_ids": r[10], "kind": r[1], "occurred_at": r[6].strftime("%Y-%m-%dT%H:%M:%SZ"), "product_id": r[12], "record_ids": r[9], "task_score": score, "text": r[2], "trust_state": r[5]}
        size = len(("\nITEM|" + json.dumps(line, separators=(",", ":"), ensure_ascii=False)).encode())
        items.append(((-{"verified": 2, "supported": 1}[r[5]], -score, -r[6].timestamp(), cx.KINDS.index(r[1]), r[0]), r[0], r[1], size))
    items.sort()
    used, out = len(header.encode()), []
    head = -(-used // 4)
    for limit, lane in ((min(budget, head + min(reserve, budget - head)), ("fact",)), (budget, cx.KINDS)):
        for _, name, kind, size in items:
            if kind in lane and name not in out and used + size <= 4 * limit:
                used += size
                out.append(name)
    return out


@pytest.mark.parametrize("chunk", [3, 1000])
def test_packs_as_by_hand(spark, chunk):
    draw = random.Random(chunk)
    rows = [
        row(f"c{i}", draw.choice(cx.KINDS[:3]), " ".join(draw.choices(["tea", "cup", "of", "ünï"], k=draw.randint(1, 40))), draw.choice(list(cx.TRUST)), datetime(2024, 1, draw.randint(1, 9)))
        for i in range(60)
    ]
    found = judged(spark, rows, "tea cup").cache()
    for budget, reserve in ((60, 0), (400, 200), (900, 5000), (100_000, 10)):
        got = [r.candidate_id for r in cx.assembled(found, "HEAD é", budget, reserve, chunk).orderBy("pos").collect()]
        assert got == by_hand(rows, "tea cup", "HEAD é", budget, reserve)
    with pytest.raises(ValueError):
        cx.assembled(found, "x" * 100, 20, 0)
    assert cx.assembled(found.limit(0), "x", 20, 0).collect() == []


def test_ids_that_stand_once_are_not_grouped(spark):
    rows = [row(f"c{i}") for i in range(6)] + [row("twice")] * 2 + [row("differs"), row("differs", text="other words"), row("bad", text=None), row("bad", text=None), row(None), row(None)]
    table = spark.createDataFrame(rows, cx.CANDIDATE)
    for most in (1_000_000, 0):
        found = cx.judged(table, "a task", "n", "s", F.lit(NOW), most)
        got = sorted((r.candidate_id or "", r.reason, r.copies) for r in found.collect())
        want = [("", "malformed", 2), ("bad", "malformed", 2), *[(f"c{i}", None, 1) for i in range(6)], *[("differs", "conflicting_candidate_id", 1)] * 2, ("twice", None, 2)]
        assert got == want


def test_what_is_written_between_steps_is_packed_well(spark):
    from memspark.scratch import materialize

    files = materialize(spark.range(100), "packed").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
