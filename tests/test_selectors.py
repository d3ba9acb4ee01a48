"""Matching, event groups, deletes and packs against small references."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import mutations as mu
from memspark.operators import projections as pr
from memspark.operators import selectors as se


@pytest.mark.parametrize("seed", range(8))
def test_matching_is_maximum(seed):
    draw = random.Random(seed)
    edges = [(f"s{draw.randrange(5)}", f"t{draw.randrange(5)}") for _ in range(draw.randrange(1, 12))]
    best = max(n for n in range(6) for pick in itertools.combinations(set(edges), min(n, len(set(edges)))) if len({a for a, _ in pick}) == len({b for _, b in pick}) == len(pick) for n in [len(pick)])
    assert se.matching(edges) == best


def test_sources_need_distinct_seeds_for_their_tokens(spark):
    rows = [("r1", "s1", "a"), ("r1", "s1", "b"), ("r2", "s1", "a"), ("r2", "s2", "b"), ("r2", "s2", "b"), ("r3", "s1", "a")]
    found = se.agreeing_sources(spark.createDataFrame(rows, "raw string, seed string, token string"), 2)
    assert [tuple(r) for r in found.collect()] == [("r2", 2, 2)]


def test_a_source_is_no_group_of_its_own(spark):
    edges = [(f"s{i}", t) for i in range(4) for t in "abc"] + [("s9", "d")]
    rows = [(r, s, t) for r in range(500) for s, t in random.Random(r).sample(edges, r % 9 + 1)]
    found = se.agreeing_sources(spark.createDataFrame(rows, "raw int, seed string, token string").repartition(5), 2)
    assert "GroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r, s, t in rows:
        by.setdefault(r, set()).add((s, t))
    assert {tuple(r) for r in found.collect()} == {(r, n, len(e)) for r, e in by.items() if (n := se.matching(list(e))) >= 2}


def test_events_group_in_order_of_time(spark):
    rows = [("q", 1, 1, "d1", None, ["a", "b"]), ("q", 2, 2, "d1", None, ["b"]), ("q", 3, 3, "d2", None, ["a", "b"]), ("q", 4, 4, "d3", 2, ["x"]), ("q", 5, 5, "d4", 2, ["y"]), ("q", 6, 6, "d3", 3, ["x"]), ("p", 7, 1, None, None, None)]
    df = spark.createDataFrame(rows, "question string, id long, at long, day string, ordinal int, tokens array<string>")
    for shuffled in (df, df.orderBy(F.desc("id"))):
        assert {r.id: r.event for r in se.same_events(shuffled).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_day_events_are_as_in_order_of_time(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["p", "q", None]), i, draw.choice(["d1", "d2", None]), draw.choice("ab")) for i in range(80)]
    df = spark.createDataFrame(rows, "question string, id long, day string, token string")
    old = se.same_events(df.withColumns({"at": -F.col("id"), "ordinal": F.lit(None).cast("int"), "tokens": F.array("token")}))
    assert sorted(map(str, se.same_day_events(df).collect())) == sorted(map(str, old.collect()))


def test_same_event_groups_holds_no_log_in_a_task(spark, data):
    from memspark.catalogue.extended import same_event_groups

    assert "InArrow" not in same_event_groups(spark, data)._jdf.queryExecution().toString()


def test_soft_delete_refuses_and_repeats(spark):
    stored = spark.createDataFrame([("a", "n", "s", 1, "asserted"), ("b", "n", "s", 2, "asserted")], "id string, ns string, scope string, generation int, status string")
    target = lambda *rows: spark.createDataFrame(rows, "id string, ns string, scope string, generation int")
    once = mu.soft_delete(stored, target(("a", "n", "s", 1)))
    assert {r.id: r.status for r in once.collect()} == {"a": "deleted_soft", "b": "asserted"}
    assert sorted(map(tuple, mu.soft_delete(once, target(("a", "n", "s", 1))).collect())) == sorted(map(tuple, once.collect()))
    for bad in (("zz", "n", "s", 1), ("a", "other", "s", 1), ("b", "n", "s", 1)):
        with pytest.raises(ValueError):
            mu.soft_delete(stored, target(bad))


def test_terms_refuse_stop_words_and_long_labels(spark):
    nodes = spark.createDataFrame([("1", "The Of"), ("2", "The Big-Blue big"), ("3", "one two three four five"), ("4", None)], "id string, label string")
    found = sorted(map(tuple, se.terms(nodes, F.col("label")).collect()))
    assert found == [("2", "big"), ("2", "blue"), ("2", "the")]


def test_labels_and_vector_texts(spark):
    rows = [("r", "RAW", {"content": "text"}), ("e", "ENT", {"label": "Ann"}), ("c", "CLM", {"subject": "e", "predicate": "is", "object": None}), ("m", "META", {"z": "1", "a": "2"})]
    df = spark.createDataFrame(rows, "id string, kind string, attrs map<string,string>")
    assert {r[0]: (r[1], r[2]) for r in df.select("id", pr.label(limit=4), pr.vector_text()).collect()} == {"r": ("text", "text"), "e": ("Ann", "Ann"), "c": ("e is", "CLM is e"), "m": ("m", "META 2 1")}


def test_ratchet_fails_on_missing_categories(spark):
    made = lambda rows: spark.createDataFrame(rows, "category string, metric double")
    base = made([("a", 0.5), ("b", 0.5)])
    assert tuple(mu.ratchet(made([("a", 0.9), ("b", 0.5)]), base, 0.1, 0.0).first()) == (0.2, True, True)
    assert mu.ratchet(made([("a", 0.9)]), base, 0.1, 0.0).first().accepted is False
    assert mu.ratchet(made([("a", 1.9), ("b", 0.4)]), base, 0.1, 0.05).first().accepted is False
