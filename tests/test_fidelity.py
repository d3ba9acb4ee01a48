"""Probes, splices and retention on small cases."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import fidelity as fi
from memspark.operators import graph
from memspark.plans import query as pq


def test_cloze_masks_digits_then_capitals_then_the_longest(spark):
    df = spark.createDataFrame([(1, "Ann paid 30 coins"), (2, "then Bob left"), (3, "a longest word"), (4, "  .. "), (5, None)], "id int, content string")
    found = {r.id: (r.answer, r.probe) for r in fi.cloze(df, 1).collect()}
    assert found == {1: ("30", "Ann paid ____ coins"), 2: ("Bob", "then ____ left"), 3: ("longest", "a ____ word")}


def test_splice_keeps_facts_apart(spark):
    rows = spark.createDataFrame([("q", f"r{i:02}", i) for i in range(1, 13)], "q string, id string, rank int")
    facts = spark.createDataFrame([("q", f"f{i}", i) for i in range(1, 6)], "q string, id string, rank int")
    found = [r.id for r in fi.spliced(rows, facts, 10).orderBy("place").collect()]
    assert found == ["r01", "r02", "r03", "r04", "f1", "r05", "r06", "r07", "r08", "f2"]


def test_retention_of_nothing_is_whole(spark):
    empty = spark.createDataFrame([], "case int, subject string, relation string, object string")
    assert tuple(fi.retention(empty, empty).first()) == (0, 1.0)
    one = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "c")], empty.schema)
    assert tuple(fi.retention(one, spark.createDataFrame([(1, "a", "b", "x")], empty.schema)).first()) == (2, pytest.approx(1 / 3, abs=1e-6))
    none = spark.createDataFrame([], "required array<string>, recovered array<string>")
    assert tuple(fi.reconstruction(none).first()) == (0, 1.0)


def test_symbols_expand_in_their_ancestry():
    symbols = [("a", "ctx", "context", 0.0), ("a.b", "db", "database", 0.34), ("a.c", "x", "other", 0.0), ("a", "amb", "ambiguous", 0.5)]
    assert pq.expand_symbols("the ctx db x amb ctx2", symbols, "a.b") == "the context database x amb ctx2"


def test_families(spark):
    df = spark.createDataFrame([(" Causes ",), ("supersedes",), ("who",), ("likes",), (None,)], "predicate string")
    assert [r[0] for r in df.select(graph.family(F.col("predicate"))).collect()] == ["causal", "temporal", "facet", "semantic", "semantic"]
