"""Families of probes and their split, by hand."""

from collections import Counter

from memspark.operators import probes as pb


def made(spark, nodes, edges, links=(), trust=()):
    n = spark.createDataFrame(nodes, "id string, label string, source string, facets array<string>")
    e = spark.createDataFrame(edges, "id string, src string, predicate string, dst string, edge_kind string, source string")
    links = spark.createDataFrame(list(links), "node string, episode string, source string")
    return pb.generated(n, e, links, spark.createDataFrame(list(trust), "id string, state string"))


def test_seven_families(spark):
    nodes = [("a", "A", "ra", ["who", "then", "who"]), ("b", "B", None, ["who"]), ("c", "C", "rc", []), ("d", "D", "", None)]
    edges = [
        ("e1", "a", "causes", "b", "semantic", "r1"), ("e2", "b", "before", "c", "semantic", "r2"), ("e3", "a", "Refutes", "c", "semantic", "r3"), ("e4", "a", "refutes", "c", "semantic", "r4"),
        ("e5", "c", "knows", "a", "semantic", "r5"), ("e6", "a", "causes", "gone", "semantic", "r6"), ("e7", "d", "x", "d", "temporal", "r7"),
    ]
    found = made(spark, nodes, edges, [("b", "ep2", "q2"), ("b", "ep1", "q1"), ("zz", "ep1", "q1")], [("a", "unverified"), ("b", "supported"), ("zz", "unverified")]).collect()
    rows = {(r.motif, tuple(r.expected)): r for r in found}
    assert len(rows) == len(found) == len({r.case_id for r in found})
    assert set(rows) == {
        ("five_w_one_h_then", ("a",)), ("causal", ("a", "b")), ("temporal", ("b", "c")), ("contradiction", ("a", "c")), ("multi_hop", ("a", "b", "c")), ("multi_hop", ("b", "c", "a")), ("multi_hop", ("c", "a", "b")),
        ("provenance", ("b",)), ("unsupported", ("a",)), ("temporal", ("d",)),
    }
    assert rows["five_w_one_h_then", ("a",)].query == "Recover the who, then context for A"
    dispute = rows["contradiction", ("a", "c")]
    assert dispute.sources == ["r3"] and dispute.action == "surface_dispute" and dispute.query == "What does A Refutes with respect to C?"
    assert rows["multi_hop", ("a", "b", "c")].sources == ["r1", "r2"] and rows["provenance", ("b",)].episodes == ["ep1"] and rows["unsupported", ("a",)].action == "abstain_or_qualify"
    assert made(spark, [], []).collect() == []


def test_a_hub_adds_three_paths_an_edge(spark):
    n = 60
    nodes = [("hub", "H", "", []), *((f"{k}{i:02d}", "N", "", []) for k in "ab" for i in range(n))]
    edges = [(f"in{i:02d}", f"a{i:02d}", "knows", "hub", "semantic", "") for i in range(n)] + [(f"out{i:02d}", "hub", "knows", f"b{i:02d}", "semantic", "") for i in range(n)]
    rows = made(spark, nodes, edges).where("motif = 'multi_hop'").collect()
    assert len(rows) == 3 * n and {r.expected[2] for r in rows} == {"b00", "b01", "b02"}


def test_splits_are_disjoint_and_in_turn(spark):
    rows = [(f"c{m}{i}", m) for m, k in (("x", 23), ("y", 3), ("z", 1)) for i in range(k)]
    table = spark.createDataFrame(rows, "case_id string, motif string").repartition(3)
    found = pb.split(table, 6).collect()
    side = {s: Counter(r.motif for r in found if r.side == s) for s in ("dev", "holdout")}
    assert side == {"dev": {"x": 4, "y": 2}, "holdout": {"x": 4, "y": 1, "z": 1}}
    assert len({r.case_id for r in found}) == len(found)
    assert sorted(map(tuple, pb.split(table, 6).collect())) == sorted(map(tuple, found)) != sorted(map(tuple, pb.split(table, 6, seed=5).collect()))
    assert Counter(r.side for r in pb.split(table, 1000).collect()) == {"dev": 21, "holdout": 6}


def test_a_split_orders_only_what_a_side_may_take(spark, monkeypatch):
    from hashlib import sha256

    from pyspark.sql import DataFrame

    def refused(*_, **__):
        raise AssertionError("whole motifs were ordered")

    rows = [(f"c{m}{i}", m) for m, k in (("x", 3000), ("y", 40), ("z", 1)) for i in range(k)]
    table = spark.createDataFrame(rows, "case_id string, motif string").repartition(3)
    monkeypatch.setattr(type(table), "repartitionByRange", refused, raising=False)
    monkeypatch.setattr(DataFrame, "repartitionByRange", refused, raising=False)
    for sample in (6, 150):
        want = set()
        places = {}
        for m in "xyz":
            cases = sorted((c for c, of in rows if of == m), key=lambda c: sha256(f"1234:{c}".encode()).hexdigest())
            held = max(1, len(cases) // 5)
            for side, some in (("holdout", cases[:held]), ("dev", cases[held:])):
                places.setdefault(side, []).extend((turn, m, c) for turn, c in enumerate(some))
        for side, all_of in places.items():
            want |= {(c, m, side) for _, m, c in sorted(all_of)[:sample]}
        assert set(map(tuple, pb.split(table, sample).collect())) == want


def test_probes_meet_before_they_are_sorted(spark):
    found = made(spark, [("a", "A", "ra", ["who", "then"])], [])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning(motif" not in plan


def test_many_nodes_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Ids compress so well that the files of millions of nodes are small enough for Spark to gather them on the driver."""
    from memspark import scratch

    nodes = [(i, i.upper(), f"r{i}", ["who", "then"]) for i in "abc"]
    edges = [("e1", "a", "causes", "b", "semantic", "r1"), ("e2", "b", "before", "c", "semantic", "r2")]
    few = made(spark, nodes, edges, [("b", "ep1", "q1")], [("a", "unverified")])
    monkeypatch.setattr(scratch, "FEW", 2, raising=False)
    many = made(spark, nodes, edges, [("b", "ep1", "q1")], [("a", "unverified")])
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect())) and few.count() == 8
