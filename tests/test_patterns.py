"""Each of the four causes alone invalidates a pattern."""

import hashlib

from memspark.operators import patterns as pt

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
PATTERN = "pattern string, run string, outcome string, ns string, scope string, verifications array<string>, evidence map<string,string>, knowledge array<string>"


def held(spark, statuses, verifications, records, nodes, patterns=None):
    patterns = patterns or [("p", "r", "o", "n", "s", ["v1", "v2", "v1"], {"e1": sha("one"), "e2": sha("two")}, ["k1"])]
    found = pt.validity(
        spark.createDataFrame(patterns, PATTERN), spark.createDataFrame(statuses, "outcome string, seq int, status string"), spark.createDataFrame(verifications, "id string, run string, current boolean"),
        spark.createDataFrame(records, "id string, ns string, scope string, payload string"), spark.createDataFrame(nodes, "id string, ns string, scope string, status string"),
    ).collect()
    return {r.pattern: (r.valid, r.cause, r.what) for r in found}


def test_causes_alone_and_together(spark):
    statuses = [("o", 1, "open"), ("o", 2, "accepted")]
    verified, records, nodes = [("v1", "r", True), ("v2", "r", True)], [("e1", "n", "s", "one"), ("e2", "n", "s", "two")], [("k1", "n", "s", "asserted")]
    check = lambda s=statuses, v=verified, r=records, n=nodes: held(spark, s, v, r, n)["p"]
    assert check() == (True, None, None)
    assert check(s=[*statuses, ("o", 3, "rejected")]) == (False, "outcome", "o") == check(s=[])
    assert check(v=[("v1", "r", True), ("v2", "r", False)]) == (False, "verification", "v2") == check(v=verified[:1]) == check(v=[("v1", "r", True), ("v2", "other", True)])
    for changed in ([records[0], ("e2", "n", "s", "TWO")], [records[0], ("e2", "m", "s", "two")], records[:1], [records[0], ("e2", "n", "s", None)]):
        assert check(r=changed) == (False, "evidence", "e2")
    for changed in ([("k1", "n", "s", "stale")], [("k1", "n", "t", "asserted")], [], [("k1", "n", "s", None)]):
        assert check(n=changed) == (False, "knowledge", "k1")
    assert check(v=[], n=[]) == (False, "verification", "v1")  # the first cause, the least id


def test_patterns_that_name_nothing(spark):
    rows = [("empty", "r", "o", "n", "s", [], {}, []), ("null", "r", "o", "n", "s", None, None, None), ("none", "r", None, "n", "s", [], {}, [])]
    assert held(spark, [("o", 1, "accepted")], [], [], [], rows) == {"empty": (True, None, None), "null": (True, None, None), "none": (False, "outcome", None)}


def test_uses_and_disagreements(spark):
    uses = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "use int, pattern string")
    results, later = (spark.createDataFrame(x, "use int, succeeded boolean") for x in ([(1, True), (2, False)], [(1, False), (1, True), (9, True)]))
    found = {r.pattern: tuple(r)[1:] for r in pt.use_counts(uses, results, later).collect()}
    assert found == {"a": (3, 2, 2, 2), "b": (1, 0, 0, 0)}
