"""Edges of node texts, seeds, batches, merges, notation and language, by hand."""

import json

from pyspark.sql import functions as F

from memspark.functions import language as lg
from memspark.operators import evaluation as ev
from memspark.operators import fusion
from memspark.operators import grounding as gr
from memspark.operators import ingest as ig
from memspark.sources import compact


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_node_text_keeps_the_first_of_equal_parts(spark):
    props = F.create_map(*map(F.lit, ["b", "ADA", "a", "  ", "status", "asserted", "c", "Paris 7"]))
    assert one(spark, gr.node_text(F.lit("person"), F.lit(" Ada "), props)) == "person Ada Paris 7"


def test_stale_and_deleted_nodes_are_not_found(spark):
    node = "id string, kind string, label string, properties map<string,string>, status string"
    nodes = spark.createDataFrame([("a", "k", "A", {}, "asserted"), ("b", "k", "B", {}, "asserted"), ("c", "k", "C", {}, "deleted_soft")], node)
    text = F.when(F.col("id") == "b", "old").otherwise(gr.node_text(F.col("kind"), F.col("label"), F.col("properties")))
    index = nodes.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), gr.source_hash(text, "m").alias("source_hash"))
    assert [r.id for r in gr.nearest_nodes(nodes, index, [1.0, 0.0], "m", 5).collect()] == ["a"]
    assert gr.nearest_nodes(nodes, index, [1.0, 0.0], "other", 5).isEmpty()


def test_upserts_follow_the_last_real_write(spark):
    rows = [("n", 1, "first", 0.9, "d1", "d1", True), ("n", 2, "real", 0.2, "d2", "d2", False), ("n", 3, "later", 0.5, "d0", "d9", True), ("s", 1, "x", 0.1, "d5", "d5", True), ("s", 2, "y", 0.3, "d4", "d6", True)]
    w = spark.createDataFrame(rows, "id string, seq int, label string, confidence double, created_at string, updated_at string, synthetic boolean").withColumn("kind", F.lit("entity"))
    got = {r.id: (r.label, r.confidence, r.created_at, r.updated_at, r.synthetic) for r in gr.upserted(w).collect()}
    assert got == {"n": ("real", 0.5, "d2", "d2", False), "s": ("x", 0.3, "d4", "d6", True)}


def test_batches_by_key(spark):
    items = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("c", 1, "z"), ("c", 2, "z"), ("c", 3, "z")], "key string, item int, payload string")
    none = spark.createDataFrame([], "key string, digest string")
    first = {r.key: r for r in ig.plan_batches(items, none, 2).collect()}
    assert {k: r.state for k, r in first.items()} == {"a": "new", "b": "new", "c": "too_large"} and first["c"].digest is None
    stored = spark.createDataFrame([("a", first["a"].digest), ("b", "other")], "key string, digest string")
    assert {r.key: r.state for r in ig.plan_batches(items, stored, 2).collect()} == {"a": "replay", "b": "conflict", "c": "too_large"}


def test_namespaced_ids(spark):
    assert one(spark, ig.namespaced(F.lit("clm:a:b"), F.lit("d1"))) == "clm:d1:a:b" and one(spark, ig.namespaced(F.lit("x"), F.lit("d1"))) == "x:d1"


def test_merges_that_contradict_the_ledger(spark):
    ledger = spark.createDataFrame([("a", "b", "accepted"), ("b", "c", "accepted"), ("p", "q", "proposed"), ("s", "t", "split")], "canonical string, alias string, status string")
    asked = [("b", "a"), ("c", "a"), ("x", "c"), ("q", "p"), ("z", "z"), ("s", "t"), ("t", "s"), ("a", "b"), ("n", "m")]
    got = {(r.canonical, r.alias): (r.status, r.reason) for r in ig.classified_merges(spark.createDataFrame(asked, "canonical string, alias string"), ledger).collect()}
    assert got == {
        ("b", "a"): ("conflict", "reverse"), ("c", "a"): ("conflict", "cycle"), ("x", "c"): ("conflict", "absorbed"), ("q", "p"): ("conflict", "reverse"),
        ("z", "z"): ("refused", "self"), ("s", "t"): ("split", None), ("t", "s"): ("proposed", None), ("a", "b"): ("accepted", None), ("n", "m"): ("proposed", None),
    }


def test_outcomes_need_current_checks(spark):
    v = spark.createDataFrame([("v1", "r", "passed", None), ("v2", "r", "passed", "v1"), ("v3", "r", "failed", None), ("v4", "q", "passed", None)], "verification string, run string, verdict string, retry_of string")
    o = spark.createDataFrame([("ok", "r", "v2"), ("old", "r", "v1"), ("bad", "r", "v2"), ("bad", "r", "v3"), ("far", "r", "v4"), ("gone", "r", "v9"), ("none", "r", None)], "outcome string, run string, verification string")
    assert {r.outcome for r in ig.verified_outcomes(o, v).collect() if r.accepted} == {"ok"}


def test_compact_notation_comes_back_whole(spark, tmp_path):
    attrs = {"a": 'say "hi" [x]\n', "b": [1, {"c d": None}], "n": -2, "f": 0.5, "t": True, "w": "true", "e": "", "plain": "ent:x/y.z", "u": "größe = 1"}
    envelope = "id string, kind string, ns string, scope string, status string, conf double, t0 string, t1 string, prov array<string>, evidence array<string>, attrs string"
    rows = [("clm:1", "CLM", "my ns", "project", "deleted_soft", 0.25, "2024-01-01", None, ["raw:1", "raw:2"], ["span:1"], json.dumps(attrs)), ("ent:1", "ENT", "local.default", "project", "asserted", 1.0, None, None, [], [], "{}")]
    records = spark.createDataFrame(rows, envelope)
    lines = compact.encoded(records)
    assert [r.value for r in lines.where("id = 'ent:1'").collect()] == ["E ent:1"]
    back = {r.id: r for r in compact.decoded(lines.select("value")).collect()}
    assert json.loads(back["clm:1"].attrs) == attrs
    assert [tuple(back[r[0]])[:10] for r in rows] == [r[:10] for r in rows]
    bad = spark.createDataFrame([("Q x",), ("C",), ('C x a="open',), ("C x ~s=?",), ("# note",), ("",), ("!LX1 ns=a sc=b",)], "value string")
    assert [r.id for r in compact.decoded(bad).collect()] == [None] * 4
    (tmp_path / "f.txt").write_text(compact.header("a b", "team") + "\n\n# x\nX raw:1 content=hello\n")
    got = compact.read(spark, str(tmp_path / "f.txt")).first()
    assert (got.kind, got.ns, got.scope, json.loads(got.attrs)) == ("RAW", "a b", "team", {"content": "hello"})


def test_language(spark):
    intents = {"List what they probably own": "set-completion", "What kind of dog?": "inference", "When did it rain?": "direct", None: None}
    rows = spark.createDataFrame([(q,) for q in intents], "q string").select("q", lg.conversation_intent(F.col("q")).alias("i"), lg.conversation_intent(F.col("q"), wide=True).alias("w")).collect()
    assert {r.q: r.i for r in rows} == intents and {r.q: r.w for r in rows}["What kind of dog?"] == "set-completion"
    text = "The Ada Lovelace met Bob. And BOB met Ada  Lovelace in Paris"
    names = lg.proper_nouns(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("pos").collect()
    assert [r.name for r in names] == ["Ada Lovelace", "Bob", "Paris"]
    source = F.lit("The release\n tool (v1.2) works")
    assert one(spark, lg.grounded(F.lit("RELEASE tool"), source)) == "release\n tool" and one(spark, lg.grounded(F.lit("v1.2"), source)) == "v1.2"
    assert all(one(spark, lg.grounded(F.lit(v), source)) is None for v in ("tool release", "releas", " ", "v1x2")) and one(spark, lg.grounded(F.lit(None).cast("string"), source)) is None


def test_places_and_percentiles_of_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", i, float(i % 3)) for i in range(50)] + [("b", 99, 7.0)], "g string, id int, v double").repartition(7)
    placed = fusion.placed(rows, F.desc("v"), "id").orderBy("rank").collect()
    assert [r.rank for r in placed] == list(range(1, 52)) and [(r.v, r.id) for r in placed] == sorted(((r.v, r.id) for r in placed), key=lambda x: (-x[0], x[1]))
    assert {r.g: r.value for r in ev.percentile_of(rows, "v", 0.5, "g").collect()} == {"a": 1.0, "b": 7.0}
    assert ev.percentile_of(rows.where("false"), "v", 0.5).isEmpty()


def test_compact_fields_are_read_without_a_decoder_where_they_can_be(monkeypatch):
    line = 'a=b c="d e" f=1 g=-2.5 h=null  i="x\\"=y" j=[1,"k l"] m n= o={"p":"q r"}z=1e3 ~@raw:1 nan=nan u=inf_x t="" '
    got = list(compact.fields(line))
    assert [x for x in got if x[0] != "nan"] == [
        ("a", "b"), ("c", "d e"), ("f", 1), ("g", -2.5), ("h", None), ("i", 'x"=y'), ("j", [1, "k l"]), ("m", None), ("n", ""), ("o", {"p": "q r"}), ("z", 1000.0), ("~@raw:1", None), ("u", "inf_x"), ("t", ""),
    ]
    assert dict(got)["nan"] != dict(got)["nan"]
    monkeypatch.setattr(compact, "held", None)  # plain lines need none
    assert dict(compact.fields('t0="1995-03-04" subject=cust:1 predicate="5-low" n=7')) == {"t0": "1995-03-04", "subject": "cust:1", "predicate": "5-low", "n": 7}


def test_compact_claims_are_read_in_one_scan(spark, data):
    from memspark.catalogue.ingest import compact_lines

    assert "Join" not in compact_lines(spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_outcomes_without_checks_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ig, "CHECKS", 10)
    v = spark.range(100).select(F.concat(F.lit("v"), "id").alias("verification"), F.lit(1).alias("run"), F.lit("passed").alias("verdict"), F.lit(None).cast("string").alias("retry_of"))
    o = spark.range(2000).select(F.col("id").alias("outcome"), F.lit(1).alias("run"), F.when(F.col("id") < 100, F.concat(F.lit("v"), "id")).alias("verification"))
    got = ig.verified_outcomes(o, v)
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    tasks = got.withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert tasks.count() == 10
    assert (got.where("accepted").count(), got.where("checks = 0 and not accepted").count()) == (100, 1900)
