"""Traps of the semantics, one small case each."""

import math
import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.functions import temporal as tm
from memspark.functions import text as tx
from memspark.functions import vectors as vx
from memspark.operators import evaluation, fusion, graph, knowledge, lexical, ledger, records, vectors
from memspark.plans import query as pq
from memspark.sources import records as rs


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, content string")


def test_tokens_overlap_and_substrings_differ(spark):
    t = texts(spark, "the party at 9:00", "art", None, "Art ART art")
    c = F.col("content")
    assert rows(t.select("id", F.array_join(tx.tokens(c), " ").alias("t"))) == [(0, "the party at 9:00"), (1, "art"), (2, ""), (3, "art art art")]
    assert rows(lexical.overlap(t, "art art", c), "id", "score") == [(1, 1.0), (3, 1.0)]
    assert rows(lexical.substring_leg(t, "art", c).where("hits > 0"), "id", "hits") == [(0, 1), (1, 1), (3, 1)]
    assert rows(t.select(tx.overlap("", c))) == [(0.0,)] * 4


def bm25_of(texts, query):
    docs = [t.lower().split() for t in texts]
    held = [d for d in docs if d]
    mean = sum(map(len, held)) / len(held)
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for q in query.split():
            df = sum(q in h for h in held)
            if q in d:
                idf = math.log(1 + (len(held) - df + 0.5) / (df + 0.5))
                s += idf * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / mean))
        if s > 0:
            out[i] = s
    return out


def test_bm25_counts_repeated_terms_and_skips_empty_texts(spark):
    values = ["a b c", "a a b", "", "c", "d d d d"]
    found = {r.id: r.score for r in lexical.bm25(texts(spark, *values), "a a absent", F.col("content")).collect()}
    assert found == pytest.approx(bm25_of(values, "a a absent"))
    kept = lexical.bm25(texts(spark, *values), "a c", F.col("content"), candidates=F.col("id") > 0)
    assert {r.id: r.score for r in kept.collect()} == pytest.approx({k: v for k, v in bm25_of(values, "a c").items() if k > 0})


def test_bag_cosine_counts(spark):
    found = {r.id: r.score for r in lexical.bag_cosine(texts(spark, "a a b", "b", "c"), "a b", F.col("content")).collect()}
    assert found == pytest.approx({0: 3 / math.sqrt(10), 1: 1 / math.sqrt(2)})


@pytest.mark.parametrize("structured,boundary,hits,explicit,passes", [(0.8, 0.8, 0, False, False), (0.8, 0.8, 0, True, True), (1.0, 0.0, 0, False, True), (0.0, 0.0, 1, False, True), (0.4, 0.4, 0, True, False)])
def test_gate(spark, structured, boundary, hits, explicit, passes):
    ok = spark.range(1).select(lexical.gate(F.lit(structured), F.lit(boundary), F.lit(hits), True, explicit))
    assert rows(ok) == [(passes,)]


def test_fusion_dedupes_by_best_score_and_keeps_weight_zero(spark):
    hits = spark.createDataFrame([("a", "x", 0.1), ("a", "x", 0.9), ("a", "y", 0.5), ("b", "z", 1.0), ("b", "y", 1.0)], "leg string, id string, score double")
    assert rows(fusion.reciprocal(hits), "id", "legs") == [("x", "a"), ("y", "a,b"), ("z", "b")]
    got = {r.id: r.score for r in fusion.reciprocal(hits, {"a": 0.0, "b": 1.0}).collect()}
    assert got == pytest.approx({"x": 0.0, "y": 1 / 61, "z": 1 / 62})


def test_time_forms(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "2024-01-02T03:04:05", " ", "soon", None]
    shown = [r[1] for r in rows(texts(spark, *values).select("id", tm.key(tm.instant(F.col("content")))))]
    assert shown == ["2024-01-02T03:04:05.000000Z"] * 3 + [None] * 3


def test_validity_includes_its_start_excludes_its_end_and_fails_closed(spark):
    t = datetime(2024, 1, 1)
    cases = [(t, None, True, True), (t, t, False, False), (datetime(2024, 1, 2), None, True, False), (t, None, False, False), (None, None, True, False)]
    df = spark.createDataFrame([(a, b, m) for a, b, m, _ in cases], "a timestamp, b timestamp, m boolean")
    found = [r[0] for r in df.select(tm.visible_at(F.col("a"), F.col("b"), F.col("m"), F.lit(t))).collect()]
    assert found == [x for *_, x in cases]


def test_months_have_thirty_days(spark):
    anchor, text = F.lit(datetime(2024, 3, 31)), F.col("value")
    of = lambda value, what: spark.createDataFrame([(value,)], "value string").select(what).first()[0]
    assert of("2 months ago", tm.reference_instant(text, anchor)) == datetime(2024, 1, 31)
    assert of("next year", tm.relative_days(text)) == 365 and of("some day", tm.relative_days(text)) is None
    assert of("2024-01-02T00:00:00+02:00", tm.reference_instant(text, anchor)) == datetime(2024, 1, 1, 22)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [])], "id int, embedding array<double>")
    assert rows(vectors.issues(df, 2), "id", "issue") == [(1, None), (2, "zero"), (3, "dimension"), (4, "missing"), (5, "nonfinite"), (6, "dimension")]
    assert [r[0] for r in df.where("id in (1, 2, 3, 6)").orderBy("id").select(vx.cosine(F.col("embedding"), vx.literal([2.0, 0.0]))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert sum(x * x for x in vectors.hash_embed(["a", "b"])) == pytest.approx(1.0) and vectors.hash_embed([]) == [0.0] * 64


@pytest.mark.parametrize("seed", range(3))
def test_activation_is_the_best_path(spark, seed):
    draw = random.Random(seed)
    names = "abcdefgh"
    edges = [(*draw.sample(names, 2), round(draw.uniform(-0.2, 1.2), 2)) for _ in range(12)]
    best = {"a": (1.0, 0)}
    near = defaultdict(list)
    for s, d, c in edges:
        near[s].append((d, c)), near[d].append((s, c))
    frontier = [("a", 1.0)]
    for hop in (1, 2):
        frontier = [(v, x * 0.72 * min(1.0, max(0.0, c))) for u, x in frontier for v, c in near[u]]
        for v, x in frontier:
            if x > best.get(v, (0.0, 0))[0]:
                best[v] = (x, hop)
    df = spark.createDataFrame(edges, "src string, dst string, confidence double")
    found = graph.activation(df, spark.createDataFrame([("a", 1.0)], "id string, score double")).collect()
    assert {r.id: (round(r.activation, 9), r.hop) for r in found} == {k: (round(x, 9), h) for k, (x, h) in best.items() if x > 0}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60) if i != 30], "src string, dst string")
    found = dict(map(tuple, graph.components(edges).collect()))
    assert {v for k, v in found.items() if k <= "n030"} == {"n000"} and {v for k, v in found.items() if k > "n030"} == {"n031"}


def test_trust_precedence(spark):
    claims = [(n, "asserted") for n in ("verified", "supported", "unverified", "refuted", "contested", "stale", "challenged", "same")] + [("old", "superseded"), ("guess", "hypothetical")]
    ev = [("verified", "k1", True, True), ("verified", "k2", True, True), ("supported", "k1", True, True), ("supported", "k2", False, True), ("same", "k1", True, True), ("same", "k1", True, True)]
    ev += [(n, k, True, n != "stale") for n in ("refuted", "contested", "stale", "challenged", "old", "guess") for k in ("k1", "k2")]
    raised = [("refuted", "refuted"), ("refuted", "contested"), ("contested", "contested"), ("challenged", "superseded"), ("challenged", "refuted")]
    found = knowledge.trust(
        spark.createDataFrame(claims, "id string, status string"), spark.createDataFrame(ev, "id string, key string, independent boolean, active boolean"), spark.createDataFrame(raised, "id string, kind string")
    )
    assert {r.id: r.state for r in found.collect()} == {
        "verified": "verified", "supported": "supported", "unverified": "unverified", "refuted": "refuted", "contested": "contested", "stale": "stale",
        "challenged": "superseded", "same": "supported", "old": "superseded", "guess": "unverified",
    }


def test_reconcile_never_supersedes_on_equal_or_missing_times(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    made = [("s1", "1", '"1"', t1), ("s1", "2", "1", t2), ("s2", "3", "x", t1), ("s2", "4", "y", t1), ("s3", "5", "x", None), ("s3", "6", "y", None), ("s4", "7", "x", t1), ("s4", "8", "x", t2), ("s5", "9", "x", t1)]
    df = spark.createDataFrame([("n", "p", s, "is", i, o, t, 1.0, "functional") for s, i, o, t in made], "ns string, scope string, subject string, predicate string, id string, object string, t0 timestamp, conf double, cardinality string")
    found = {r.id: r.relation for r in knowledge.reconcile(df).collect()}
    assert found == {"1": "superseded", "2": "winner", "3": "contradicted", "4": "winner", "5": "contradicted", "6": "winner", "7": "duplicate", "8": "winner"}


def test_canonical_follows_chains_and_bounds_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "node string, into string")
    found = dict(map(tuple, knowledge.canonical(df).collect()))
    assert [found[k] for k in "abc"] == ["d"] * 3 and set(found) == set("abcxy")


def test_provenance_defects(spark):
    recs = spark.createDataFrame([("none", []), ("gone", ["s0"]), ("rel", ["s1"]), ("noraw", ["s2"]), ("lost", ["s3"]), ("notraw", ["s4"]), ("empty", ["s5"]), ("long", ["s6"]), ("good", ["s7"])], "id string, evidence array<string>")
    spans = spark.createDataFrame(
        [("s1", "REL", "r", 0, 1), ("s2", "SPAN", None, 0, 1), ("s3", "SPAN", "zz", 0, 1), ("s4", "SPAN", "e", 0, 1), ("s5", "SPAN", "n", 0, 1), ("s6", "SPAN", "r", 2, 99), ("s7", "SPAN", "r", 1, 4)],
        "span_id string, kind string, raw_id string, start int, end int",
    )
    raws = spark.createDataFrame([("r", "RAW", "hé𝒳llo"), ("e", "ENT", "x"), ("n", "RAW", None)], "raw_id string, kind string, content string")
    links = knowledge.chains(recs, spans, raws)
    found = {r.id: (r.defect, r.text) for r in links.collect()}
    assert [found[k][0] for k in ("none", "gone", "rel", "noraw", "lost", "notraw", "empty", "long")] == list(knowledge.DEFECTS)
    assert found["good"] == (None, "é𝒳l")
    assert rows(knowledge.completeness(links)) == [(1, 9, round(1 / 9, 6))]
    assert rows(knowledge.completeness(links.limit(0))) == [(0, 0, 1.0)]


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate((5, 9, 3, 1))], "pack int, pos int, cost int")
    assert [r.included for r in evaluation.context_pack(df, 10, header=1).orderBy("pos").collect()] == [True, False, True, True]
    assert evaluation.greedy_fill([1], 5, used=5) == [False]


def test_metrics_of_empty_and_short_results(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "g", 2)], "case_id string, id string, rank int")
    gold = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "g")], "case_id string, id string")
    found = {r.case_id: r for r in evaluation.track(ranked, gold, 5).collect()}
    assert found["a"].rr == 0.5 and found["a"].recall == 0.5 and not found["b"].hit and found["b"].ndcg == 0.0
    assert found["a"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert rows(evaluation.summary(evaluation.track(ranked, gold.limit(0), 5))) == [(0, 0.0, 0.0, 0.0, 0.0)]


def test_percentile_rounds_halves_to_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "k string, v double")
    assert rows(evaluation.percentile_of(df, "v", 0.5, "k")) == [("a", 2.0)]  # index 2.5 goes to 2


def test_ledger_finds_tampering(spark):
    made = ledger.build_chain(spark.createDataFrame([(1, i, f"p{i}") for i in range(5)], "run int, seq int, payload string"))
    assert evaluation.chained(made).where("not ok").count() == 0
    bad = made.withColumn("payload", F.when(F.col("seq") == 2, "other").otherwise(F.col("payload")))
    assert rows(evaluation.chained(bad).where("not ok"), "seq") == [(2,)]


def test_upsert_refuses_twice_and_changed_kinds(spark):
    old = spark.createDataFrame([("a", "CLM", 1), ("b", "CLM", 1)], "id string, kind string, v int")
    assert rows(records.upsert(old, spark.createDataFrame([("b", "CLM", 2), ("c", "ENT", 2)], old.schema))) == [("a", "CLM", 1), ("b", "CLM", 2), ("c", "ENT", 2)]
    with pytest.raises(ValueError):
        records.upsert(old, spark.createDataFrame([("b", "ENT", 2)], old.schema))
    with pytest.raises(ValueError):
        records.upsert(old, spark.createDataFrame([("b", "CLM", 2), ("b", "CLM", 3)], old.schema))


def test_product_versions_reuse_equal_fingerprints(spark):
    stored = spark.createDataFrame([("p", "f1", 1), ("p", "f2", 2)], "product string, fingerprint string, version int")
    made = spark.createDataFrame([("p", "f2"), ("q", "f9")], "product string, fingerprint string")
    assert rows(graph.new_versions(made, stored)) == [("p", "f2", 2, False), ("q", "f9", 1, True)]


def test_temporal_phrases(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from memspark.catalogue.temporal import QUESTIONS
    from memspark.functions import temporal as tm

    anchor = datetime(2024, 1, 20, 12)
    frame = spark.createDataFrame([(q,) for q in [*QUESTIONS, None]], "q string")
    found = {r.q: r.at for r in frame.select("q", tm.reference_instant(F.col("q"), F.lit(anchor)).alias("at")).collect()}
    for q, days in QUESTIONS.items():
        if q.startswith("seen on"):
            assert found[q] == datetime(2024, 1, 3)
        else:
            assert (None if found[q] is None else (found[q] - anchor).total_seconds() / 86400) == days, q
    assert found[None] is None
    text = "On 3 May 2023, June 2022, 1/2/24 or 2024-02-30; yesterday, Last Week, 4 days later"
    got = spark.createDataFrame([(text,)], "t string").select(tm.tokens(F.col("t"))).first()[0]
    assert got == ["3 May 2023", "June 2022", "1/2/24", "2024-02-30", "yesterday", "Last Week", "4 days later"]
    bad = spark.createDataFrame([("on 2024-02-30, or 2023-05-06",)], "t string").select(tm.reference_instant(F.col("t"), F.lit(anchor))).first()[0]
    assert bad == datetime(2023, 5, 6)


def test_plans():
    p = pq.plan("kind:clm,ent ns:a scope:user find  me", mode="mix", budget=7)
    assert p.filters.kinds == ("CLM", "ENT") and p.residual == "find me" and p.legs == ("sql", "vector", "graph") and p.limits["sql"] == 14 and p.explicit_boundary
    assert pq.plan("id:x", mode="graph").legs == ("sql", "graph") and pq.plan("id:x").intent == "structured"
    assert pq.plan("(ns:x, see kind:ent").filters.ns == "x," and pq.residual("(ns:x y") == "( y" and pq.plan("xns:a b").filters.ns is None
    for bad in ("graph=1,graph=2", "graph", "graph=-1", ""):
        with pytest.raises(ValueError):
            pq.leg_weights(bad)
    with pytest.raises(ValueError):
        pq.plan("ns:a x", ns="b")
    with pytest.raises(ValueError):
        pq.parse_filters("id:" + ",".join(map(str, range(65))))
    assert pq.resolve_flags({"k": 1, "on": False}, {"k": 2}, {"on": "true"}) == {"k": 2, "on": True}


def test_record_lines_and_blocks(spark, tmp_path):
    source = """# a source
entity person "Ada" as ent:ada
claim clm:1:
  subject ent:ada
  predicate likes
  object "green tea"
  confidence 0.5
  evidence [span:1, span:2]
  status Observed
state sta:1:
  target ent:ada
  field mood true
  field level -3
pack pk:1:
  mode exact
  include clm:1
  include sta:1
retrieve q:1:
  query who likes tea
  namespace team.a
raw raw:1:
  text it is 2.50
"""
    parsed = {r["id"]: r for r in rs.parse_blocks(source)}
    assert parsed["ent:ada"]["attrs"] == {"entity_type": "person", "label": "Ada"}
    assert parsed["clm:1"]["attrs"] == {"subject": "ent:ada", "predicate": "likes", "object": "green tea"}
    assert parsed["clm:1"]["status"] == "observed" and parsed["clm:1"]["evidence"] == ["span:1", "span:2"]
    assert parsed["sta:1"]["attrs"] == {"target": "ent:ada", "fields": {"mood": "true", "level": -3}}
    assert parsed["pk:1"]["attrs"]["refs"] == ["clm:1", "sta:1"] and parsed["pk:1"]["attrs"]["reversible"] and parsed["pk:1"]["attrs"]["budget"] == 512
    assert parsed["q:1"]["kind"] == "FLOW" and parsed["q:1"]["ns"] == "team.a" and parsed["q:1"]["attrs"]["query"] == "who likes tea"
    assert parsed["raw:1"]["attrs"] == {"content": "it is 2.50", "source_ref": "dsl://raw:1"}
    for bad in ("subject x", "claim c:\nsubject x", "claim c:\n  subject", "state s:\n  field x", "claim c:\n  status odd"):
        with pytest.raises(ValueError):
            rs.parse_blocks(bad)
    made = rs.from_blocks(spark, source)
    assert rows(made, "id", "kind", "conf")[:2] == [("clm:1", "CLM", 0.5), ("ent:ada", "ENT", 1.0)]
    rs.write_lines(made, f"{tmp_path}/lines")
    back = rs.read_lines(spark, f"{tmp_path}/lines")
    assert rows(back, "id", "kind", "conf", "attrs") == rows(made, "id", "kind", "conf", "attrs")
    assert rows(rs.from_lines(spark.createDataFrame([("nonsense",)], "value string")), "id", "kind") == [(None, None)]
    with pytest.raises(ValueError):
        rs.parse_blocks("what is this")


def test_results_do_not_depend_on_partitions(spark, data):
    from memspark.catalogue import collected

    for name in ("bm25_topk", "trust_states", "context_pack_greedy"):
        f = collected()[0][name]
        one = rows(f(spark, data))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            assert rows(f(spark, data)) == one
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_search_in_blocks(spark):
    held = spark.createDataFrame([(f"v{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id string, embedding array<double>")
    asked = held.select(F.col("id").alias("query_id"), "embedding").limit(23)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vectors.exact_join(asked, held, 4, block=5)) == rows(vectors.exact_join(asked, held, 4))
    assert vectors.exact_join(asked.limit(0), held, 4).collect() == []


def test_activation_writes_edges_once(spark, monkeypatch):
    """Repeated edges count by the best of them; what is written is each edge once, and large frontiers give the same."""
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.9), ("c", "b", 0.8), ("c", "d", 1.5)], "src string, dst string, confidence double")
    seeds = spark.createDataFrame([("a", 1.0)], "id string, score double")
    written, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.setdefault(name, write(df, name)) if name == "steps" else write(df, name))
    few = rows(graph.activation(edges, seeds))
    assert [(i, round(a, 9), h) for i, a, h in few] == [("a", 1.0, 0), ("b", 0.648, 1), ("c", round(0.648 * 0.72 * 0.8, 9), 2)]
    assert written["steps"].count() == 4
    assert rows(graph.activation(edges, seeds, broadcast_rows=0)) == few


def test_supply_groups_are_held_by_few_rows_a_task(spark, data, monkeypatch):
    from memspark.sources import tables

    want = rows(tables.supply_edges(spark, data))
    monkeypatch.setattr(tables, "LINES", 1_000)
    edges = tables.supply_edges(spark, data)
    parts = -(-tables.table(spark, data, "lineitem").count() // 1_000)
    assert rows(edges) == want and edges.rdd.getNumPartitions() == parts > 4
    ends = {i for e in tables.supply_edges(spark, data).select("src", "dst").collect() for i in e}
    assert {r.id for r in tables.supply_ends(spark, data).collect()} == ends
    assert "l_partkey" not in "".join(x for x in tables.supply_ends(spark, data)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "l_suppkey" in x and "Aggregate" in x)


def test_both_ends_of_an_edge_come_from_one_reading(spark, data):
    """Degrees and motifs with a loop, a repeated edge and a null end; line items are grouped once, not once an end."""
    from memspark.catalogue import graph as cg

    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("b", None)], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    assert rows(graph.degrees(nodes, edges)) == sorted([("a", 4), ("b", 3), ("c", 0), (None, 0)], key=repr)
    assert rows(graph.motifs(edges)) == [("edge", 4), ("fork", 3), ("join", 1), ("path", 3 * 1 + 1 * 2)]
    for made in (cg.degree_stats, cg.graph_motifs):
        plan = made(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") == 1


def test_eligible_rounds_and_leaves_agree_with_a_closure(spark):
    """Chains, a cycle, ids of one row and of several that disagree, ids without a kind, null references; with ids sent and merged."""
    draw = random.Random(5)
    names = [f"{kind}:{n}" for kind in ("a", "b", "c") for n in range(12)] + ["plain", "d:1"]
    for some, bound in ((names, 0), ([*names, *(f"k{n}:x" for n in range(120))], 100_000)):  # too many kinds to tell apart
        made = [(n, draw.random() > 0.15) for n in some] + [("b:1", True), ("b:1", False), ("d:1", None)]
        refs = [(draw.choice(some), draw.choice(some)) for _ in range(len(some) // 2)] + [("a:1", "a:2"), ("a:2", "a:1"), ("a:3", None), ("c:1", "gone:1")]
        under = [(f"leaf:{n}", draw.random() > 0.1, draw.choice([*some, None])) for n in range(40)]
        bad = {i for i, current in made if current is False}
        while more := {i for i, r in refs if r in bad} - bad:
            bad |= more
        want = sorted([(i,) for i, _ in made if i not in bad] + [(i,) for i, current, r in under if current and r not in bad])
        records, references = spark.createDataFrame(made, "id string, current boolean"), spark.createDataFrame(refs, "id string, ref string")
        leaves = spark.createDataFrame(under, "id string, current boolean, ref string")
        assert rows(graph.eligible(records, references, leaves, bound)) == sorted(want, key=repr)
        if not bound:
            assert rows(graph.eligible(records.unionByName(leaves.drop("ref")), references.unionByName(leaves.select("id", "ref")))) == sorted(want, key=repr)


def test_eligible_transitive_reads_lines_once_and_merges_many_ids(spark, data, monkeypatch):
    """No round carries line items along; ids above the bound are not broadcast because their files are small."""
    from memspark.catalogue import state

    plans, write, whole = [], graph.materialize, graph.eligible
    monkeypatch.setattr(graph, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    want = rows(state.eligible_transitive(spark, data))
    assert "l_orderkey" not in "".join(plans)
    monkeypatch.setattr(graph, "eligible", lambda *tables: whole(*tables, broadcast_rows=0))
    found = state.eligible_transitive(spark, data)
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [l_orderkey") == 1 and "Broadcast" not in plan.executedPlan().toString()
    assert rows(found) == want


def test_large_frontiers_are_not_broadcast(spark, monkeypatch):
    """Three hops from a hub's leaf, with frontiers above the bound: no hop's plan broadcasts a frontier or what was seen."""
    edges = spark.range(60).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"))
    edges = edges.unionByName(spark.range(60).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("m"), "id").alias("dst")))
    seeds = spark.createDataFrame([("n0",)], "id string")
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    want = rows(graph.k_hop(edges, seeds, 3))
    plans.clear()
    assert rows(graph.k_hop(edges, seeds, 3, broadcast_rows=10)) == want and len(want) == 121
    assert "Broadcast" not in plans[-1] and "SortMergeJoin" in plans[-1]


def test_vector_joins_shuffle_no_pairs(spark, tmp_path):
    import numpy as np

    held = np.random.default_rng(3).normal(size=(300, 8)).round(2)
    held[100:160] = held[7]  # ties, by id
    held[5] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(held)], "id long, embedding array<float>")
    asked = v.where("id % 10 = 5 or id = 7").select(F.col("id").alias("query_id"), "embedding")
    unit = [x / (np.sqrt(x @ x) or 1) for x in held.astype(np.float32).astype(float)]
    want = []
    for q in [7, *range(5, 300, 10)]:
        scored = sorted((-round(float(unit[q] @ x), 9), i) for i, x in enumerate(unit))
        want += [(q, i) for s, i in scored[:10] if s < 0]
    assert rows(vectors.exact_join(asked, v, 10, block=40), "query_id", "id") == rows(vectors.exact_join(asked, v, 10), "query_id", "id") == sorted(want, key=repr)
    vectors.write_index(v, str(tmp_path / "index"), 8)
    index = spark.read.parquet(str(tmp_path / "index"))
    near = vectors.approximate_join(asked, index, 8, 10, block=16)
    assert rows(near, "query_id", "id") == rows(vectors.approximate_join(asked, index, 8, 10), "query_id", "id")
    assert len(set(want) & set(rows(near, "query_id", "id"))) >= 0.9 * len(want)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan  # pairs are made and cut in one task


def test_margins_in_blocks_of_labels(spark):
    held = spark.createDataFrame([(i, i % 9, [float(i % 7), float(i % 5), 1.0]) for i in range(45)], "id int, label int, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(9)], "query_id int, v array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vectors.label_margins(held, asked, block=2)) == rows(vectors.label_margins(held, asked)) and len(rows(vectors.label_margins(held, asked))) == 9
    assert vectors.label_margins(held, asked.limit(0)).collect() == []


def test_hash_embeddings_of_arrays(spark):
    texts = ["the thing of the thing", "ha", "", None, "a b a"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.v for r in table.select(vectors.hashed(tx.tokens(F.col("t"))).alias("v")).collect()]
    for t, v in zip(texts, found, strict=True):
        assert max(abs(a - b) for a, b in zip(v, vectors.hash_embed(tx.query_tokens(t or "")), strict=True)) < 1e-12


def test_hash_embeddings_hold_no_wide_tokens(spark):
    """A batch of many short tokens and a very long one: as text of one width it would be 8 GB."""
    import resource

    from pyspark.sql.functions import arrow_udf

    table = spark.range(1).select(F.concat(F.array_repeat(F.lit("ha"), 100_000), F.array(F.repeat(F.lit("x"), 20_000))).alias("t"))
    made = table.select(vectors.hashed("t").alias("v")).collect()[0].v
    for a, b in zip(made, vectors.hash_embed(["ha"] * 100_000 + ["x" * 20_000]), strict=True):
        assert abs(a - b) < 1e-9

    @arrow_udf("long")
    def peak(x):
        import pyarrow as pa

        return pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10] * len(x))

    assert table.select(vectors.hashed("t").alias("v"), peak(F.size("t")).alias("mb")).collect()[0].mb < 2_000


def test_whole_legs_rank_as_cut_ones(spark):
    hits = spark.createDataFrame([(f"l{i % 3}", f"d{i % 17}", float(i * 7 % 11)) for i in range(90)], "leg string, id string, score double").repartition(5)
    rows = lambda df: sorted((r.id, round(r.score, 12), r.legs) for r in df.collect())
    assert rows(fusion.reciprocal(hits, {"l1": 0.5}, whole=True)) == rows(fusion.reciprocal(hits, {"l1": 0.5}))


@pytest.mark.parametrize("directed", [False, True])
def test_hops_of_large_frontiers(spark, directed):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(30)] + [(f"n{i}", f"m{i % 4}") for i in range(30)] + [("m0", "hub"), ("x", "y"), ("n1", "n1")], "src string, dst string")
    seeds = spark.createDataFrame([("hub",), ("lone",), ("hub",)], "id string")
    rows = lambda most: sorted(map(tuple, graph.k_hop(edges, seeds, 3, directed, most).collect()))
    assert rows(0) == rows(100) and {r[0]: r[1] for r in rows(100)}["m1"] == 2 and len(rows(100)) == 36


def test_nearest_nodes_are_scored_before_they_meet_and_no_side_is_one_tasks(spark, data):
    from memspark.catalogue import grounding as cg

    plan = cg.node_vector_topk(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2


def test_records_of_nearest_nodes_are_looked_up_where_they_are(spark):
    from memspark.operators import grounding as gr

    near = spark.createDataFrame([("n1", 0.5), ("n2", 0.4), ("n3", 0.3)], "id string, score double")
    nodes = spark.createDataFrame([("n1", "c1"), ("n2", None), ("n3", "gone")], "id string, source_record_id string")
    records = spark.createDataFrame([("c1", "CLM"), ("c1", "CLM"), ("n2", "ENT"), ("x", "CLM")], "id string, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        leg = gr.node_leg(near, nodes, records)
        assert "SortMergeJoin" not in leg._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r)[1:3] for r in leg.collect()) == [("n1", "c1"), ("n2", "n2")]
