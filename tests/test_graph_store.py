"""A graph kept up by changes against a rebuild and against brute force; commits, ingests and replays that are killed."""

import random
from collections import Counter

import pytest

from memspark.operators import projection as pj
from memspark.sources import graph_store as gs
from memspark.sources.generations import Conflict, Generations

TABLES = ("edges", "links", "terms", "mentions")


def rec(id, kind, attrs=None, agent=None, prov=(), evidence=(), status="asserted", ext=None, t0=None, document=None):
    return (id, kind, "n", "s", status, 0.5, t0, None, "c", "u", agent, attrs or {}, ext or {}, list(prov), list(evidence), document)


@pytest.fixture
def store(spark, tmp_path):
    return Generations(spark, f"file://{tmp_path}/store", 4)


def rows(spark, table):
    return spark.createDataFrame(table, pj.RECORD)


def state(store):
    out = {name: Counter(map(tuple, gs.read(store, name).select(*gs.columns(name)).collect())) for name in TABLES}
    return out | {"nodes": Counter(map(tuple, gs.nodes(store).collect()))}


def edges_of(record, ids):
    """(src, predicate, dst, edge_kind) of a claim, event, relation, span or provenance, by hand. ids: all records' ids."""
    id_, kind, a = record[0], record[1], record[11]
    out = []

    def value(text):
        import hashlib

        return text if text in ids else "value:" + hashlib.sha256(f"n\x1fs\x1f{text.strip().lower()}".encode()).hexdigest()[:20]

    out += [(id_, "provenance", p, "provenance") for p in record[13]] + [(id_, "evidence", e, "provenance") for e in record[14]]
    if kind == "CLM":
        out += [(id_, "about", a["subject"], "grounding"), (id_, "object", value(a["object"]), "grounding"), (a["subject"], a["predicate"], value(a["object"]), "semantic")]
        out += [(id_, "who", value(a["subject"]), "facet"), (id_, "what", value(a["object"]), "facet")]
    if kind == "REL":
        family = "causal" if a["predicate"] == "causes" else "semantic"
        out += [(id_, "subject", a["src"], "grounding"), (id_, "object", a["dst"], "grounding"), (a["src"], a["predicate"], a["dst"], family)]
        out += [(id_, "who", value(a["src"]), "facet"), (id_, "what", value(a["dst"]), "facet")]
        out += [(id_, "then", value(a["dst"]), "facet")] if family == "causal" else []
    if kind == "EVT":
        out += [(a["actor"], "participated_in", id_, "semantic"), (id_, "who", value(a["actor"]), "facet")]
    if kind == "SPAN":
        out += [(id_, "excerpt_of", a["raw_id"], "provenance")]
    return {e for e in out if e[0] != e[2]}


def drawn(draw, i):
    kind = draw.choice(["ENT", "CLM", "CLM", "REL", "EVT", "RAW", "SPAN"])
    ent = lambda: f"ent:{draw.randrange(6)}"
    if kind == "ENT":
        return rec(f"ent:{draw.randrange(6)}", kind, {"label": draw.choice(["Ann", "Bob", "Tea"])})
    if kind == "RAW":
        return rec(f"raw:{draw.randrange(4)}", kind, {"content": "said"})
    if kind == "SPAN":
        return rec(f"span:{draw.randrange(4)}", kind, {"raw_id": f"raw:{draw.randrange(4)}"})
    cited = draw.sample([f"raw:{k}" for k in range(4)] + [f"span:{k}" for k in range(4)], draw.randint(0, 2))
    attrs = {
        "CLM": {"subject": ent(), "predicate": "likes", "object": draw.choice(["Tea", "tea ", ent()])},
        "REL": {"src": ent(), "predicate": draw.choice(["knows", "causes"]), "dst": ent()},
        "EVT": {"actor": ent(), "action": "went"},
    }[kind]
    return rec(f"{kind.lower()}:{i % 9}", kind, attrs, draw.choice([None, "Bot"]), cited)


@pytest.mark.parametrize("seed", [1])
def test_changes_come_to_a_rebuild(spark, store, tmp_path, seed):
    draw, held = random.Random(seed), {}
    for _ in range(3):
        changed = {r[0]: r for r in (drawn(draw, draw.randrange(100)) for _ in range(12))}
        removed = [i for i in draw.sample(sorted(held), min(len(held), 3)) if i not in changed]
        held = {i: r for i, r in (held | changed).items() if i not in removed}
        gs.reproject(store, rows(spark, list(changed.values())), spark.createDataFrame([(i,) for i in removed], "id string"))
    kept = state(store)
    assert {r.id for r in gs.read(store, "records").collect()} == set(held)
    want = {(r[0], *e) for r in held.values() for e in edges_of(r, held)}
    own = {"contributed"}
    assert {(r.source, r.src, r.predicate, r.dst, r.edge_kind) for r in gs.read(store, "edges").collect() if r.predicate not in own} == want
    other = Generations(spark, f"file://{tmp_path}/other", 4)
    other.commit(0, {"records": (other.stage("records", gs.read(store, "records"), "id"), None)})
    gs.rebuild(other)
    assert state(other) == kept


def test_a_change_touches_its_own_buckets(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}/store", 32)
    gs.reproject(store, rows(spark, [rec(f"clm:{i}", "CLM", {"subject": f"ent:{i}", "predicate": "likes", "object": "tea"}) for i in range(60)]))
    before = store.manifest()
    gs.reproject(store, rows(spark, [rec("clm:7", "CLM", {"subject": "ent:7", "predicate": "likes", "object": "coffee"})]))
    after = store.manifest()
    for name in ("records", "edges", "mentions"):
        assert sum(before[name]["files"][b] != after[name]["files"].get(b) for b in before[name]["files"]) == 1
    assert sum(len(p) for p in after["tallies"]["files"].values()) - sum(len(p) for p in before["tallies"]["files"].values()) <= 4
    assert "coffee" in {r.label for r in gs.nodes(store).collect()}


def test_two_commits_on_one_generation(spark, store):
    one = store.stage("t", spark.createDataFrame([(1, "a")], "id long, x string"), "id")
    two = store.stage("t", spark.createDataFrame([(2, "b")], "id long, x string"), "id")
    assert store.commit(0, {"t": (one, None)}) == 1
    with pytest.raises(Conflict):
        store.commit(0, {"t": (two, None)})
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "a")]
    assert store.commit(1, added={"t": two}) == 2 and store.read("t").count() == 2 and store.read("t", generation=1).count() == 1
    assert store.compacted("t", store.read("t"), "id") == 3 and store.read("t").count() == 2


DOCUMENT = "document string, ns string, scope string, source_ref string, source_hash string"


def embed(df):
    return df.where("kind = 'RAW'").selectExpr("id", "sha2(attrs['content'], 256) as source_hash", "array(1.0D) as embedding")


def whole(store, index):
    docs = {r.document: r.deleted_at for r in gs.read(store, "documents").collect()}
    kept = {r.id: r.status for r in gs.read(store, "records").collect()}
    return docs, kept, {r.id for r in gs.pending(store).collect()}, Counter(r.id for r in index.read("vectors", schema="id string").collect())


def take(spark, store, version, texts, at=lambda step: None, ref="file"):
    records = [rec(f"raw:{version}:{i}", "RAW", {"content": t}, prov=["who"], document=version) for i, t in enumerate(texts)]
    records += [rec("who", "ENT", {"label": "Ann"}, document=version)] if version == "v1" else []
    return gs.ingest(store, spark.createDataFrame([(version, "n", "s", ref, "|".join(texts))], DOCUMENT), rows(spark, records), f"at {version}", at)


class Killed(Exception):
    pass


def killer(step):
    def at(now):
        if now == step:
            raise Killed(step)

    return at


def test_a_killed_ingest_leaves_the_old_generation(spark, store, tmp_path):
    index = Generations(spark, f"file://{tmp_path}/index", 4)
    take(spark, store, "v1", ["a", "b"])
    gs.replay(store, index, embed)
    before = whole(store, index)
    assert before == ({"v1": None}, {"raw:v1:0": "asserted", "raw:v1:1": "asserted", "who": "asserted"}, set(), Counter(["raw:v1:0", "raw:v1:1"]))
    for step in ("supersession", "intents", "commit"):  # before anything is written, before the intents, and before the rename
        with pytest.raises(Killed):
            take(spark, store, "v2", ["a", "c"], killer(step))
        assert whole(store, index) == before, step
    take(spark, store, "v2", ["a", "c"])
    docs, kept, owed, vectors = whole(store, index)
    assert docs == {"v1": "at v2", "v2": None} and owed == {"raw:v1:0", "raw:v1:1", "raw:v2:0", "raw:v2:1"} and vectors == before[3]
    assert kept == {"raw:v1:0": "superseded", "raw:v1:1": "superseded", "who": "asserted", "raw:v2:0": "asserted", "raw:v2:1": "asserted"}
    assert all(r.expired_at == "at v2" for r in gs.read(store, "edges").where("source like 'raw:v1%'").collect())
    for step in ("index", "acknowledge"):  # before the index has followed, and after
        with pytest.raises(Killed):
            gs.replay(store, index, embed, killer(step))
        assert whole(store, index)[2] == owed
    done = gs.replay(store, index, embed)
    assert whole(store, index)[2:] == (set(), Counter(["raw:v2:0", "raw:v2:1"]))
    assert gs.replay(store, index, embed) == done  # nothing is owed
    n = store.latest()
    assert take(spark, store, "v2", ["a", "c"]) == n == store.latest()  # the same again changes nothing


def test_ingests_of_one_source(spark, store):
    two = spark.createDataFrame([("v1", "n", "s", "f", "1"), ("v2", "n", "s", "f", "2")], DOCUMENT)
    with pytest.raises(ValueError):
        gs.ingest(store, two, rows(spark, []), "now")
    base = store.latest()

    def race(step):
        if step == "commit":
            take(spark, store, "v3", ["z"])

    with pytest.raises(Conflict):  # another ingest of the source came first: one winner, whole
        take(spark, store, "v2", ["y"], race)
    assert store.latest() == base + 1 and {r.document for r in gs.read(store, "documents").collect()} == {"v3"}
    assert {r.id for r in gs.read(store, "records").collect()} == {"raw:v3:0"}
    take(spark, store, "v4", ["x"], ref="other file")
    assert {r.document for r in gs.read(store, "documents").where("deleted_at is null").collect()} == {"v3", "v4"}


def test_common_values_and_buckets_are_many_tasks(spark, tmp_path):
    """A value that many rows name is looked up where they are, and a bucket is not written by one task alone."""
    from pyspark.sql import functions as F

    from memspark.operators import projection
    from memspark.sources.generations import Generations

    named = spark.range(200).select(F.concat(F.lit("s"), "id").alias("source"), F.when(F.col("id") % 2 == 0, "often").otherwise(F.concat(F.lit("v"), "id")).alias("value"))
    known = spark.createDataFrame([("often", "ENT"), ("v3", "RAW")], "value string, ref_kind string")
    rows = lambda df: sorted(map(str, df.select("source", "value", "ref_kind").collect()))
    assert rows(projection.looked_up(named, known, often=50)) == rows(named.join(known, "value", "left"))
    store = Generations(spark, f"file://{tmp_path}/store", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = store.stage("links", named, "source")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "store").rglob("part-*.parquet"))) > 1 and list(staged["files"]) == ["0"]


def test_tables_that_are_not_there_cost_no_tasks(spark, tmp_path):
    from memspark.sources import graph_store as gs
    from memspark.sources.generations import Generations

    store = Generations(spark, f"file://{tmp_path}/store", 4)
    for name, ddl in gs.SCHEMAS.items():
        rows = gs.read(store, name)
        assert rows.schema == spark.createDataFrame([], ddl).schema
        assert rows.rdd.getNumPartitions() == 0 and rows.count() == 0


def test_many_ids_are_not_sent_to_all_tasks(spark, store, monkeypatch):
    """Files of ids are so small that Spark, left alone, gathers millions of them on the driver."""
    from memspark import scratch

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    table = rows(spark, [rec(f"clm:{i}", "CLM", {"subject": "ent:1", "predicate": "likes", "object": "tea"}, evidence=["span:1"]) for i in range(6)])
    store.commit(0, {"records": (store.stage("records", table, "id"), None)})
    ids = scratch.materialize(spark.createDataFrame([("clm:1",), ("clm:4",), ("gone",)], "id string"), "ids")
    assert "Broadcast" in plan(gs.of(store, "records", ids, "id"))
    monkeypatch.setattr(scratch, "FEW", 2, raising=False)
    found = gs.of(store, "records", ids, "id")
    assert "Broadcast" not in plan(found) and sorted(r.id for r in found.collect()) == ["clm:1", "clm:4"]
    named, known = pj.references(table), pj.gist(rows(spark, [rec("span:1", "SPAN", {"raw_id": "raw:1"})]))
    quoted = pj.wanted(named, known)
    assert "Broadcast" not in plan(quoted) and {r.source for r in quoted.where("ref = 'raw:1'").collect()} == {f"clm:{i}" for i in range(6)}
