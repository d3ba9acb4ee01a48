"""A store kept up by changes: reprojection of a graph, whole ingests, and an index that follows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions import text as tx
from memspark.operators import merges
from memspark.operators import projection as pj
from memspark.operators import vectors
from memspark.scratch import folder
from memspark.sources import graph_store as gs
from memspark.sources import tables
from memspark.sources.generations import Generations

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

BUCKETS = 8  # of these small tables; a store of many files a change has more
NOW, LATER = "2024-01-01T00:00:00Z", "2024-06-01T00:00:00Z"


def _record(df, **given):
    """A record a row; what is not given is null or empty."""
    nothing = {"attrs": F.create_map(), "ext": F.create_map(), "prov": F.array(), "evidence": F.array()}
    usual = {"ns": F.lit("local.default"), "scope": F.lit("project"), "status": F.lit("asserted"), "conf": F.lit(1.0), "created_at": F.lit(NOW), "updated_at": F.lit(NOW)}
    values = nothing | usual | given
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(pj.RECORD)])


def _claims(orders, object_):
    attrs = F.create_map(F.lit("subject"), tables.tagged("cust", "o_custkey"), F.lit("predicate"), F.lower("o_orderpriority"), F.lit("object"), object_)
    return _record(orders, id=tables.tagged("clm", "o_orderkey"), kind=F.lit("CLM"), attrs=attrs, agent=F.col("o_orderpriority"), t0=F.date_format("o_orderdate", "yyyy-MM-dd"))


def _entities(customers):
    return _record(customers, id=tables.tagged("cust", "c_custkey"), kind=F.lit("ENT"), attrs=F.create_map(F.lit("label"), F.col("c_name")))


CHANGED = """
with ent as (select 'cust:' || c_custkey as id, c_name as label from customer where c_acctbal >= 0),
clm as (select 'clm:' || o_orderkey as id, 'cust:' || o_custkey as s, lower(o_orderpriority) as p, case o_orderstatus when 'O' then 'Closed' else o_orderstatus end as o,
               strftime(o_orderdate, '%Y-%m-%d') as t, o_orderpriority as agent from orders where o_orderstatus <> 'P'),
w as (select id, s as x from clm where s not in (select id from ent)),
v as (select x, 'value:' || substr(sha256('local.default' || chr(31) || 'project' || chr(31) || lower(x)), 1, 20) as node from (select o as x from clm union select t from clm union select x from w)),
a as (select agent, 'agent:' || lower(trim(regexp_replace(agent, '[^a-zA-Z0-9._-]+', '-', 'g'), '-')) || ':' || substr(sha256(agent), 1, 10) as node from (select distinct agent from clm)),
e as (
  select id as source, id as src, 'about' as predicate, s as dst, 'grounding' as edge_kind from clm union all
  select clm.id, clm.id, 'who', coalesce(node, s), 'facet' from clm left join w on clm.id = w.id left join v on w.x = v.x union all
  select id, id, f, node, k from clm join v on o = x, (values ('object', 'grounding'), ('what', 'facet')) t(f, k) union all
  select id, id, 'when', node, 'facet' from clm join v on t = x union all
  select id, s, p, node, 'semantic' from clm join v on o = x union all
  select id, node, 'contributed', id, 'provenance' from clm join a using (agent)),
l as (select distinct source, unnest([src, dst]) as node from e)"""


def _changed_graph(spark, d):
    """A graph of customers and claims after a change: claims of status P are gone, those of status O say something else, and
    customers in debt are no longer there, so claims of theirs hang on unresolved names."""
    store = Generations(spark, folder(spark, "graph"), BUCKETS)
    orders, customers = tables.table(spark, d, "orders"), tables.table(spark, d, "customer")
    gs.reproject(store, _entities(customers).unionByName(_claims(orders, F.col("o_orderstatus"))))
    gone = orders.where("o_orderstatus = 'P'").select(tables.tagged("clm", "o_orderkey").alias("id"))
    gone = gone.unionByName(customers.where("c_acctbal < 0").select(tables.tagged("cust", "c_custkey").alias("id")))
    gs.reproject(store, _claims(orders.where("o_orderstatus = 'O'"), F.lit("Closed")), gone)
    return store


@query(CHANGED + """,
n as (select id, 'entity' as kind, label, false as synthetic from ent union all
  select id, 'claim', left(s || ' ' || p || ' ' || o, 180), false from clm union all
  select distinct s, 'unresolved_reference', s, true from clm where s not in (select id from ent) union all
  select node, 'value', min(lower(x)), true from v group by node union all select node, 'agent', agent, true from a),
k as (select node, count(*) as episodes from l group by node),
o as (select src, count(*) as n_out from e group by src), i as (select dst, count(*) as n_in from e group by dst)
select id, kind, label, synthetic, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in, coalesce(episodes, 0) as episodes
from n left join o on id = src left join i on id = dst left join k on id = node""")
def reprojected_nodes(spark, d):
    store = _changed_graph(spark, d)
    edges = gs.read(store, "edges")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    episodes = gs.read(store, "links").groupBy(F.col("node").alias("id")).agg(F.countDistinct("episode").alias("episodes"))
    rows = gs.nodes(store)
    for counts in (out, into, episodes):  # of as many nodes, so merged: files of ids are too small to go by
        rows = rows.join(counts.hint("merge"), "id", "left")
    return rows.fillna(0, ["n_out", "n_in", "episodes"])


@query(CHANGED + """
select 'kge:' || substr(sha256(source || chr(31) || src || chr(31) || predicate || chr(31) || dst || chr(31) || edge_kind), 1, 24) as id,
       source, src, predicate, dst, edge_kind, agent from e join clm on source = clm.id""")
def reprojected_edges(spark, d):
    return gs.read(_changed_graph(spark, d), "edges").select("id", "source", "src", "predicate", "dst", "edge_kind", "agent")


def _hashes(rows):
    text = F.col("attrs")["content"]
    return rows.where("kind = 'RAW'").select("id", F.sha2(text, 256).alias("source_hash"), vectors.hashed(tx.tokens(text)).alias("embedding"))


@query("""
with again as (select conv_id from conversations group by conv_id having count(*) > 4),
r as (select 'raw:1:' || conv_id || ':' || turn as id, 'doc:1:' || conv_id as document,
             case when conv_id in (select conv_id from again) then 'superseded' else 'asserted' end as status, sha256(coalesce(text, '')) as h from conversations
  union all select 'raw:2:' || conv_id || ':' || turn, 'doc:2:' || conv_id, 'asserted', sha256(coalesce(text, '')) from conversations
  where role = 'user' and conv_id in (select conv_id from again)),
c as (select distinct 'conv:' || conv_id as id, 'doc:1:' || conv_id as document, 'asserted' as status, null as h from conversations)
select id, document, status, case when status = 'asserted' then h end as indexed_hash, false as owed, document[5] = '1' and conv_id is not null as document_gone
from (select * from r union all select * from c) left join again on split_part(document, ':', 3) = again.conv_id::varchar""")
def atomic_ingest(spark, d):
    """Each conversation is a document of its turns and of an entity; those of more than four turns come again, with their
    user's turns alone, which name the entity. Then the index follows."""
    at = folder(spark, "ingest")
    store, index = Generations(spark, f"{at}/records", BUCKETS), Generations(spark, f"{at}/index", BUCKETS)
    turns = tables.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    many = turns.groupBy("conv_id").count().where("count > 4").select("conv_id")

    def take(version, rows, entity, now):
        document = F.concat(F.lit(f"doc:{version}:"), F.col("conv_id").cast("string"))
        named = tables.tagged("conv", "conv_id")
        raw = _record(
            rows, id=F.concat(F.lit(f"raw:{version}:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), kind=F.lit("RAW"),
            attrs=F.create_map(F.lit("content"), F.col("text")), prov=F.array(named), document=document, ns=F.lit("chat"),
        )
        if entity:
            raw = raw.unionByName(_record(rows.select("conv_id").distinct(), id=named, kind=F.lit("ENT"), attrs=F.create_map(F.lit("label"), named), document=document, ns=F.lit("chat")))
        hashes = rows.groupBy("conv_id").agg(F.sha2(F.sum(F.xxhash64("turn", "text").cast("decimal(38,0)")).cast("string"), 256).alias("source_hash"))
        documents = hashes.select(document.alias("document"), F.lit("chat").alias("ns"), F.lit("project").alias("scope"), named.alias("source_ref"), "source_hash")
        gs.ingest(store, documents, raw, now)

    take(1, turns, True, NOW)
    take(2, turns.where("role = 'user'").join(many, "conv_id", "left_semi"), False, LATER)
    gs.replay(store, index, _hashes)
    held = index.read("vectors").select("id", F.col("source_hash").alias("indexed_hash"))
    owed = gs.pending(store).select("id", F.lit(True).alias("owed"))
    ended = gs.read(store, "documents").select("document", F.col("deleted_at").isNotNull().alias("document_gone"))
    rows = gs.read(store, "records").select("id", "document", "status")
    return rows.join(held, "id", "left").join(owed, "id", "left").join(ended, "document").select("id", "document", "status", "indexed_hash", F.coalesce("owed", F.lit(False)).alias("owed"), "document_gone")


MERGES = """
with c as (select c_custkey, c_custkey // 64 as block, c_custkey % 64 as k from customer where c_custkey % 64 > 0),
o as (
  select 1 as phase, 'propose' as op, *, k // 2 as canonical, k as alias, 'proposed' as status, null as reason from c
  union all select 2, 'accept', *, k // 2, k, 'accepted', null from c
  union all select 3, 'propose', *, k, k // 2, 'conflict', 'reverse' from c
  union all select 4, 'propose', *, k // 3, k, case when k in (1, 3) then 'accepted' else 'conflict' end, case when k not in (1, 3) then 'absorbed' end from c
  union all select 5, 'propose', *, k, 0, 'conflict', case when k = 1 then 'reverse' else 'cycle' end from c
  union all select 6, 'split', *, k // 2, k, 'split', null from c where k % 5 = 0
  union all select 7, 'propose', *, k // 3, k, 'proposed', null from c where k % 5 = 0)"""


def _merges(spark, d):
    """Trees of accepted merges over blocks of customers, and decisions that contradict, undo and repeat them, in seven rounds."""
    c = tables.table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 64).where("k > 0")
    half, third, k = F.floor(F.col("k") / 2), F.floor(F.col("k") / 3), F.col("k")
    rounds = [("propose", half, k, "true"), ("accept", half, k, "true"), ("propose", k, half, "true"), ("propose", third, k, "true"), ("propose", k, F.lit(0), "true"), ("split", half, k, "k % 5 = 0"), ("propose", third, k, "k % 5 = 0")]
    out = None
    for n, (op, canonical, alias, where) in enumerate(rounds, 1):
        name = lambda x: x.cast("long").cast("string")
        one = c.where(where).select(
            (F.lit(n * 10**9) + F.col("c_custkey")).alias("seq"), F.lit(op).alias("op"), F.floor(F.col("c_custkey") / 64).cast("long").cast("string").alias("ns"), F.lit("project").alias("scope"),
            name(canonical).alias("canonical"), name(alias).alias("alias"),
        )
        out = one if out is None else out.unionByName(one)
    return merges.replayed(out, spark.createDataFrame([], merges.MERGE))


@query(MERGES + " select phase * 1000000000::bigint + c_custkey as seq, op, canonical::varchar as canonical, alias::varchar as alias, status, reason from o")
def merge_replay(spark, d):
    return _merges(spark, d)[0].select("seq", "op", "canonical", "alias", "status", "reason")


@query(MERGES + """
select block::varchar as ns, canonical::varchar as canonical, alias::varchar as alias, arg_max(status, phase) as status, arg_max({'r': reason}, phase).r as reason from o group by all""")
def merge_ledger(spark, d):
    return _merges(spark, d)[1].select("ns", "canonical", "alias", "status", "reason")
