"""Node texts and vectors, the node leg, seed grounding, episodes, node upserts, and what the structured leg searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import grounding as gr
from memspark.operators import lexical
from memspark.plans import query as pq
from memspark.sources import tables

from .graph import NODES
from .registry import Registry
from .vectors import COSINE, PROBE

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
MODEL = "hash-64"

NODE_TEXT_SQL = """
with parts as (select p_partkey, unnest(['entity', p_name, p_brand, p_name, p_size::varchar, p_type]) as v, unnest(range(6)) as i, p_size from part),
f as (select p_partkey, lower(trim(v)) as low, min(i) as i, arg_min(trim(v), i) as v from parts where trim(v) <> '' group by p_partkey, lower(trim(v))),
node_text as (select p_partkey, 'part:' || p_partkey as id, string_agg(v, ' ' order by i) as text from f group by p_partkey)"""


def _nodes(spark, d):
    p = tables.table(spark, d, "part")
    said = {"brand": F.col("p_brand"), "entity_type": F.lit("part"), "label": F.col("p_name"), "size": F.col("p_size").cast("string"), "type": F.col("p_type")}
    return p.select(
        tables.tagged("part", "p_partkey").alias("id"), F.lit("entity").alias("kind"), F.col("p_name").alias("label"),
        F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)]).alias("properties"),
        F.when(F.col("p_size") == 1, "deleted_soft").otherwise("asserted").alias("status"),
        F.when(F.col("p_partkey") % 2 == 0, tables.tagged("clm", "p_partkey")).alias("source_record_id"),
    )


def _index(spark, d):
    """Vectors of parts; those of label 9 were made of another text."""
    e = tables.table(spark, d, "embeddings").select(tables.tagged("part", "vec_id").alias("id"), "embedding", "label")
    text = F.when(F.col("label") == 9, "another").otherwise(gr.node_text(F.col("kind"), F.col("label_"), F.col("properties")))
    nodes = _nodes(spark, d).select("id", "kind", F.col("label").alias("label_"), "properties")
    return e.join(nodes.hint("merge"), "id").select("id", "embedding", gr.source_hash(text, MODEL).alias("source_hash"))


@query(NODE_TEXT_SQL + " select id, text from node_text")
def node_text(spark, d):
    return _nodes(spark, d).select("id", gr.node_text(F.col("kind"), F.col("label"), F.col("properties")).alias("text"))


NEAREST_SQL = f"""
with near as (select 'part:' || vec_id as id, vec_id, {COSINE} as score from embeddings join part on p_partkey = vec_id
              where label <> 9 and p_size <> 1 and {COSINE} > 0 order by round(score, 9) desc, id limit 40)"""


def _nearest(spark, d):
    return gr.nearest_nodes(_nodes(spark, d), _index(spark, d), PROBE, MODEL, 40)


@query(NEAREST_SQL + " select id, round(score, 9) as score from near")
def node_vector_topk(spark, d):
    return _nearest(spark, d).select("id", "score")


@query(NEAREST_SQL + """
select 'graph_node' as leg, near.id as node, 'clm:' || o_orderkey as id, round(score, 9) as score, 'graph_node_semantic=' || format('{:.4f}', round(score, 9)) as reason
from near join orders on o_orderkey = vec_id where vec_id % 2 = 0 and o_orderstatus <> 'P'""")
def graph_node_leg(spark, d):
    """Half of the nodes come from a claim, which must be current; the others are records that no claim holds."""
    claims = tables.claim_records(spark, d).where(pq.current(F.col("status")))
    return gr.node_leg(_nearest(spark, d), _nodes(spark, d), claims)


GROUND_SQL = """
with seeds as (select id from (select 'clm:' || o_orderkey as id from orders where o_orderkey % 100 = 0
                               union all select 'rel:' || c_custkey from customer where c_custkey % 40 = 1 union all select 'nation:' || n_nationkey from nation where n_nationkey < 3)
               order by id limit 300),
found as (select 'nation:' || n_nationkey as id from nation join seeds s on s.id = 'nation:' || n_nationkey
          union select 'customer:' || o_custkey from orders join seeds s on s.id = 'clm:' || o_orderkey where o_orderkey % 3 <> 0
          union select 'customer:' || c_custkey from customer join seeds s on s.id = 'rel:' || c_custkey
          union select 'nation:' || c_nationkey from customer join seeds s on s.id = 'rel:' || c_custkey)"""


def _grounding(spark, d):
    own = lambda df: df.withColumns({"ns": F.lit("local.default"), "scope": F.lit("project")})
    orders, customers, nations = (tables.table(spark, d, t) for t in ("orders", "customer", "nation"))
    entities = own(tables.nodes(spark, d).select("id"))
    claims = orders.select(tables.tagged("clm", "o_orderkey").alias("id"), F.lit("CLM").alias("kind"), tables.tagged("customer", "o_custkey").alias("subject"), F.col("o_orderstatus").alias("object"), (F.col("o_orderkey") % 3 != 0).alias("held"))
    relations = customers.select(tables.tagged("rel", "c_custkey").alias("id"), tables.tagged("customer", "c_custkey").alias("src"), tables.tagged("nation", "c_nationkey").alias("dst"))
    rels = relations.select("id", F.lit("REL").alias("kind"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("object"))
    edges = claims.where("held").select(F.col("id").alias("src"), F.lit("about").alias("predicate"), F.col("subject").alias("dst"))
    edges = edges.unionByName(relations.select(F.col("id").alias("src"), F.inline(F.array(F.struct(F.lit("subject").alias("predicate"), F.col("src").alias("dst")), F.struct(F.lit("object").alias("predicate"), F.col("dst").alias("dst"))))))
    seeds = orders.where("o_orderkey % 100 = 0").select(tables.tagged("clm", "o_orderkey").alias("id"))
    seeds = seeds.unionByName(customers.where("c_custkey % 40 = 1").select(tables.tagged("rel", "c_custkey").alias("id"))).unionByName(nations.where("n_nationkey < 3").select(tables.tagged("nation", "n_nationkey").alias("id")))
    return seeds, entities, own(claims.drop("held").unionByName(rels)), own(edges), relations


@query(GROUND_SQL + """
select id from found where id in (select 'customer:' || c_custkey from customer union select 'nation:' || c_nationkey from customer) order by id limit 50""")
def seed_grounding(spark, d):
    return gr.ground_seeds(*_grounding(spark, d), limit=50)


@query(GROUND_SQL + """,
direct as (select id from seeds where id like 'nation:%'), kept as (select id from direct union all select id from found where not exists (select 1 from direct))
select id from kept where id in (select 'customer:' || c_custkey from customer union select 'nation:' || c_nationkey from customer) order by id limit 50""")
def seed_grounding_direct(spark, d):
    """Entities among the seeds end the search; those that no relation touches are not admitted."""
    return gr.ground_seeds(*_grounding(spark, d), limit=50, prefer_direct=True)


@query(NODES + """,
b as (select distinct u, v from (select src as u, dst as v from places union all select dst, src from places))
select u as id, round(avg((contains(v, 'nation:1') or contains(v, 'region'))::int), 6) as score from b group by u""")
def neighbour_name_score(spark, d):
    rows = gr.neighbour_name_score(tables.place_edges(spark, d), tx.query_tokens("nation:1 REGION"))
    return rows.withColumn("score", F.round("score", 6))


@query("""
select event_id from events where user_id % 7 = 3 and ts <= timestamp '2024-01-12'
  and (event_type in ('view', 'click') or (event_type = 'purchase' and ts + interval 3 day > timestamp '2024-01-12'))""")
def episode_filter(spark, d):
    """Episodes that were live at a moment: views and clicks are open, purchases last three days, the other ends are malformed."""
    e = tables.table(spark, d, "events")
    end = F.when(F.col("event_type") == "purchase", F.date_format(F.col("ts") + F.expr("interval 3 days"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("event_type") == "view", " ").when(F.col("event_type") != "click", "soon")
    rows = e.select("event_id", F.lit("local.default").alias("ns"), F.lit("user").alias("scope"), F.concat(F.lit("agent"), (F.col("user_id") % 7).cast("string")).alias("agent"), F.col("ts").alias("recorded_at"), end.alias("expired_at"), F.lit("active").alias("status"))
    return gr.episodes(rows, ns="local.default", scope="user", agent="agent3", at=F.lit(datetime(2024, 1, 12))).select("event_id")


@query("""
with w as (select 'customer:' || o_custkey as id, o_orderkey as seq, o_orderpriority as label, round(o_totalprice / 1000000, 6) as c, o_orderdate as t, o_orderstatus <> 'P' as synthetic from orders),
l as (select id, max(seq) filter (not synthetic) as last from w group by id)
select id, 'entity' as kind, coalesce(max(label) filter (seq = last), arg_min(label, seq)) as label, max(c) filter (last is null or seq >= last) as confidence,
       cast(cast(coalesce(max(t) filter (seq = last), min(t)) as date) as varchar) as created_at, cast(cast(coalesce(max(t) filter (seq = last), max(t)) as date) as varchar) as updated_at, bool_and(synthetic) as synthetic
from w join l using (id) group by id""")
def node_upsert(spark, d):
    """Orders write their customer's node; those in progress are the real writes."""
    o = tables.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return gr.upserted(o.select(
        tables.tagged("customer", "o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.lit("entity").alias("kind"), F.col("o_orderpriority").alias("label"),
        F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"), day.alias("created_at"), day.alias("updated_at"), (F.col("o_orderstatus") != "P").alias("synthetic"),
    ))


@query("""
with t as (select l_orderkey as k, max(lower(l_returnflag || ' ship ' || l_linenumber)) as said from lineitem where l_linenumber < 3 and l_orderkey % 4 <> 0 group by l_orderkey)
select 'clm:' || o_orderkey as id, coalesce(said, lower('{"object":"' || o_orderstatus || '"}')) as search_text from orders left join t on k = o_orderkey""")
def sql_leg_search_text(spark, d):
    """What the structured leg searches: the greatest text of a record's vectors, or its payload where it has none."""
    line = tables.table(spark, d, "lineitem").where("l_linenumber < 3 and l_orderkey % 4 != 0")
    texts = line.select(tables.tagged("clm", "l_orderkey").alias("id"), F.concat_ws(" ", "l_returnflag", F.lit("ship"), "l_linenumber").alias("source_text"))
    claims = tables.claim_records(spark, d).select("id", F.to_json(F.struct("object")).alias("payload"))
    return lexical.leg_text(claims, texts)


@query("""
with c as (select 'clm:' || o_orderkey as id, o_orderstatus, round(least(1.0, o_totalprice / 500000), 6) as conf from orders)
select id, conf as score from c where o_orderstatus <> 'P' order by conf desc, id limit 25""")
def page_past_tombstones(spark, d):
    """A page is filled with current records, however many of the best are not: the filter is below the cut."""
    claims = tables.claim_records(spark, d).withColumn("score", F.col("conf"))
    return lexical.current_page(claims, 25).select("id", "score")


@query("""
with c as (select 'clm:' || o_orderkey as id, o_orderkey, ((o_custkey = 7)::int + (lower(o_orderpriority) = '2-high')::int + (o_orderstatus = 'F')::int) / 3.0::double as s from orders),
t as (select * from c where s > 0 order by round(s, 9) desc, id limit 20)
select t.id, round(s, 9) as score, coalesce(string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar), '') as evidence from t left join lineitem on l_orderkey = o_orderkey group by t.id, s""")
def full_batch_search(spark, d):
    """The best claims with the ids of their evidence; only what is shown is hydrated."""
    claims = tables.claim_records(spark, d).withColumn("text", F.concat_ws(" ", "subject", "predicate", "object"))
    best = lexical.top(lexical.overlap(claims, "CUST:7 2-high f", F.col("text")), 20).select("id", "score")
    line = tables.table(spark, d, "lineitem").select(tables.tagged("clm", "l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("evidence"))
    return lexical.hydrated(best, line)
