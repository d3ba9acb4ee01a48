"""Projections, selectors, mutations and their reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.operators import mutations as mu
from memspark.operators import projections as pr
from memspark.operators import selectors as se
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _claims(spark, d):
    c = tables.claim_records(spark, d)
    attrs = F.create_map(F.lit("subject"), F.col("subject"), F.lit("predicate"), F.col("predicate"), F.lit("object"), F.col("object"))
    return c.withColumn("attrs", attrs)


@query("""
select 'clm:' || o_orderkey as id, 'cust:' || o_custkey || ' ' || lower(o_orderpriority) || ' ' || o_orderstatus as label,
       'CLM ' || o_orderstatus || ' ' || lower(o_orderpriority) || ' cust:' || o_custkey as vector_text from orders""")
def record_text(spark, d):
    return _claims(spark, d).select("id", pr.label().alias("label"), pr.vector_text().alias("vector_text"))


@query("""
select 'clm:' || o_orderkey as id, '{"subject":"cust:' || o_custkey || '","predicate":"' || lower(o_orderpriority) || '","object":"' || o_orderstatus || '"}' as signal from orders""")
def record_signals(spark, d):
    return _claims(spark, d).select("id", pr.signal().alias("signal"))


@query("select 'RAW' as kind, count(*) as n from documents union all select 'CLM', count(*) from orders union all select 'EVT', count(*) from events")
def context_summary(spark, d):
    kinds = [f(spark, d).select("kind") for f in (tables.raw_records, tables.claim_records, tables.event_records)]
    return pr.summary(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))


@query("""
with r as (select 'clm:' || o_orderkey as id, o_orderdate as t, 'cust:' || o_custkey as ref from orders where o_orderstatus = 'F')
select id, strftime(t, '%Y-%m-%d') as day, case when ref in (select 'cust:' || c_custkey from customer where c_acctbal > 0) then ref else '' end as refs from r""")
def neighbour_timeline(spark, d):
    c = tables.claim_records(spark, d).where("object = 'F'")
    people = tables.table(spark, d, "customer").where("c_acctbal > 0").select(tables.tagged("cust", "c_custkey").alias("id"))
    batch = c.select("id", F.col("t0"), F.lit(None).cast("timestamp_ntz").alias("created_at")).unionByName(people.select("id", F.lit(None).cast("timestamp_ntz").alias("t0"), F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz").alias("created_at")))
    shown = pr.timeline(batch, c.select("id", F.col("subject").alias("ref")))
    return shown.where("id like 'clm:%'").select("id", F.date_format("at", "yyyy-MM-dd").alias("day"), "refs")


@query("""
select 'clm:' || o_orderkey as id, concat_ws(',', case when o_orderstatus = 'O' then 'status' end, case when o_totalprice > 300000 then 'large' end, case when o_orderpriority like '1%' then 'urgent' end) as reasons from orders""")
def structured_reasons(spark, d):
    o = tables.table(spark, d, "orders")
    checks = {"status": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 300000, "urgent": F.col("o_orderpriority").like("1%")}
    return o.select(tables.tagged("clm", "o_orderkey").alias("id"), pr.reasons(checks).alias("reasons"))


@query("""
with m as (select o_custkey, count(*) as records, sha256('exact||0|' || string_agg('clm:' || o_orderkey, ',' order by 'clm:' || o_orderkey)) as h from orders group by o_custkey)
select 'cust:' || o_custkey as subject, 'pack:exact:' || records || ':' || substr(h, 1, 12) as pack_id, cast(records as integer) as records from m""")
def exact_packs(spark, d):
    packs = pr.exact_pack(_claims(spark, d).select("subject", "id", "kind", F.to_json("attrs").alias("attrs_json")), "subject")
    return packs.select("subject", "pack_id", "records")


@query("select 'clm:' || o_orderkey as id, 'CLM' as kind, o_orderstatus as object from orders")
def exact_pack_round_trip(spark, d):
    packs = pr.exact_pack(_claims(spark, d).select("subject", "id", "kind", F.to_json("attrs").alias("attrs_json")), "subject")
    return pr.unpacked(packs).select("id", "kind", F.get_json_object("attrs_json", "$.object").alias("object"))


@query("""
with w as (select 'part:' || p_partkey as node, unnest(string_split(lower(p_name), ' ')) as token from part)
select token, count(distinct node) as nodes from w group by token""")
def term_index(spark, d):
    parts = tables.nodes(spark, d).where("entity_type = 'part'")
    return se.terms(parts, F.col("label")).groupBy("token").agg(F.countDistinct("node").alias("nodes"))


@query("""
with s as (select distinct l_orderkey as raw, 'part:' || l_partkey as seed, token from lineitem join (select p_partkey, unnest(string_split(lower(p_name), ' ')) as token from part) on p_partkey = l_partkey
           where token in ('blue', 'widget'))
select raw, count(distinct token) as tokens, count(*) as edges from s group by raw having count(distinct token) = 2 and count(distinct seed) >= 2 and
  not (count(distinct case when token = 'blue' then seed end) = 1 and count(distinct case when token = 'widget' then seed end) = 1 and min(case when token = 'blue' then seed end) = min(case when token = 'widget' then seed end))""")
def source_selector(spark, d):
    """Orders whose parts, matched one to one, cover two query tokens."""
    tokens = se.terms(tables.nodes(spark, d).where("entity_type = 'part'"), F.col("label")).where(F.col("token").isin("blue", "widget"))
    line = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("raw"), tables.tagged("part", "l_partkey").alias("node"))
    support = line.join(tokens, "node").select("raw", F.col("node").alias("seed"), "token")
    return se.agreeing_sources(support, 2).select("raw", F.col("agreement").alias("tokens"), "edges")


@query()
def same_event_groups(spark, d):
    """A user's purchases and clicks as evidence for a count: those of one day that share a token are one event."""
    e = tables.event_records(spark, d).where(F.col("action").isin("purchase", "click"))
    rows = e.select(F.col("actor").alias("question"), F.col("event_id").alias("id"), F.date_format("t0", "yyyy-MM-dd").alias("day"), F.col("action").alias("token"))
    return se.same_day_events(rows)


@query("""
with g as (select o_orderkey as id from orders where o_orderstatus = 'P')
select (select count(*) from orders where o_orderkey not in (select id from g)) as records, (select count(*) from lineitem where l_orderkey not in (select id from g)) as edges""")
def delete_records(spark, d):
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    ids = o.where("o_orderstatus = 'P'").select(tables.tagged("clm", "o_orderkey").alias("id"))
    edges = line.select(tables.tagged("clm", "l_orderkey").alias("src"), tables.tagged("part", "l_partkey").alias("dst"))
    left, kept = mu.delete(o.select(tables.tagged("clm", "o_orderkey").alias("id")), edges, ids)
    return left.agg(F.count(F.lit(1)).alias("records")).join(kept.agg(F.count(F.lit(1)).alias("edges")))


@query("""
select case when o_orderstatus = 'F' and o_totalprice > 200000 then 'deleted_soft' when o_orderstatus = 'F' then 'asserted' when o_orderstatus = 'O' then 'observed' else 'superseded' end as status, count(*) as n
from orders group by 1""")
def scoped_soft_delete(spark, d):
    o = tables.table(spark, d, "orders").select(tables.tagged("clm", "o_orderkey").alias("id"), "o_totalprice")
    stored = tables.claim_records(spark, d).withColumn("generation", F.lit(1))
    targets = stored.join(o, "id").where("object = 'F' and o_totalprice > 200000").select("id", "ns", "scope", "generation")
    return mu.soft_delete(stored, targets).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
with a as (select source, max(doc_id) as active from documents group by source)
select d.source as source_ref, count(*) as superseded from documents d join a using (source) where doc_id <> active and lang <> 'es' group by d.source""")
def superseded_generations(spark, d):
    docs = tables.table(spark, d, "documents")
    records = docs.select(tables.tagged("raw", "doc_id").alias("id"), F.col("doc_id").alias("document"), F.col("source").alias("source_ref"))
    active = docs.groupBy(F.col("source").alias("source_ref")).agg(F.max("doc_id").alias("document"))
    protected = docs.where("lang = 'es'").select(tables.tagged("raw", "doc_id").alias("id"))
    return mu.superseded_generations(records, active, protected).groupBy("source_ref").agg(F.count(F.lit(1)).alias("superseded"))


@query("select count(*) as pending from documents where doc_id not in (select vec_id from embeddings)")
def pending_index(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("source_hash"))
    index = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(docs, "id")
    return mu.pending(docs, index).agg(F.count(F.lit(1)).alias("pending"))


@query("""
with c as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'fact' when '2-HIGH' then 'observation' when '3-MEDIUM' then 'summary' else 'note' end as kind,
                  case when o_totalprice > 100000 then 'verified' else 'unverified' end as state, o_orderstatus <> 'P' as current, o_orderdate as happened,
                  case when o_custkey < 50 then 'a' else 'b' end as ns, case when o_orderstatus = 'F' then 'p' end as product from orders)
select coalesce(case when ns <> 'b' then 'boundary' when kind not in ('fact', 'observation', 'summary') then 'kind' when state <> 'verified' then 'trust' when not current then 'not_current'
                     when happened > timestamp '1998-01-01' then 'time' when kind in ('observation', 'summary') and product is null then 'derived_without_product' end, 'eligible') as reason, count(*) as n
from c group by 1""")
def context_eligibility(spark, d):
    o = tables.table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "fact").when(F.col("o_orderpriority") == "2-HIGH", "observation").when(F.col("o_orderpriority") == "3-MEDIUM", "summary").otherwise("note")
    rows = o.select(
        kind.alias("kind"), F.when(F.col("o_totalprice") > 100000, "verified").otherwise("unverified").alias("state"), (F.col("o_orderstatus") != "P").alias("current"), F.col("o_orderdate").alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("valid_until"), F.when(F.col("o_custkey") < 50, "a").otherwise("b").alias("ns"), F.lit("project").alias("scope"), F.when(F.col("o_orderstatus") == "F", "p").alias("product_id"),
    )
    reason = mu.eligibility("b", "project", F.lit(datetime(1998, 1, 1)), ("fact", "observation", "summary"), ("observation", "summary"))
    return rows.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with l as (select user_id, arg_max(event_type, event_id) as status from events where event_type in ('purchase', 'error') group by user_id)
select c_custkey as proposal_id, coalesce(status, 'pending') as status from customer left join l on user_id = c_custkey""")
def proposals_with_decisions(spark, d):
    p = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("proposal_id"))
    e = tables.table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return mu.with_latest_decision(p, e.select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("decision_id"), F.col("event_type").alias("status")))


@query("""
with s as (select user_id as run, event_id, case when row_number() over w = 1 then 'open' else event_type end as status, row_number() over w as seq from events window w as (partition by user_id order by event_id)),
p as (select *, lag(status) over (partition by run order by seq) as before from s)
select run, count(*) as events, count_if(case when before is null then status = 'open' else (before || '>' || status) in ('open>click', 'click>view', 'view>purchase', 'view>view') end) as ok from p group by run""")
def status_transitions(spark, d):
    e = tables.table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").alias("run"), seq.alias("seq"), "event_type").withColumn("status", F.when(F.col("seq") == 1, "open").otherwise(F.col("event_type")))
    found = mu.transitions(rows, [("open", "click"), ("click", "view"), ("view", "purchase"), ("view", "view")])
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("ok"))


@query("""
with r as (select conv_id as pack, role as lane, turn as rank, row_number() over (partition by conv_id, role order by turn) as nth from conversations)
select pack, lane, rank from r where nth <= case lane when 'user' then 2 when 'assistant' then 1 else 0 end""")
def multi_scope_pack(spark, d):
    t = tables.turns(spark, d).select(F.col("run").alias("pack"), F.col("agent").alias("lane"), F.col("seq").alias("rank"))
    return mu.quota_pack(t, {"user": 2, "assistant": 1}).select("pack", "lane", "rank")


@query("""
with b as (select event_type as category, round(avg(value), 4) as was from events where ts < timestamp '2024-01-15' group by 1), c as (select event_type as category, round(avg(value), 4) as metric from events where ts >= timestamp '2024-01-15' group by 1),
r as (select round(avg(metric - was), 6) as gain, bool_and(coalesce(metric >= was - 5, false)) as sound from b left join c using (category))
select gain, sound, sound and gain > 0.5 as accepted from r""")
def strict_ratchet(spark, d):
    e = tables.table(spark, d, "events")
    mean = lambda rows: rows.groupBy(F.col("event_type").alias("category")).agg(F.round(F.avg("value"), 4).alias("metric"))
    return mu.ratchet(mean(e.where("ts >= timestamp_ntz '2024-01-15'")), mean(e.where("ts < timestamp_ntz '2024-01-15'")), 0.5, 5)


@query("""
select 'evt:' || event_id as id, 'user:' || user_id as who, event_type as what, strftime(ts, '%Y-%m-%d') as "when", json_extract_string(props, '$.k') as "how" from events""")
def event_facets(spark, d):
    """Who, what, when and how of each event: what it says itself, else its fields."""
    return pr.facets(tables.event_records(spark, d))
