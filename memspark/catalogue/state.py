"""Eligibility, supersession, scans and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.operators import graph
from memspark.plans import query as pq
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
with recursive r(id, ref) as (select 'line:' || l_orderkey || ':' || l_linenumber, 'clm:' || l_orderkey from lineitem
                              union all select 'clm:' || o_orderkey, 'cust:' || o_custkey from orders),
bad(id) as (select 'clm:' || o_orderkey from orders where o_orderstatus = 'P' union select r.id from r join bad on r.ref = bad.id),
n as (select 'line:' || l_orderkey || ':' || l_linenumber as id from lineitem union all select 'clm:' || o_orderkey from orders union all select 'cust:' || c_custkey from customer)
select split_part(id, ':', 1) as kind, count(*) as n from n where id not in (select id from bad) group by 1""")
def eligible_transitive(spark, d):
    """Lines refer to claims, claims to customers; a superseded claim takes its lines along."""
    claims = tables.claim_records(spark, d)
    line = tables.table(spark, d, "lineitem").dropna(subset=["l_orderkey", "l_linenumber"])  # what lacks a key has no id
    lines = line.select(F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber").alias("id"), F.lit(True).alias("current"), tables.tagged("clm", "l_orderkey").alias("ref"), F.lit("line").alias("kind"))
    people = tables.table(spark, d, "customer").select(tables.tagged("cust", "c_custkey").alias("id"), F.lit(True).alias("current"), F.lit("cust").alias("kind"))
    records = claims.select("id", pq.current(F.col("status")).alias("current"), F.lit("clm").alias("kind")).unionByName(people).where("id is not null")
    kept = graph.eligible(records, claims.select("id", F.col("subject").alias("ref")), lines)  # a line's id has its claim's key
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct lang as ns from documents order by ns limit 100")
def namespace_listing(spark, d):
    return tables.raw_records(spark, d).select("ns").distinct().orderBy("ns").limit(100)


@query("select 'clm:' || o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, id limit 25")
def record_summaries(spark, d):
    rows = tables.claim_records(spark, d).orderBy(F.desc("t0"), "id").limit(25)
    return rows.select("id", F.date_format("t0", "yyyy-MM-dd").alias("day"))


@query("""
select 'raw:' || doc_id as id, source as source_ref, n_chars from documents where lang = 'de'""")
def boundary_scan(spark, d):
    """All records of one namespace: the filter and three columns reach the scan."""
    docs = tables.table(spark, d, "documents").where("lang = 'de'")
    return docs.select(tables.tagged("raw", "doc_id").alias("id"), F.col("source").alias("source_ref"), "n_chars")


@query("""
with ids(pos, id) as (values (0, 'clm:7'), (1, 'clm:3'), (2, 'clm:999999999'), (3, 'clm:1'), (4, 'clm:32'))
select pos, id, o_orderstatus as object from ids join orders on id = 'clm:' || o_orderkey""")
def point_load_in_order(spark, d):
    """Records by id, with the place of each id in the request."""
    asked = spark.createDataFrame(list(enumerate(["clm:7", "clm:3", "clm:999999999", "clm:1", "clm:32"])), "pos int, id string")
    return tables.claim_records(spark, d).join(F.broadcast(asked), "id").select("pos", "id", "object")


@query("""
with r as (select source, doc_id, row_number() over (partition by source, lang order by n_chars desc, doc_id desc) as rn from documents)
select source as source_ref, count(*) as documents, sum((rn = 1)::int)::bigint as latest from r group by source""")
def latest_document_per_source(spark, d):
    """The generation that stays of each (namespace, source): the longest, then the newest document."""
    docs = tables.table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    # An aggregate keeps one struct a group and task: no window sorts a source that holds a third of all rows.
    last = docs.groupBy("source", "lang").agg(F.max(F.struct("n_chars", "doc_id")).alias("m"), F.count(F.lit(1)).alias("n"))
    return last.groupBy(F.col("source").alias("source_ref")).agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("latest"))


@query("""
select user_id, arg_max(event_type, event_id) as decision, max(event_id) as decision_id, count(*) as decisions from events group by user_id""")
def latest_decision(spark, d):
    e = tables.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("decision"), F.max("event_id").alias("decision_id"), F.count(F.lit(1)).alias("decisions"))


@query("""
select event_id, event_type from events where user_id = 17 and event_id > 100 order by event_id limit 50""")
def event_cursor(spark, d):
    """The page of a run's log after a cursor."""
    e = tables.table(spark, d, "events")
    return e.where("user_id = 17 and event_id > 100").orderBy("event_id").limit(50).select("event_id", "event_type")


@query("select event_id, user_id, event_type from events where event_type <> 'error' order by event_id desc limit 100")
def retrieval_event_log(spark, d):
    e = tables.table(spark, d, "events")
    return e.where("event_type != 'error'").orderBy(F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("""
select user_id as run, arg_max(case event_type when 'purchase' then 'completed' when 'error' then 'failed' end, event_id) filter (event_type in ('purchase', 'error')) as status,
       max(event_id) as last_event from events group by user_id""")
def run_status_fold(spark, d):
    """A run's status is its last completion or failure; null while it runs."""
    e = tables.table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    folded = e.groupBy(F.col("user_id").alias("run")).agg(F.max(F.when(status.isNotNull(), F.struct("event_id", status.alias("s"))))["s"].alias("status"), F.max("event_id").alias("last_event"))
    return folded


@query("""
with c as (select o_custkey, o_orderkey, o_orderdate, md5(coalesce(lag(o_orderkey) over w, 0) || '>' || o_orderkey) as link from orders
           window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_custkey as run, count(*) as events, min(link) as least_link from c group by o_custkey""")
def event_chain(spark, d):
    """Each event of a run is chained to the one before it."""
    o = tables.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.coalesce(F.lag("o_orderkey").over(w), F.lit(0))
    rows = o.select("o_custkey", F.md5(F.concat_ws(">", before, "o_orderkey")).alias("link"))
    return rows.groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("events"), F.min("link").alias("least_link"))
