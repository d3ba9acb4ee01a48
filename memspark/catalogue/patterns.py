"""Reasoning patterns over customers, their orders and where they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import patterns as pt
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
with c as (select c_custkey as k, c_custkey - c_custkey % 2 as run, c_acctbal > 0 as current, c_nationkey as n, n_name, n_regionkey as r from customer join nation on c_nationkey = n_nationkey),
s as (select o_custkey as k, arg_max(o_orderstatus <> 'P', o_orderkey) as accepted from orders group by o_custkey),
b as (
  select c.k, 0 as cause, 'o:' || c.k as what from c left join s on s.k = c.k where not coalesce(accepted, false)
  union all select c.k, 1, 'v:' || v.v from c, lateral (select unnest([c.k, c.k + 1]) as v) v left join c o on o.k = v.v where not coalesce(o.current and o.run = c.run, false)
  union all select k, 2, 'nation:' || n from c where k % 10 = 3 or n = 7
  union all select k, 3, 'region:' || r from c where r in (1, 4)),
f as (select k, min({'c': cause, 'w': what}) as f from b group by k)
select 'p:' || c.k as pattern, f is null as valid, case f.c when 0 then 'outcome' when 1 then 'verification' when 2 then 'evidence' when 3 then 'knowledge' end as cause, f.w as what
from c left join f on c.k = f.k""")
def pattern_validity(spark, d):
    """A pattern a customer: its last order must not be open, two verifications must be current and of its run, its nation's record
    unchanged and of its namespace, and its region active."""
    c = tables.table(spark, d, "customer").join(tables.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, run = F.col("c_custkey"), F.col("c_custkey") - F.col("c_custkey") % 2
    drifted = F.concat("n_name", F.when(k % 10 == 3, " as it was").otherwise(""))
    patterns = c.select(
        tables.tagged("p", "c_custkey").alias("pattern"), run.alias("run"), tables.tagged("o", "c_custkey").alias("outcome"), F.lit("local").alias("ns"), F.lit("project").alias("scope"),
        F.array(F.concat(F.lit("v:"), k.cast("string")), F.concat(F.lit("v:"), (k + 1).cast("string"))).alias("verifications"),
        F.create_map(tables.tagged("nation", "n_nationkey"), pt.fingerprint(drifted)).alias("evidence"), F.array(tables.tagged("region", "n_regionkey")).alias("knowledge"),
    )
    statuses = tables.table(spark, d, "orders").select(tables.tagged("o", "o_custkey").alias("outcome"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("accepted").alias("status"))
    verifications = c.select(tables.tagged("v", "c_custkey").alias("id"), run.alias("run"), (F.col("c_acctbal") > 0).alias("current"))
    nations, regions = tables.table(spark, d, "nation"), tables.table(spark, d, "region")
    records = nations.select(tables.tagged("nation", "n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 7, "other").otherwise("local").alias("ns"), F.lit("project").alias("scope"), F.col("n_name").alias("payload"))
    nodes = regions.where("r_regionkey != 1").select(tables.tagged("region", "r_regionkey").alias("id"), F.lit("local").alias("ns"), F.lit("project").alias("scope"), F.when(F.col("r_regionkey") == 4, "stale").otherwise("asserted").alias("status"))
    return pt.validity(patterns, statuses, verifications, records, nodes)


@query("""
with r as (select event_id, user_id, event_type = 'purchase' as ok, event_type in ('purchase', 'error') as done, event_type = 'click' as later from events)
select 'p:' || user_id as pattern, count(*) as uses, count_if(done and ok or later and event_id % 2 = 0) as successes, count_if(done and not ok or later and event_id % 2 = 1) as failures, count_if(later) as disagreements
from r group by user_id""")
def pattern_uses(spark, d):
    """Events are uses of their user's pattern: purchases succeed, errors fail, and clicks are found later to have been either."""
    e = tables.table(spark, d, "events")
    uses = e.select(F.col("event_id").alias("use"), tables.tagged("p", "user_id").alias("pattern"))
    results = e.where("event_type in ('purchase', 'error')").select(F.col("event_id").alias("use"), (F.col("event_type") == "purchase").alias("succeeded"))
    later = e.where("event_type = 'click'").select(F.col("event_id").alias("use"), (F.col("event_id") % 2 == 0).alias("succeeded"))
    return pt.use_counts(uses, results, later)
