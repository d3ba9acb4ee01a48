"""Probes that a graph makes of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import probes
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

PREDICATE = {"F": "caused_by", "O": "occurred_at", "P": "contradicts"}


def _probes(spark, d):
    """Orders are claims about customers, who are located in nations, and these in regions. An order's status says what it has to
    do with its customer; those of status F stand in an episode, those of status O are not verified."""
    orders, customers = tables.table(spark, d, "orders"), tables.table(spark, d, "customer")
    clm, cust = tables.tagged("clm", "o_orderkey"), tables.tagged("customer", "o_custkey")
    word = F.create_map(*[F.lit(x) for pair in PREDICATE.items() for x in pair])[F.col("o_orderstatus")]
    told = orders.select(clm.alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("label"), clm.alias("source"), F.when(F.col("o_orderstatus") != "P", F.array(*map(F.lit, ["when", "who"]))).otherwise(F.array(F.lit("who"))).alias("facets"))
    things = tables.nodes(spark, d).where("entity_type in ('customer', 'nation', 'region')").select("id", "label", F.lit("").alias("source"), F.array().cast("array<string>").alias("facets"))
    about = orders.select(F.concat(F.lit("e:"), clm).alias("id"), clm.alias("src"), word.alias("predicate"), cust.alias("dst"), F.lit("semantic").alias("edge_kind"), clm.alias("source"))
    places = tables.place_edges(spark, d).where("src not like 'supplier%'")
    places = places.select(F.concat(F.lit("e:"), "src").alias("id"), "src", "predicate", "dst", F.lit("semantic").alias("edge_kind"), F.lit("").alias("source"))
    links = orders.where("o_orderstatus = 'F'").select(clm.alias("node"), F.concat(F.lit("ep:"), cust).alias("episode"), cust.alias("source"))
    trust = orders.select(clm.alias("id"), F.when(F.col("o_orderstatus") == "O", "unverified").otherwise("supported").alias("state"))
    return probes.generated(told.unionByName(things), about.unionByName(places), links, trust)


SQL = """
with o as (select 'clm:' || o_orderkey as clm, 'customer:' || o_custkey as cust, o_orderstatus as s, o_orderpriority || ' ' || o_orderstatus as label from orders),
n as (select 'customer:' || c_custkey as id, c_name as label, 'nation:' || c_nationkey as above from customer union all select 'nation:' || n_nationkey, n_name, 'region:' || n_regionkey from nation
  union all select 'region:' || r_regionkey, r_name, null from region),
up as (select a.id, a.label, b.id as b, b.label as b_label, c.id as c, c.label as c_label from n a join n b on a.above = b.id left join n c on b.above = c.id),
p as (
  select 'five_w_one_h_then' as motif, 'Recover the who, when context for ' || label as query, [clm] as expected, [clm] as sources, []::varchar[] as episodes, 'retrieve' as action from o where s <> 'P'
  union all select case s when 'F' then 'causal' when 'O' then 'temporal' else 'contradiction' end,
    'What does ' || o.label || ' ' || case s when 'F' then 'caused_by' when 'O' then 'occurred_at' else 'contradicts' end || ' with respect to ' || n.label || '?', [clm, cust], [clm], [],
    case s when 'P' then 'surface_dispute' else 'retrieve' end from o join n on cust = n.id
  union all select 'multi_hop', 'Trace from ' || o.label || ' through ' || up.label || ' to ' || b_label, [clm, cust, b], [clm], [], 'retrieve' from o join up on cust = up.id
  union all select 'multi_hop', 'Trace from ' || label || ' through ' || b_label || ' to ' || c_label, [id, b, c], [], [], 'retrieve' from up where c is not null
  union all select 'provenance', 'Which episode supports or produced ' || label || '?', [clm], [cust], ['ep:' || cust], 'retrieve' from o where s = 'F'
  union all select 'unsupported', 'Can this be asserted as established knowledge: ' || label || '?', [clm], [clm], [], 'abstain_or_qualify' from o where s = 'O'),
q as (select *, 'graph:' || motif || ':' || substr(sha256(motif || chr(31) || query || chr(31) || array_to_string(expected, chr(30)) || chr(31) || coalesce(array_to_string(sources, chr(30)), '') || chr(31)
    || coalesce(array_to_string(episodes, chr(30)), '') || chr(31) || action), 1, 16) as case_id from p)"""


@query(SQL + " select case_id, motif, query, array_to_string(expected, ' ') as expected, coalesce(array_to_string(sources, ' '), '') as sources, coalesce(array_to_string(episodes, ' '), '') as episodes, action from q")
def graph_probes(spark, d):
    joined = [F.array_join(c, " ").alias(c) for c in ("expected", "sources", "episodes")]
    return _probes(spark, d).select("case_id", "motif", "query", *joined, "action")


@query(SQL + """,
r as (select case_id, motif, row_number() over (partition by motif order by sha256('1234:' || case_id), case_id) - 1 as nth, greatest(1, count(*) over (partition by motif) // 5) as held from q),
t as (select case_id, motif, case when nth < held then 'holdout' else 'dev' end as side, case when nth < held then nth else nth - held end as turn from r)
select case_id, motif, side from t qualify row_number() over (partition by side order by turn, motif) <= 100""")
def graph_probe_split(spark, d):
    """A hundred probes to tune by and a hundred others to hold out, in turn from each family."""
    return probes.split(_probes(spark, d), 100)
