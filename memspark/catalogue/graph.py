"""Graph projection, statistics, visibility, traversal, products."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memspark.operators import graph
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

NODES = """
with nodes as (select 'region:' || r_regionkey as id, 'region' as entity_type, r_name as label from region
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'customer:' || c_custkey, 'customer', c_name from customer
  union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier union all select 'part:' || p_partkey, 'part', p_name from part),
places as (select 'nation:' || n_nationkey as src, 'located_in' as predicate, 'region:' || n_regionkey as dst from nation
  union all select 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey from customer
  union all select 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey from supplier),
supplies as (select 'supplier:' || l_suppkey as src, 'supplies' as predicate, 'part:' || l_partkey as dst, min(l_shipdate) as t0, max(l_shipdate) as t1,
                    round(1 - min(l_discount), 6) as confidence, count(*) as shipments from lineitem group by l_suppkey, l_partkey),
edges as (select src, predicate, dst from places union all select src, predicate, dst from supplies),
both_ways as (select src as u, dst as v from edges union all select dst, src from edges)"""
RECURSIVE = NODES.replace("with nodes", "with recursive nodes")


def _edges(spark, d):
    return tables.place_edges(spark, d).unionByName(tables.supply_edges(spark, d).select("src", "predicate", "dst"))


@query(NODES + " select entity_type, count(*) as n, min(label) as first_label from nodes group by entity_type")
def graph_project_nodes(spark, d):
    return tables.nodes(spark, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"))


@query(NODES + " select src, predicate, dst, shipments, confidence from supplies")
def graph_project_edges(spark, d):
    return tables.supply_edges(spark, d).select("src", "predicate", "dst", "shipments", "confidence")


@query(NODES + """
select predicate, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from edges group by predicate""")
def graph_stats(spark, d):
    return _edges(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(NODES + """,
g as (select n.id, count(v) as degree from nodes n left join both_ways b on n.id = b.u group by n.id)
select count(*) as nodes, sum((degree > 0)::int)::bigint as connected, sum((degree = 0)::int)::bigint as isolated, round(avg(degree), 6) as average,
       max(degree) as largest, arg_max(id, {'d': degree, 'i': id}) as largest_id from g""")
def degree_stats(spark, d):
    g = graph.degrees(tables.nodes(spark, d), _edges(spark, d))
    return g.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") > 0).alias("connected"), F.count_if(F.col("degree") == 0).alias("isolated"),
        F.round(F.avg("degree"), 6).alias("average"), F.max("degree").alias("largest"), F.max_by("id", F.struct("degree", "id")).alias("largest_id"),
    )


@query(NODES + " select id from nodes where entity_type in ('part', 'supplier', 'customer') and id not in (select src from supplies) and id not in (select dst from supplies)")
def isolated_nodes(spark, d):
    """Entities that take no part in any supply."""
    ends = tables.supply_ends(spark, d)
    return tables.nodes(spark, d).where(F.col("entity_type").isin("part", "supplier", "customer")).select("id").join(ends, "id", "left_anti")


MOMENT = datetime(1995, 6, 17)


@query(NODES + """
select src, count(*) as n from supplies where t0 <= timestamp '1995-06-17' and t1 > timestamp '1995-06-17' group by src""")
def visible_edges_at(spark, d):
    return graph.visible(tables.supply_edges(spark, d), F.lit(MOMENT)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("""
with v as (select c_custkey, min(o_orderdate) as t0, case when max(o_orderstatus) = 'P' then max(o_orderdate) end as t1 from customer join orders on c_custkey = o_custkey group by c_custkey)
select 'customer:' || c_custkey as id from v where t0 <= timestamp '1995-06-17' and (t1 is null or t1 > timestamp '1995-06-17')""")
def visible_nodes_at(spark, d):
    """Customers are known from their first order, and until their last if one was superseded."""
    o = tables.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("t0"), F.when(F.max("o_orderstatus") == "P", F.max("o_orderdate")).alias("t1")
    )
    known = tables.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return graph.visible(known, F.lit(MOMENT)).select(tables.tagged("customer", "c_custkey").alias("id"))


@query("""
select o_custkey as customer, count(*) as claims, sum((o_orderdate <= timestamp '1995-06-17')::int)::bigint as then_known,
       sum((o_orderstatus <> 'P')::int)::bigint as now_current from orders group by o_custkey""")
def history_view(spark, d):
    c = tables.table(spark, d, "orders")
    return c.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("o_orderdate") <= F.lit(MOMENT)).alias("then_known"), F.count_if(F.col("o_orderstatus") != "P").alias("now_current")
    )


@query(RECURSIVE + """,
walk(id, hop) as (select 'region:1', 0 union select v, hop + 1 from walk join both_ways on id = u where hop < 3)
select id, min(hop) as hop from walk group by id""")
def k_hop_neighbors(spark, d):
    seeds = spark.createDataFrame([("region:1",)], "id string")
    return graph.k_hop(_edges(spark, d), seeds, 3)


@query(RECURSIVE + """,
walk(id, hop) as (select 'part:1', 0 union select v, hop + 1 from walk join both_ways on id = u where hop < 4)
select id, min(hop) as hop from walk where id like 'region:%' or id like 'nation:%' group by id""")
def shortest_paths(spark, d):
    seeds = spark.createDataFrame([("part:1",)], "id string")
    return graph.k_hop(_edges(spark, d), seeds, 4).where("id like 'region:%' or id like 'nation:%'")


@query(RECURSIVE + """,
walk(id, hop) as (select 'customer:5', 0 union select dst, hop + 1 from walk join edges on id = src where hop < 5)
select id, min(hop) as hop from walk group by id""")
def trace_closure(spark, d):
    seeds = spark.createDataFrame([("customer:5",)], "id string")
    return graph.k_hop(_edges(spark, d), seeds, 5, directed=True)


@query(RECURSIVE + """,
walk(id, hop) as (select 'nation:3', 0 union select v, hop + 1 from walk join both_ways on id = u where hop < 2),
r as (select id, min(hop) as hop from walk group by id), n as (select u, count(*) as n from both_ways group by u),
x as (select nodes.id, case when contains(lower(label), 'a') then 0.22 else 0 end as lex from nodes)
select r.id, hop, round((lex + least(0.6, coalesce(n, 0) * 0.1) + case when hop = 0 then 0.5 else 0 end)::double, 9) as score
from r join x on r.id = x.id left join n on r.id = n.u""")
def graph_leg_score(spark, d):
    seeds = spark.createDataFrame([("nation:3",)], "id string")
    edges = _edges(spark, d)
    lex = tables.nodes(spark, d).select("id", F.when(F.contains(F.lower("label"), F.lit("a")), 0.22).otherwise(0.0).alias("score"))
    return graph.leg_scores(graph.k_hop(edges, seeds, 2), edges, lex).withColumn("score", F.round("score", 9))


@query(NODES + """,
s as (select src as u, dst as v, confidence as c from supplies union all select dst, src, confidence from supplies),
h1 as (select v as id, max(1.0::double * 0.72 * c) as a from s where u = 'supplier:1' group by v),
h2 as (select v as id, max(a * 0.72 * c) as a from h1 join s on id = u group by v),
w as (select 'supplier:1' as id, 1.0::double as a, 0 as hop union all select id, a, 1 from h1 union all select id, a, 2 from h2)
select id, round(max(a), 6) as activation, arg_max(hop, {'a': a, 'h': -hop}) as hop from w group by id""")
def spreading_activation(spark, d):
    seeds = spark.createDataFrame([("supplier:1", 1.0)], "id string, score double")
    found = graph.activation(tables.supply_edges(spark, d), seeds)
    return found.select("id", F.round("activation", 6).alias("activation"), "hop")


@query(NODES + """,
s as (select src as u, dst as v, confidence as c from supplies union all select dst, src, confidence from supplies),
f0 as (select 'supplier:1' as id union select 'supplier:2'),
h1 as (select * from s where u in (select id from f0) and v not in (select id from f0) order by c desc, u, v limit 64),
f1 as (select v as id, min({'c': -c, 'u': u}).u as parent from h1 group by v),
h2 as (select * from s where u in (select id from f1) and v not in (select id from f0 union select id from f1) order by c desc, u, v limit 64),
f2 as (select v as id, min({'c': -c, 'u': u}).u as parent from h2 group by v)
select id, 0 as hop, null::varchar as parent from f0 union all select id, 1, parent from f1 union all select id, 2, parent from f2""")
def budgeted_traversal(spark, d):
    """Two hops of at most 64 edges each, the surest first."""
    seeds = spark.createDataFrame([("supplier:1",), ("supplier:2",)], "id string")
    return graph.budgeted_hops(tables.supply_edges(spark, d), seeds, hops=2, edge_budget=64)


@query(RECURSIVE + """,
links as (select 'u:' || user_id as a, 'k:' || props as b from events where event_type = 'error' union all select 'k:' || props, 'u:' || user_id from events where event_type = 'error'),
walk(id, other) as (select a, b from links union select walk.id, links.b from walk join links on walk.other = links.a)
select id, least(id, min(other)) as component from walk group by id""")
def connected_components(spark, d):
    """Users and properties that errors connect."""
    e = tables.table(spark, d, "events").where("event_type = 'error'")
    edges = e.select(tables.tagged("u", "user_id").alias("src"), F.concat(F.lit("k:"), "props").alias("dst"))
    return graph.components(edges)


@query(NODES + """
select src as id, count(*) as facts, string_agg(dst, ' ' order by confidence desc, dst) filter (rn <= 3) as summary from (
  select *, row_number() over (partition by src order by confidence desc, dst) as rn from supplies) group by src""")
def entity_summaries(spark, d):
    """An entity's number of facts and its three surest ones."""
    s = tables.supply_edges(spark, d)
    key = F.struct((-F.col("confidence")).alias("c"), "dst")
    best = F.array_sort(F.collect_list(key))  # three a salt at most
    first = graph.best_of_each(s, "src", [F.desc("confidence"), F.asc("dst")], 3)
    summary = first.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.slice(best, 1, 3), lambda x: x["dst"]), " ").alias("summary"))
    return s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("facts")).join(summary, "id")


@query("""
select 'user:' || user_id as subject, event_type as predicate, count(distinct cast(ts as date)) as episodes from events
group by user_id, event_type having count(distinct cast(ts as date)) >= 2""")
def recurring_observations(spark, d):
    e = tables.event_records(spark, d).select(F.col("actor").alias("subject"), F.col("action").alias("predicate"), F.to_date("t0").alias("episode"))
    return graph.recurring(e, 2)


@query("""
with s as (select n_nationkey as k, md5(n_name) as f, 1 + n_regionkey as v from nation), p as (select n_nationkey as k, md5(case when n_regionkey = 2 then n_name || '*' else n_name end) as f from nation where n_regionkey < 4
  union all select 1000, md5('new'))
select 'nation:' || p.k as product, p.f as fingerprint, case when s.f = p.f then s.v else coalesce(s.v, 0) + 1 end as version, coalesce(s.f <> p.f, true) as written
from p left join s using (k)""")
def product_versions(spark, d):
    n = tables.table(spark, d, "nation")
    stored = n.select(tables.tagged("nation", "n_nationkey").alias("product"), F.md5("n_name").alias("fingerprint"), (F.col("n_regionkey") + 1).alias("version"))
    made = n.where("n_regionkey < 4").select(tables.tagged("nation", "n_nationkey").alias("product"), F.md5(F.when(F.col("n_regionkey") == 2, F.concat("n_name", F.lit("*"))).otherwise(F.col("n_name"))).alias("fingerprint"))
    new = spark.range(1).select(F.lit("nation:1000").alias("product"), F.md5(F.lit("new")).alias("fingerprint"))
    return graph.new_versions(made.unionByName(new), stored)


@query(NODES + """,
r as (select src, case predicate when 'supplies' then (case when shipments > 1 then 'supports' else 'precedes' end) else predicate end as predicate, shipments from supplies union all select src, predicate, 1 from places)
select case predicate when 'supports' then 'epistemic' when 'precedes' then 'temporal' else 'semantic' end as family, count(*) as edges, sum(shipments)::bigint as records from r group by 1""")
def predicate_families(spark, d):
    s = tables.supply_edges(spark, d).select("src", F.when(F.col("shipments") > 1, "supports").otherwise("precedes").alias("predicate"), "shipments")
    r = s.unionByName(tables.place_edges(spark, d).select("src", "predicate", F.lit(1).cast("long").alias("shipments")))
    return r.groupBy(graph.family(F.col("predicate")).alias("family")).agg(F.count(F.lit(1)).alias("edges"), F.sum("shipments").alias("records"))


@query(NODES + " select predicate, count(*) as edges from edges where predicate = 'located_in' group by predicate")
def admitted_edges(spark, d):
    return graph.admitted(_edges(spark, d)).groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"))


@query(NODES + """,
p as (select 'out' as direction, predicate, dst as other from edges where src = 'nation:3' union all select 'in', predicate, src from edges where dst = 'nation:3')
select direction, predicate, other, label from p left join nodes on other = nodes.id""")
def node_page(spark, d):
    return graph.node_page(tables.nodes(spark, d), _edges(spark, d), "nation:3")


@query(NODES + """,
d as (select id, count_if(o)::bigint as o, count_if(not o)::bigint as i from (select src as id, true as o from edges union all select dst, false from edges) group by id)
select 'edge' as motif, sum(o)::bigint as n from d union all select 'path', sum(o * i)::bigint from d
union all select 'fork', sum(o * (o - 1) // 2)::bigint from d union all select 'join', sum(i * (i - 1) // 2)::bigint from d""")
def graph_motifs(spark, d):
    return graph.motifs(_edges(spark, d))
