"""Fidelity metrics, probes, readable search, grounded facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import fidelity as fi
from memspark.operators import knowledge as kn
from memspark.sources import tables

from .knowledge import TRUST, _trust
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
with s as (select source as id, sum(ceil(octet_length(encode(text)) / 4.0))::bigint as source_tokens from documents group by source),
k as (select source as id, sum(ceil(octet_length(encode(t)) / 4.0))::bigint as kept from (select distinct source, text as t from documents) group by source)
select id, round(source_tokens::double / greatest(kept, 1), 6) as ratio from s join k using (id)""")
def compression_ratio(spark, d):
    """Tokens of each source against those of its distinct texts."""
    docs = tables.table(spark, d, "documents").select(F.col("source").alias("id"), "text")
    cost = F.sum(tx.token_estimate(F.col("text")))
    whole = docs.groupBy("id").agg(cost.alias("source_tokens"))
    return fi.compression(whole.join(docs.distinct().groupBy("id").agg(cost.alias("kept_tokens")), "id"))


@query("""
with c as (select o_custkey, list_distinct(list(o_orderpriority)) as required, list_distinct(list(o_orderpriority) filter (o_orderstatus <> 'P')) as recovered from orders group by o_custkey)
select count(*) as cases, round(avg(case when len(list_filter(required, lambda x: not list_contains(coalesce(recovered, []), x))) = 0 then 1 else 0 end), 6) as rate from c""")
def reconstruction_rate(spark, d):
    o = tables.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("required"), F.collect_set(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).alias("recovered")
    )
    return fi.reconstruction(o)


@query("""
with f as (select distinct o_custkey as "case", o_orderpriority as s, o_orderstatus as r, year(o_orderdate) as o from orders where o_orderstatus <> 'P'),
t as (select distinct o_custkey as "case", o_orderpriority as s, 'F' as r, year(o_orderdate) as o from orders where o_orderstatus = 'P'),
m as (select f.*, max(coalesce(((f.s = t.s)::int + (f.r = t.r)::int + (f.o = t.o)::int) / 3.0::double, 0)) as m from f left join t on f."case" = t."case" group by all)
select count(*) as facts, round(avg(m), 6) as retention from m""")
def semantic_retention(spark, d):
    """Facts of each customer against the triples of their superseded claims."""
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("relation"), F.year("o_orderdate").alias("object"))
    facts = o.where("relation != 'P'").distinct()
    triples = o.where("relation = 'P'").withColumn("relation", F.lit("F")).distinct()
    return fi.retention(facts, triples)


@query()
def cloze_probes(spark, d):
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return fi.cloze(b, seed=7).orderBy("place", "id")


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
w(t) as (values ('onthe'), ('thing')), s as (select doc_id || '.' || pos as id, contains(lower(line), 'onthe thing')::int as phrase, contains(line, '"') as quoted,
  (list_contains(regexp_extract_all(lower(line), '[a-z0-9_:-]+'), 'onthe')::int + list_contains(regexp_extract_all(lower(line), '[a-z0-9_:-]+'), 'thing')::int) / 2.0::double as share from l)
select id, round((phrase + share + case when quoted then 0.25 else 0 end)::double, 9) as score from s where phrase + share > 0 order by score desc, id limit 25""")
def readable_query(spark, d):
    lines = tables.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    chunks = lines.select(F.concat_ws(".", "doc_id", "pos").alias("id"), "content", F.contains("content", F.lit('"')).alias("quoted"))
    return fi.readable_hits(chunks, "onthe thing", 25).select("id", "score")


@query("""
select 'part' || l_partkey || '-' || l_linenumber || '-' || l_orderkey as id, (list_has_any(string_split(lower(p_name), ' '), ['blue', 'bolt']))::int::double as score
from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R'""")
def entity_grounded(spark, d):
    """Lines whose part's name shares a token with the query."""
    line = tables.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    claims = line.select(F.concat(F.lit("part"), F.concat_ws("-", "l_partkey", "l_linenumber", "l_orderkey")).alias("id"), tables.tagged("part", "l_partkey").alias("subject"))
    return fi.grounded(claims, tables.nodes(spark, d).where("entity_type = 'part'"), "blue bolt")


@query("""
with i as (select 'clm:' || o_orderpriority || ':' || o_orderkey as id from orders), s as (select unnest(string_split(id, ':')) as segment from i), c as (select segment, count(*) as n, ceil(octet_length(encode(segment)) / 4.0)::bigint as cost from s group by segment)
select segment, n, n * (cost - 1) - (cost + 1) as saved from c where n >= 2 and cost >= 3 and n * (cost - 1) - (cost + 1) > 0""")
def id_aliases(spark, d):
    o = tables.table(spark, d, "orders")
    return fi.aliases(o.select(F.concat_ws(":", F.lit("clm"), "o_orderpriority", "o_orderkey").alias("id")))


@query("""
with r as (select conv_id as q, 'r' || turn as id, row_number() over (partition by conv_id order by turn) as rank from conversations),
f as (select conv_id as q, 'f' || turn as id, row_number() over (partition by conv_id order by length(text) desc, turn) as rank from conversations where role = 'user'),
b as (select q, id, 'raw' as origin, rank::double as at_ from r union all select q, id, 'fact', rank * 4 + 0.5 from f where rank <= 2),
p as (select q, id, origin, cast(row_number() over (partition by q order by at_, id) as integer) as place from b)
select q, id, origin, place from p where place <= 10""")
def derived_fact_splice(spark, d):
    from pyspark.sql import Window

    t = tables.turns(spark, d)
    rank = lambda *by: F.row_number().over(Window.partitionBy("run").orderBy(*by))
    rows = t.select(F.col("run").alias("q"), F.concat(F.lit("r"), F.col("seq").cast("string")).alias("id"), rank("seq").alias("rank"))
    users = t.where("agent = 'user'")
    facts = users.select(F.col("run").alias("q"), F.concat(F.lit("f"), F.col("seq").cast("string")).alias("id"), rank(F.desc(F.length("text")), "seq").alias("rank"))
    return fi.spliced(rows, facts, 10)


@query("""
with n as (select 'supplier:' || s_suppkey as id from supplier union all select 'part:' || p_partkey from part where p_size > 10),
e as (select 'supplier:' || l_suppkey as src, 'part:' || l_partkey as dst, count(*) as records from lineitem group by 1, 2)
select src, count(*) as edges, sum(records)::bigint as records from e where src in (select id from n) and dst in (select id from n) group by src""")
def canonical_relations(spark, d):
    """Edges that a relation record backs and whose ends are both canonical entities."""
    nodes = tables.table(spark, d, "supplier").select(tables.tagged("supplier", "s_suppkey").alias("id"))
    nodes = nodes.unionByName(tables.table(spark, d, "part").where("p_size > 10").select(tables.tagged("part", "p_partkey").alias("id")))
    e = tables.supply_edges(spark, d).select("src", "dst", "shipments")
    for end in ("src", "dst"):
        e = e.join(nodes.withColumnRenamed("id", end), end, "left_semi")
    return e.groupBy("src").agg(F.count(F.lit(1)).alias("edges"), F.sum("shipments").alias("records"))


@query(
    TRUST
    + """
select c_mktsegment, o_orderpriority, state, count(*) as facts, sum(support)::bigint as support from t join orders on t.id = o_orderkey join customer on o_custkey = c_custkey
where state in ('supported', 'verified') group by all"""
)
def current_facts(spark, d):
    """Claims that may be asserted, with their subject's segment and how many independent keys support them."""
    states = kn.assertable(_trust(spark, d))
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority")
    c = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    facts = states.join(o, "id").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return facts.groupBy("c_mktsegment", "o_orderpriority", "state").agg(F.count(F.lit(1)).alias("facts"), F.sum("support").alias("support"))
