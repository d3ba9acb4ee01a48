"""Verification, coreference, symbols, chunks, indexes, views of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import records as rec
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
with c as (select 'clm:' || o_orderkey as id, o_totalprice / 400000 as conf, case when o_orderpriority = '5-LOW' then '' else lower(o_orderpriority) end as predicate,
                  case when o_orderstatus = 'P' then 'pending' else 'asserted' end as status, 'raw:' || o_custkey as ev from orders),
i as (select id, 'invalid_confidence' as code from c where not conf between 0 and 1 union all select id, 'missing_predicate' from c where predicate = ''
      union all select id, 'invalid_status' from c where status = 'pending'
      union all select id, 'missing_evidence' from c where ev not in (select 'raw:' || doc_id from documents)
      union all select 'raw:' || doc_id, 'missing_content' from documents where text = '')
select code, count(*) as n, count(distinct id) as records from i group by code""")
def verify_report(spark, d):
    o = tables.table(spark, d, "orders")
    attrs = F.create_map(F.lit("subject"), F.col("o_custkey").cast("string"), F.lit("predicate"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.lower("o_orderpriority")), F.lit("object"), F.col("o_orderstatus"))
    claims = o.select(
        tables.tagged("clm", "o_orderkey").alias("id"), F.lit("CLM").alias("kind"), F.lit("local.default").alias("ns"), F.lit("project").alias("scope"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise("asserted").alias("status"), (F.col("o_totalprice") / 400000).alias("conf"), attrs.alias("attrs"),
    )
    raws = tables.raw_records(spark, d).select("id", "kind", "ns", "scope", "status", "conf", F.create_map(F.lit("content"), F.col("content")).alias("attrs"))
    references = o.select(tables.tagged("clm", "o_orderkey").alias("id"), tables.tagged("raw", "o_custkey").alias("ref"), F.lit("evidence").alias("role"))
    found = rec.issues(claims.unionByName(raws), references)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("records"))


def _entities(spark, d):
    c = tables.table(spark, d, "customer")
    return c.select(tables.tagged("customer", "c_custkey").alias("id"), F.col("c_mktsegment").alias("ns"), F.col("c_nationkey").alias("scope"), F.floor(F.col("c_acctbal") / 1000).alias("identity"), F.col("c_custkey").alias("created_at"))


@query("""
select 'customer:' || c_custkey as id, 'customer:' || min(c_custkey) over (partition by c_mktsegment, c_nationkey, floor(c_acctbal / 1000)) as canonical from customer""")
def coreference_first(spark, d):
    return rec.coreferent(_entities(spark, d))


@query("""
with m as (select c_custkey, min(c_custkey) over (partition by c_mktsegment, c_nationkey, floor(c_acctbal / 1000)) as k from customer)
select 'customer:' || k as subject, count(*) as claims, count(distinct o_custkey) as members from orders join m on o_custkey = c_custkey group by k""")
def reference_remap(spark, d):
    """Claims follow their subject to its canonical entity."""
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", tables.tagged("customer", "o_custkey").alias("subject"))
    moved = rec.remap(o, rec.coreferent(_entities(spark, d)), ["subject"])
    return moved.groupBy("subject").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("o_custkey").alias("members"))


@query("""
with e as (select distinct l_suppkey, l_partkey, l_returnflag from lineitem)
select 'supplier:' || l_suppkey as src, 'supplies' as type, 'part:' || l_partkey as dst, string_agg(l_returnflag, ',' order by l_returnflag) as owners from e group by l_suppkey, l_partkey""")
def owned_edges(spark, d):
    line = tables.table(spark, d, "lineitem")
    edges = line.select(tables.tagged("supplier", "l_suppkey").alias("src"), F.lit("supplies").alias("type"), tables.tagged("part", "l_partkey").alias("dst"), F.col("l_returnflag").alias("owner"))
    return rec.owned_edges(edges).withColumn("owners", F.array_join("owners", ","))


@query("""
with m as (select p_brand as ns, p_name as expansion from part where length(p_name) >= 4),
c as (select ns, expansion, count(*) as frequency, substr(list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(expansion), '[_ ]'), lambda p: p <> ''), lambda p: substr(p, 1, 2)), 'string_agg', ''), 1, 4) as symbol
      from m group by ns, expansion),
s as (select symbol, count(distinct expansion) as n from c group by symbol)
select ns, expansion, symbol, frequency, round((n - 1) / n, 4)::double as ambiguity from c join s using (symbol) where frequency >= 2""")
def symbol_proposals(spark, d):
    return rec.symbols(tables.table(spark, d, "part").select(F.col("p_brand").alias("ns"), F.col("p_name").alias("expansion")))


@query("""
with t as (select doc_id, text from documents where lang = 'en'), w as (select doc_id, unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{3,})', 1)) as term from t),
c as (select term, count(distinct doc_id) as n from w group by term)
select term, n from c where lower(term) not in ('the', 'thing') order by n desc, term limit 20""")
def bridge_terms(spark, d):
    """Capitalised words in mid-sentence, by how many results have them, without those of the query."""
    docs = tables.raw_records(spark, d).where("ns = 'en'")
    terms = docs.select("id", F.explode(F.regexp_extract_all("content", F.lit("[a-z,] ([A-Z][a-z]{3,})"), F.lit(1))).alias("term"))
    counted = terms.where(~F.lower("term").isin("the", "thing")).groupBy("term").agg(F.countDistinct("id").alias("n"))
    return counted.orderBy(F.desc("n"), "term").limit(20)


@query("""
with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_:-]+')) as token from benchmark), f as (select token, item_id, count(*) as tf from w group by all)
select token, count(*) as df, sum(tf)::bigint as cf, min(item_id) as first_id from f group by token""")
def readable_inverted_index(spark, d):
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return rec.inverted(b, tx.tokens(F.col("text")))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
select md5(chunk) as chunk_id, count(*) as occurrences, min({'i': doc_id, 'p': pos}).i as first_id, cast(min({'i': doc_id, 'p': pos}).p as integer) as first_pos
from l where trim(chunk) <> '' group by chunk""")
def dedup_chunks(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return rec.chunks(docs)


@query("""
with f as (select conv_id as run, text, min(turn) as seq from conversations group by conv_id, text)
select run, seq, md5(text) as text_md5, cast(row_number() over (partition by run order by seq, text) as integer) as line from f""")
def conversation_view(spark, d):
    view = rec.numbered_view(tables.turns(spark, d))
    return view.select("run", F.col("at").alias("seq"), F.md5("text").alias("text_md5"), "line")


@query("""
select role as agent, count(*) as turns, sum(case when lower(text) similar to '.*(how many|list|all the).*' then 1 else 0 end)::bigint as completion,
       sum(ceil(octet_length(encode(text)) / 4.0))::bigint as tokens from conversations group by role""")
def conversation_costs(spark, d):
    """Turns of each agent, how many ask for a complete set, and the estimated tokens."""
    t = tables.turns(spark, d)
    return t.groupBy("agent").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.lower("text").rlike("(how many|list|all the)")).alias("completion"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens")
    )


@query("""
with b as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'O')
select case when b.o_orderkey is null then 'kept' else 'replaced' end as origin, count(*) as n, round(sum(case when b.o_orderkey is null then orders.o_totalprice else b.o_totalprice * 2 end), 2) as total
from orders left join b using (o_orderkey) group by 1""")
def record_upsert(spark, d):
    o = tables.table(spark, d, "orders").select(tables.tagged("clm", "o_orderkey").alias("id"), F.lit("CLM").alias("kind"), F.col("o_totalprice").alias("price"), "o_orderstatus", F.lit("kept").alias("origin"))
    batch = o.where("o_orderstatus = 'O'").withColumn("price", F.col("price") * 2).withColumn("origin", F.lit("replaced"))
    return rec.upsert(o, batch).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))
