"""Contexts for a task, from facts, entities, episodes and what has been derived from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memspark.operators import context as cx
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

TASK, NOW = "Urgent orders of customer 000000007: 1-urgent, onthe?", datetime(1998, 6, 1)
HEADER = "CONTEXT|local|project|1998-06-01|" + TASK
BUDGET, RESERVE = 6_000, 2_500


def _candidates(spark, d):
    """Orders are facts, customers entities and documents episodes; a customer's count of orders is an observation, which
    stands on its first and last order. Orders of status P and customers in debt are not current."""
    orders, customers, docs = (tables.table(spark, d, t) for t in ("orders", "customer", "documents"))
    clm, cust = tables.tagged("clm", "o_orderkey"), tables.tagged("cust", "o_custkey")
    none, ids = F.lit(None).cast("string"), lambda *c: F.array(*c)
    usual = {"ns": F.lit("local"), "scope": F.lit("project"), "valid_until": F.lit(None).cast("timestamp"), "current": F.lit(True), "product_id": none, "task_tags": F.array().cast("array<string>")}
    names = [x.strip().split(" ")[0] for x in cx.CANDIDATE.split(",")]
    row = lambda df, **c: df.select(*[(usual | c)[n].alias(n) for n in names])
    trust = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_totalprice") > 50000, "supported").otherwise("unverified")
    facts = row(
        orders, candidate_id=F.concat(F.lit("fact:"), clm), kind=F.lit("fact"), text=F.concat_ws(" ", cust, F.lower("o_orderpriority"), "o_orderstatus"), trust_state=trust,
        occurred_at=F.col("o_orderdate"), record_ids=ids(clm), episode_ids=ids(F.concat(F.lit("episode:"), cust)), entity_ids=ids(cust), task_tags=ids(F.col("o_orderpriority")),
        ns=F.when(F.col("o_custkey") < 5, "other").otherwise("local"), valid_until=F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate") + F.expr("interval 400 days")),
    )
    key = tables.tagged("cust", "c_custkey")
    entities = row(
        customers, candidate_id=F.concat(F.lit("entity:"), key), kind=F.lit(" Entity"), text=F.col("c_name"), trust_state=F.lit("Supported"), occurred_at=F.lit(datetime(1997, 1, 1)),
        record_ids=ids(key), episode_ids=ids(F.concat(F.lit("episode:"), key)), entity_ids=ids(key),
    )
    raw = tables.tagged("raw", "doc_id")
    episodes = row(
        docs, candidate_id=F.concat(F.lit("episode:"), raw), kind=F.lit("episode"), text=F.col("text"), trust_state=F.lit("supported"), occurred_at=F.lit(datetime(1998, 5, 1)), record_ids=ids(raw),
        episode_ids=ids(F.concat(F.lit("episode:"), raw)), entity_ids=F.array().cast("array<string>"),
    )
    seen = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.max("o_orderdate").alias("t"))
    derived = row(
        seen, candidate_id=F.concat(F.lit("seen:"), cust), kind=F.lit("observation"), text=F.concat_ws(" ", cust, F.lit("has"), F.col("n").cast("string"), F.lit("orders")), trust_state=F.lit("supported"),
        occurred_at=F.col("t"), record_ids=ids(tables.tagged("clm", "a"), tables.tagged("clm", "b")), episode_ids=ids(F.concat(F.lit("episode:"), cust)), entity_ids=ids(cust),
        product_id=F.when(F.col("n") > 8, F.concat(F.lit("product:"), cust)),
    )
    current = orders.where("o_orderstatus != 'P'").select(clm.alias("id")).unionByName(customers.where("c_acctbal >= 0").select(key.alias("id"))).unionByName(docs.select(raw.alias("id")))
    return cx.supported(facts.unionByName(entities).unionByName(episodes).unionByName(derived), current)


SQL = """
with o as (select *, 'clm:' || o_orderkey as clm, 'cust:' || o_custkey as cust from orders),
s as (select cust, count(*) as n, min(o_orderkey) as a, max(o_orderkey) as b, max(o_orderdate) as t from o group by cust),
c as (
  select 'fact:' || clm as candidate_id, 'fact' as kind, cust || ' ' || lower(o_orderpriority) || ' ' || o_orderstatus as text, case when o_custkey < 5 then 'other' else 'local' end as ns,
         case when o_orderstatus = 'F' then 'verified' when o_totalprice > 50000 then 'supported' else 'unverified' end as trust, o_orderdate as happened,
         case when o_orderpriority = '5-LOW' then o_orderdate + interval 400 day end as ends, [clm] as records, ['episode:' || cust] as episodes, [cust] as entities, null as product, o_orderpriority as tag
  from o where o_orderstatus <> 'P'
  union all select 'entity:cust:' || c_custkey, 'entity', c_name, 'local', 'supported', timestamp '1997-01-01', null, ['cust:' || c_custkey], ['episode:cust:' || c_custkey], ['cust:' || c_custkey], null, ''
  from customer where c_acctbal >= 0
  union all select 'episode:raw:' || doc_id, 'episode', text, 'local', 'supported', timestamp '1998-05-01', null, ['raw:' || doc_id], ['episode:raw:' || doc_id], [], null, '' from documents
  union all select 'seen:' || cust, 'observation', cust || ' has ' || n || ' orders', 'local', 'supported', t, null, ['clm:' || a, 'clm:' || b], ['episode:' || cust], [cust],
         case when n > 8 then 'product:' || cust end, '' from s
  where a not in (select o_orderkey from orders where o_orderstatus = 'P') and b not in (select o_orderkey from orders where o_orderstatus = 'P')),
j as (
  select *, len(list_intersect(list_distinct(regexp_extract_all(lower(text || ' ' || tag), '[\\p{L}\\p{N}_]+')), ['urgent', 'orders', 'of', 'customer', '000000007', '1', 'onthe'])) as task_score,
         case when coalesce(trim(text), '') = '' then 'malformed' when ns <> 'local' then 'boundary' when trust = 'unverified' then 'trust'
              when happened > timestamp '1998-06-01' or ends <= timestamp '1998-06-01' then 'time' when kind = 'observation' and product is null then 'derived_without_product' end as reason
  from c)"""


@query(SQL + " select candidate_id, kind, reason, task_score, 1::bigint as copies from j")
def context_candidates(spark, d):
    """Every candidate whose supports are current, and why it may not enter."""
    rows = cx.judged(_candidates(spark, d), TASK, "local", "project", F.lit(NOW))
    return rows.select("candidate_id", "kind", "reason", "task_score", "copies")


@query(SQL.replace("with o as", "with recursive o as", 1) + f""",
k as (select candidate_id, kind, 1 + octet_length(encode('ITEM|' || to_json({{'candidate_id': candidate_id, 'entity_ids': entities, 'episode_ids': episodes, 'kind': kind,
        'occurred_at': strftime(happened, '%Y-%m-%dT%H:%M:%SZ'), 'product_id': product, 'record_ids': records, 'task_score': task_score, 'text': text, 'trust_state': trust}}))) as bytes,
      row_number() over (order by case trust when 'verified' then 2 else 1 end desc, task_score desc, happened desc,
        list_position(['fact', 'entity', 'episode', 'observation'], kind), candidate_id) as pos from j where reason is null),
size as (select {len(HEADER.encode())} as h),
room as (select 4 * least({BUDGET}, (h + 3) // 4 + least({RESERVE}, {BUDGET} - (h + 3) // 4)) as facts, 4 * {BUDGET} as everything from size),
f(pos, used, step) as (select 0::bigint, (select h from size)::bigint, 0 union all
  select min(k.pos), arg_min(f.used + k.bytes, k.pos), max(f.step) + 1 from f, k, room where k.kind = 'fact' and k.pos > f.pos and f.used + k.bytes <= room.facts having count(*) > 0),
g(pos, used, step) as (select 0::bigint, max(used), max(step) from f union all
  select min(k.pos), arg_min(g.used + k.bytes, k.pos), max(g.step) + 1 from g, k, room where k.pos > g.pos and k.pos not in (select pos from f) and g.used + k.bytes <= room.everything having count(*) > 0)
select (step - 1)::int as pos, candidate_id, bytes::bigint as bytes from (select pos, step from f where pos > 0 union all select pos, step from g where pos > 0) join k using (pos)""")
def context_assembly(spark, d):
    """The context itself: its lines in order, with their cost."""
    rows = cx.judged(_candidates(spark, d), TASK, "local", "project", F.lit(NOW))
    found = cx.assembled(rows, HEADER, BUDGET, RESERVE)
    return found.select("pos", "candidate_id", (F.octet_length("line") + 1).cast("long").alias("bytes"))
