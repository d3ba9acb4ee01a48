"""Whole retrievals: a query is parsed, planned, run over its legs, fused and gated; text sources; streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from memspark import scratch
from memspark.functions import language as lg
from memspark.functions.language import NO_NAMES
from memspark.plans import query as pq
from memspark.plans import retrieve as rt
from memspark.sources import free_text, tables
from memspark.sources import records as rs
from memspark.streaming import events as st

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _stores(spark, d):
    """Documents as records; the vectors of those that have one; documents of one source chained by an edge."""
    docs = tables.table(spark, d, "documents")
    records = tables.raw_records(spark, d).withColumn("t0", F.lit(None).cast("timestamp"))
    vectors = tables.table(spark, d, "embeddings").select(tables.tagged("raw", "vec_id").alias("id"), "embedding")
    last = docs.groupBy("source").agg(F.max("doc_id").alias("hub"))
    edges = docs.join(F.broadcast(last), "source").where("doc_id != hub")  # a row a source
    edges = edges.select(tables.tagged("raw", "doc_id").alias("src"), F.lit("same_source").alias("predicate"), tables.tagged("raw", "hub").alias("dst"))
    return rt.Stores(records, vectors, edges)


PROBE = [1.0 if i % 3 else -0.5 for i in range(64)]
SQL_PROBE = "[" + ",".join(str(x) for x in PROBE) + "]::double[]"

SQL_LEG = """
with s as (select 'raw:' || doc_id as id, lower(text) as t from documents where lang = 'en'),
h as (select id, contains(t, 'onthe')::int + contains(t, 'thing')::int as hits, contains(t, 'onthe thing')::int as phrase from s),
a as (select id, round((0.55 * phrase + 0.22 * hits + 0.40 + 0.15)::double, 9) as score from h where hits > 0 order by score desc, id limit 20),
v as (select 'raw:' || vec_id as id, round(list_cosine_similarity(embedding::double[], {probe}) + 0.05, 9) as score from embeddings
      where 'raw:' || vec_id in (select id from s) and list_cosine_similarity(embedding::double[], {probe}) > 0 order by score desc, id limit 20)""".replace("{probe}", SQL_PROBE)


@query(SQL_LEG + """,
r as (select id, row_number() over (order by score desc, id) as rank, 'sql' as leg from a union all select id, row_number() over (order by score desc, id), 'vector' from v)
select id, round(sum(1.0::double / (60 + rank)), 9) as score, string_agg(leg, ',' order by leg) as legs from r group by id order by sum(1.0::double / (60 + rank)) desc, id limit 10""")
def hybrid_retrieval(spark, d):
    plan = pq.plan("ns:en onthe thing", mode="hybrid", budget=10)
    return rt.retrieve(_stores(spark, d), plan, embedding=PROBE).select("id", F.round("score", 9).alias("score"), "legs")


@query(SQL_LEG.replace("order by score desc, id limit 20),\nv as", "order by score desc, id limit 50),\nv as") + """,
hub as (select source, max(doc_id) as hub from documents group by source),
e as (select 'raw:' || doc_id as src, 'raw:' || hub as dst from documents join hub using (source) where doc_id <> hub),
b as (select src as u, dst as v from e union all select dst, src from e), n as (select u, count(*) as n from b group by u),
near as (select id, 0 as hop from a union all select distinct v, 1 from b where u in (select id from a) and v not in (select id from a)),
g as (select id, round((case when hop = 0 then 0.72 else 0 end + least(0.6, coalesce(n, 0) * 0.1))::double, 9) as score from near left join n on id = u order by score desc, id limit 20),
r as (select id, row_number() over (order by score desc, id) as rank, 'sql' as leg, 1.0 as w from (select * from a order by score desc, id limit 20)
  union all select id, row_number() over (order by score desc, id), 'vector', 1.0 from v union all select id, row_number() over (order by score desc, id), 'graph', 0.5 from g)
select id, round(sum(w::double / (60 + rank)), 9) as score, string_agg(leg, ',' order by leg) as legs from r group by id order by sum(w::double / (60 + rank)) desc, id limit 10""")
def mixed_retrieval(spark, d):
    """All legs: the text, the vectors, and the graph around the text's best hits."""
    plan = pq.plan("ns:en onthe thing", mode="mix", budget=10)
    return rt.retrieve(_stores(spark, d), plan, embedding=PROBE, weights={"sql": 1.0, "vector": 1.0, "graph": 0.5}).select("id", F.round("score", 9).alias("score"), "legs")


@query("""
with p as (select 'evt:' || event_id as id, round(exp(-abs(epoch_us(ts) - epoch_us(timestamp '2024-01-20 12:00:00')) / 8.64e10 / 30), 9) as near, event_type || ' ' || props as content
  from events where event_type <> 'error'),
a as (select id, 0.55 + 0.22 + 0.8 + 0.1 + 0.15 as score from p where contains(lower(content), 'purchase') order by id limit 20),
r as (select id, row_number() over (order by score desc, id) as rank, 'sql' as leg from a
  union all select id, row_number() over (order by near desc, id), 'temporal' from (select * from p order by near desc, id limit 20))
select id, round(sum(1.0::double / (60 + rank)), 9) as score, string_agg(leg, ',' order by leg) as legs from r group by id order by sum(1.0::double / (60 + rank)) desc, id limit 10""")
def temporal_retrieval(spark, d):
    """Events near a moment."""
    e = tables.event_records(spark, d).withColumn("content", F.concat_ws(" ", "action", "props"))
    plan = pq.plan("kind:EVT purchase", mode="hybrid", budget=10, temporal=True)
    plan = pq.Plan(**{**plan.__dict__, "legs": ("sql", "temporal"), "limits": {"sql": 20, "temporal": 20}})
    return rt.retrieve(rt.Stores(e), plan, reference=datetime(2024, 1, 20, 12)).withColumn("score", F.round("score", 9))


@query(SQL_LEG + """,
r as (select id, row_number() over (order by score desc, id) as rank from a union all select id, row_number() over (order by score desc, id) from v),
f as (select id, sum(1.0::double / (60 + rank)) as score from r group by id order by score desc, id limit 10)
select id, md5(text) as text_md5, ceil(octet_length(encode(text)) / 4.0)::bigint as cost from f join documents on id = 'raw:' || doc_id where ceil(octet_length(encode(text)) / 4.0) <= 1000000""")
def recall_context(spark, d):
    """The texts of what is found, under a budget that they fit."""
    stores = _stores(spark, d)
    plan = pq.plan("ns:en onthe thing", mode="hybrid", budget=10)
    found = rt.recall(stores, plan, stores.records.select("id", "content"), 10_000_000, embedding=PROBE)
    return found.where("included").select("id", F.md5("content").alias("text_md5"), "cost")


@query("""
with d as (select substr(sha256(lang || chr(10) || 'project' || chr(10) || source || chr(10) || sha256(text)), 1, 16) as document, text from documents)
select document, count(*) as copies, md5(min(text)) as text_md5 from d group by document""")
def stable_document_ids(spark, d):
    r = tables.raw_records(spark, d)
    keyed = r.select(free_text.document_id(F.col("ns"), F.col("scope"), F.col("source_ref"), F.col("content")).alias("document"), "content")
    return keyed.groupBy("document").agg(F.count(F.lit(1)).alias("copies"), F.md5(F.min("content")).alias("text_md5"))


PROPOSITIONS = r"""
with s as (select doc_id, md5(concat_ws(chr(10), lang, source, text)) as document, coalesce(text, '') as text, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?]+)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1))) as p from documents),
p as (select doc_id, document, text, trim(p, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) as p from s where regexp_matches(p, '[\p{L}\p{N}_]')),
w as (select doc_id, document, text, p, regexp_extract_all(p, '[A-Za-z0-9][A-Za-z0-9''-]*') as ws from p),
i as (select *, case when lower(ws[1]) in ('the', 'a', 'an', 'my', 'our', 'your', 'his', 'her', 'its', 'their', 'this', 'that', 'these', 'those') and len(ws) > 1 then 2 else 1 end as i from w where len(ws) > 0),
q as (select doc_id, document, p, coalesce(nullif(regexp_extract(text, '^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*:', 1), ''),
        list_aggregate(ws[i:i + coalesce(nullif(list_position([regexp_matches(x, '^[A-Z]') for x in ws[i + 1:]], false), 0), len(ws) - i + 1) - 1], 'string_agg', ' ')) as subject,
        regexp_extract_all(p, '[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*') as runs from i)"""


@query(PROPOSITIONS + f""",
n as (select doc_id, list_aggregate([x for x in regexp_split_to_array(run, '\\s+') if x not in ({", ".join(f"'{w}'" for w in NO_NAMES)})], 'string_agg', ' ') as name from (select doc_id, unnest(runs) as run from q)),
e as (select distinct doc_id, lower(name) as name from n where name <> '' union select doc_id, lower(subject) from q)
select 'RAW' as kind, count(*) as n, null::bigint as covered, 0::bigint as subjects from documents union all select 'PROV', count(*), null, 0 from documents
union all select 'SPAN', count(*), sum(length(p))::bigint, 0 from q union all select 'CLM', count(*), sum(length(p))::bigint, count(distinct (document, lower(subject))) from q
union all select 'ENT', count(*), null, 0 from e""")
def compile_free_text(spark, d):
    """Records that the documents compile to, by kind, with the length of the text that they cover."""
    made = free_text.compiled(tables.raw_records(spark, d))
    return made.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.countDistinct("subject").alias("subjects"))


@query(PROPOSITIONS + r""",
t as (select doc_id, p, regexp_extract_all(p, '[^\s]+') as t from q),
c as (select doc_id, p, t[1] as a, t[2] as b, t[3] as c from t where len(t) >= 3),
j as (select *, not contains(p, '?') and not regexp_matches(lower(a), '^(hypothetical(ly)?|rumou?r|allegedly|reportedly|supposedly|perhaps|maybe)($|[^\p{L}\p{N}_])') and list_bool_and([
        not regexp_matches(x, '[\]:,.!?;]|[“”‘«»‹›「」『』"`]|^[''’]|[''’]$|[^\p{L}\p{N}][''’]|[''’][^\p{L}\p{N}]')
        and not regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])(and|but|or|yet|so|while|whereas|because|although|though|if|unless|when|whenever|after|before|since|once|until|where|wherever|who|whom|whose|which|that)($|[^\p{L}\p{N}_])')
        for x in [a, b, c]]) and not regexp_matches(p, '^\S+\s*[\r\n]') and not regexp_matches(p, '^\S+\s+\S+\s*[\r\n]') as ok from c)
select doc_id, count(*) as n, count_if(ok) as grounded, count_if(ok and lower(a) = lower(b)) as turned from j group by doc_id""")
def grounded_claims(spark, d):
    """The first three words of each proposition, taken for a claim, and the first two turned round, which it does not say."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.explode(free_text.propositions(F.col("text"))).alias("p"))
    words = F.filter(F.split("p", r"\s+"), lambda w: w != "")
    rows = docs.withColumn("w", words).where(F.size("w") >= 3).select("doc_id", "p", *[F.col("w")[i].alias(n) for i, n in enumerate("abc")])
    there, turned = lg.grounded_claim(F.col("a"), F.col("b"), F.col("c"), F.col("p")), lg.grounded_claim(F.col("b"), F.col("a"), F.col("c"), F.col("p"))
    sliced = F.col("f.object.text") == F.substring("p", F.col("f.object.start") + 1, F.col("f.object.end") - F.col("f.object.start"))
    rows = rows.select("doc_id", "p", there.alias("f"), turned.alias("t"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(sliced).alias("grounded"), F.count_if(F.col("t.object").isNotNull()).alias("turned"))


@query("""
select 'clm:' || o_orderkey as id, 'CLM' as kind, o_totalprice > 200000 as sure, o_orderstatus as object from orders""")
def record_line_round_trip(spark, d):
    """Claims written as text lines and read back."""
    c = tables.claim_records(spark, d)
    attrs = F.to_json(F.struct("subject", "predicate", "object"))
    price = tables.table(spark, d, "orders").select(tables.tagged("clm", "o_orderkey").alias("id"), (F.col("o_totalprice") > 200000).alias("sure"))
    marked = c.join(price, "id").select("id", "kind", "ns", "scope", "status", F.when(F.col("sure"), 1.0).otherwise(0.5).alias("conf"), attrs.alias("attrs"))
    back = rs.from_lines(rs.to_lines(marked))
    return back.select("id", "kind", (F.col("conf") == 1.0).alias("sure"), F.get_json_object("attrs", "$.object").alias("object"))


@query("""
select user_id as run, arg_max(case event_type when 'purchase' then 'completed' when 'error' then 'failed' end, event_id) filter (event_type in ('purchase', 'error')) as status,
       max(event_id) as last_event, count(*) as events from events group by user_id""")
def streamed_run_status(spark, d):
    """The status fold over the log as a stream, drained to the end; the last state of each run is read back."""
    name = scratch.folder(spark, "status")
    log = tables.table(spark, d, "events")
    # The table is one file of the folder, or a folder of its own.
    alone = log.inputFiles()[0].endswith("/events.parquet")
    stream = st.read_log(spark, d if alone else f"{d}/events.parquet", "events.parquet" if alone else "*.parquet", log.schema)
    folded = st.run_status(stream.select(F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("kind")), ("purchase",), ("error",))
    st.drain(folded, st.upserting(f"{name}/state", "run"), f"{name}/checkpoint-{uuid.uuid4().hex}", mode="update")
    return st.latest(spark, f"{name}/state", "run")
