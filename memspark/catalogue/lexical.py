"""Lexical scoring and rank fusion."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memspark.functions import temporal as tm
from memspark.functions import text as tx
from memspark.functions import vectors as vx
from memspark.operators import fusion, grounding, lexical
from memspark.plans import query as pq
from memspark.sources import tables

from .registry import Registry
from .vectors import COSINE, PROBE

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

PHRASE = "the ha of onthe thing"
REPEATED = "the the ha of onthe"
WANTED = "('the'),('ha'),('of'),('onthe'),('thing')"
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_:-]+')"


@query(f"""
with w(t) as (values {WANTED}), d as (select doc_id, list_distinct({TOKENS}) as ts from documents),
s as (select doc_id, count(*) / 5.0::double as score from d, w where list_contains(ts, t) group by doc_id)
select 'raw:' || doc_id as id, round(score, 9) as score from s order by score desc, id limit 10""")
def lexical_overlap_topk(spark, d):
    return lexical.top(lexical.overlap(tables.raw_records(spark, d), PHRASE, F.col("content")), 10).select("id", "score")


@query(f"""
with w(t) as (values {WANTED}), d as (select doc_id, list_distinct({TOKENS}) as ts from documents)
select 'raw:' || doc_id as id, cast(count(*) as integer) as score from d, w where list_contains(ts, t)
group by doc_id order by score desc, id limit 20""")
def raw_overlap_search(spark, d):
    return lexical.top(lexical.shared_tokens(tables.raw_records(spark, d), PHRASE, F.col("content")), 20, digits=None).select("id", "score")


def _bm25(words: str) -> str:
    return f"""
with d as (select doc_id, {TOKENS} as ts from documents), n as (select *, len(ts) as n from d where len(ts) > 0),
q as (select t, count(*) as times from (values {words}) v(t) group by t),
s as (select count(*) as docs, avg(n) as mean from n),
f as (select doc_id, n, q.t, times, len(list_filter(ts, lambda x: x = q.t)) as tf from n, q),
g as (select t, count(*) as df from f where tf > 0 group by t),
r as (select doc_id, sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) as score
      from f join g using (t), s where tf > 0 group by doc_id)
select 'raw:' || doc_id as id, round(score, 6) as score from r order by score desc, id limit 10"""


@query(_bm25(WANTED))
def bm25_topk(spark, d):
    return lexical.top(lexical.bm25(tables.raw_records(spark, d), PHRASE, F.col("content")), 10, digits=6).select("id", "score")


@query(_bm25("('the'),('the'),('ha'),('of'),('onthe')"))
def bm25_repeated_terms(spark, d):
    return lexical.top(lexical.bm25(tables.raw_records(spark, d), REPEATED, F.col("content")), 10, digits=6).select("id", "score")


@query(_bm25(WANTED).replace("from r order", "from r join documents using (doc_id) where lang = 'en' order"))
def bm25_filtered_candidates(spark, d):
    """Statistics of all documents, candidates of one namespace."""
    rows = lexical.bm25(tables.raw_records(spark, d), PHRASE, F.col("content"), candidates=F.col("ns") == "en")
    return lexical.top(rows, 10, digits=6).select("id", "score")


@query(f"""
with d as (select doc_id, {TOKENS} as ts from documents), e as (select doc_id, unnest(ts) as t from d),
c as (select doc_id, t, count(*) as tf from e group by doc_id, t), z as (select doc_id, sqrt(sum(tf * tf)) as norm from c group by doc_id),
w(t) as (values {WANTED}), p as (select doc_id, sum(tf) as dot from c join w using (t) group by doc_id)
select 'raw:' || doc_id as id, round(dot / (norm * sqrt(5.0)), 9) as score from p join z using (doc_id) order by score desc, id limit 10""")
def bag_cosine_topk(spark, d):
    return lexical.top(lexical.bag_cosine(tables.raw_records(spark, d), PHRASE, F.col("content")), 10).select("id", "score")


LEG_QUERY = "onthe ha art"
LEG_SQL = """
with d as (select doc_id, lang, lower(text) as t from documents),
h as (select doc_id, lang, (contains(t, 'onthe')::int + contains(t, 'ha')::int + contains(t, 'art')::int) as hits,
             contains(t, 'onthe ha art')::int * 0.55 as phrase from d)"""


@query(LEG_SQL + """
select 'raw:' || doc_id as id, hits, round((phrase + hits * 0.22)::double, 9) as score from h where hits > 0 order by score desc, id limit 25""")
def substring_sql_leg(spark, d):
    rows = lexical.substring_leg(tables.raw_records(spark, d), LEG_QUERY, F.col("content")).where("hits > 0")
    return lexical.top(rows, 25).select("id", "hits", "score")


@query("""
with c as (select 'clm:' || o_orderkey as id, o_orderstatus as s, o_totalprice as p, lower(o_orderpriority) as pr from orders),
g as (select id, case when s = 'F' then 'asserted' when s = 'O' then 'observed' else 'superseded' end as status,
             case when pr = '1-urgent' then 0.75 else 0 end + case when contains(lower(s), 'o') then 0.65 else 0 end + 0.80 + 0.40 + 0.40 as wanted,
             round(least(1.0, p / 500000), 6) as conf from c)
select id, round(wanted + 0.10 + least(conf, 1.0) * 0.15, 9)::double as score from g
where status not in ('contradicted', 'superseded', 'deprecated', 'deleted_soft') and wanted >= 1.0
order by score desc, id limit 20""")
def sql_leg_gate(spark, d):
    """The structured leg, statuses excluded, through its gate."""
    plan = pq.plan("kind:CLM ns:local.default scope:project predicate:1-urgent object:O late", budget=20)
    claims = tables.claim_records(spark, d).where(pq.current(F.col("status")))
    wanted = {"kind": ["CLM"], "ns": "local.default", "scope": "project", "predicate": "1-urgent", "object": "O"}
    base = lexical.structured_score(wanted, F.lit(False), F.lit(0.0))
    rows = claims.withColumn("structured", base).withColumn("score", lexical.structured_score(wanted, F.col("t0").isNotNull(), F.col("conf")))
    rows = rows.where(lexical.gate(F.col("structured"), F.lit(0.8), F.lit(0), bool(plan.residual), plan.explicit_boundary))
    return lexical.top(rows, 20).select("id", "score")


@query("""
select 'clm:' || o_orderkey as id, 'cust:' || o_custkey as subject, lower(o_orderpriority) as predicate, o_orderstatus as object
from orders where o_custkey = 7 and lower(o_orderpriority) = '2-high'""")
def filter_dsl_scan(spark, d):
    plan = pq.plan("kind:clm subject:CUST:7 predicate:2-HIGH anything")
    return pq.apply_filters(tables.claim_records(spark, d), plan.filters).select("id", "subject", "predicate", "object")


CHANNEL_SQL = f"""
with w(t) as (values {WANTED}), d as (select doc_id, list_distinct({TOKENS}) as ts, {TOKENS} as all_ts, source from documents),
l as (select doc_id, count(*) / 5.0::double as s from d, w where list_contains(ts, t) group by doc_id),
ch as (select d.doc_id, coalesce(s, 0.0) as lexical, least(1.0, len(all_ts) / 1000.0::double) as semantic,
              case when source = 'src1' then 1.0 else 0.0 end as graph from d left join l using (doc_id))"""


def _channels(spark, d):
    return tables.raw_records(spark, d).select(
        "id",
        tx.overlap(PHRASE, F.col("content")).alias("lexical"),
        F.least(F.lit(1.0), F.size(tx.tokens(F.col("content"))) / 1000).alias("semantic"),
        F.when(F.col("source_ref") == "src1", 1.0).otherwise(0.0).alias("graph"),
        F.lit(0.0).alias("temporal"),
    )


@query(CHANNEL_SQL + """
select 'raw:' || doc_id as id, round(0.40 * lexical + 0.35 * semantic + 0.15 * graph, 9)::double as score from ch order by score desc, id limit 20""")
def weighted_fusion(spark, d):
    return lexical.top(fusion.weighted(_channels(spark, d)), 20).select("id", "score")


LEGS_SQL = CHANNEL_SQL + """,
a as (select 'lexical' as leg, 'raw:' || doc_id as id, round(lexical, 9) as score from ch where lexical > 0 order by score desc, id limit 50),
b as (select 'semantic' as leg, 'raw:' || doc_id as id, round(semantic, 9) as score from ch where semantic > 0 order by score desc, id limit 50),
c as (select 'graph' as leg, 'raw:' || doc_id as id, round(graph, 9) as score from ch where graph > 0 order by score desc, id limit 50),
h as (select * from a union all select * from b union all select * from c union all select leg, id, score / 2 from a),
e as (select leg, id, max(score) as score from h group by leg, id),
r as (select *, row_number() over (partition by leg order by score desc, id) as rank from e)"""


def _hits(spark, d):
    channels = _channels(spark, d)
    out = None
    for leg in ("lexical", "semantic", "graph"):
        one = channels.select(F.lit(leg).alias("leg"), "id", F.col(leg).alias("score")).where("score > 0")
        one = lexical.top(one, 50)
        out = one if out is None else out.unionByName(one)
        if leg == "lexical":
            out = out.unionByName(one.withColumn("score", F.col("score") / 2))
    return out


@query(LEGS_SQL + """
select id, round(sum(1.0::double / (60 + rank)), 9) as score, string_agg(leg, ',' order by leg) as legs from r group by id""")
def leg_rrf(spark, d):
    return fusion.reciprocal(_hits(spark, d)).select("id", F.round("score", 9).alias("score"), "legs")


@query(LEGS_SQL + """
select id, round(sum(case leg when 'graph' then 0.0 when 'lexical' then 1.0 else 0.5 end::double / (60 + rank)), 9) as score,
       string_agg(leg, ',' order by leg) as legs from r group by id""")
def weighted_leg_rrf(spark, d):
    """The weights come from a spec; a weight of 0 keeps the leg's records."""
    rows = fusion.reciprocal(_hits(spark, d), pq.leg_weights("graph=0,lexical=1,semantic=0.5"))
    return rows.select("id", F.round("score", 9).alias("score"), "legs")


@query(LEGS_SQL + " select leg, id, score, rank from r")
def leg_dedupe_best(spark, d):
    return fusion.ranked(fusion.deduplicated(_hits(spark, d))).withColumn("rank", F.col("rank").cast("long"))


@query(CHANNEL_SQL + """,
u as (select 'lexical' as leg, 'raw:' || doc_id as id, lexical as score from ch where lexical > 0
      union all select 'semantic', 'raw:' || doc_id, semantic from ch where semantic > 0
      union all select 'graph', 'raw:' || doc_id, graph from ch where graph > 0),
r as (select *, row_number() over (partition by leg order by round(score, 9) desc, id) as rank from u)
select id, round(sum(1.0::double / (60 + rank)), 9) as score from r group by id order by score desc, id limit 30""")
def channel_rrf(spark, d):
    channels = _channels(spark, d)
    rows = channels.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("leg"), F.round(c, 9).alias("score")) for c in ("lexical", "semantic", "graph", "temporal")])))
    return lexical.top(fusion.reciprocal(rows, positive=True, whole=True), 30).select("id", "score")


@query(LEGS_SQL.replace("union all select leg, id, score / 2 from a", "") + """,
p as (select id, score, row_number() over (order by score desc, id) as rn from a qualify rn <= 20),
n as (select id, row_number() over (order by score desc, id) as i from b where id not in (select id from p where rn <= 15) qualify i <= 5),
k as (select p.* from p where rn <= 20 - (select count(*) from n))
select id, score, 'primary' as origin from k where id not in (select id from n)
union all select id, round((select min(score) from k) - i * 1e-4, 9), 'secondary' from n""")
def second_hop_splice(spark, d):
    hits = fusion.deduplicated(_hits(spark, d))
    legs = [hits.where(F.col("leg") == leg).select("id", "score") for leg in ("lexical", "semantic")]
    return fusion.splice(*legs, limit=20, reserve=5).withColumn("score", F.round("score", 9))


@query("""
with e as (select 'evt:' || event_id as id, cast(cast(ts as date) as varchar) as day, value,
                  row_number() over (order by value desc, event_id) as rank from events),
n as (select *, row_number() over (partition by day order by rank) as nth from e)
select id, day, rank from n order by (nth > 1), rank limit 40""")
def date_diverse(spark, d):
    events = tables.event_records(spark, d).select("id", "event_id", F.date_format("t0", "yyyy-MM-dd").alias("day"), "value")
    rows = fusion.placed(events, F.desc("value"), "event_id")
    return fusion.date_diverse(rows, 40).select("id", "day", "rank")


@query(CHANNEL_SQL + """,
t as (select 'raw:' || doc_id as id, round(0.40 * lexical + 0.35 * semantic + 0.15 * graph, 9)::double as score from ch),
r as (select id, score, row_number() over (order by score desc, id) as rank from t)
select id, score, cast(rank as integer) as rank, case when rank <= 10 then 'selected' else 'rejected' end as decision from r where rank <= 40""")
def candidate_split(spark, d):
    scored = fusion.weighted(_channels(spark, d)).withColumn("score", F.round("score", 9))
    return fusion.split(scored.select("id", "score"), budget=10, trace_limit=40)


@query(_bm25(WANTED).split("\nselect 'raw:'")[0] + """,
x as (select max(score) as most from r),
o as (select doc_id, list_distinct(ts) as us from d),
c as (select o.doc_id, greatest((list_contains(us, 'the')::int + list_contains(us, 'ha')::int + list_contains(us, 'of')::int + list_contains(us, 'onthe')::int + list_contains(us, 'thing')::int) / 5.0::double,
             coalesce(score, 0) / greatest(most, 1)) as lexical, case when source = 'src1' then 0.5 else 0.0 end as graph,
             exp(-abs(doc_id % 60 - 29) / 30.0::double) as temporal, """ + COSINE + """ as semantic
      from o left join r using (doc_id) join documents using (doc_id) left join embeddings on vec_id = doc_id, x)
select 'raw:' || doc_id as id, round(0.40 * lexical + 0.35 * coalesce(semantic, 0) + 0.15 * graph + 0.10 * temporal, 6)::double as score from c order by score desc, id limit 20""")
def channel_scores(spark, d):
    """The four-channel score: the lexical channel is the better of overlap and BM25 over the largest BM25 (1 at least)."""
    records = tables.raw_records(spark, d)
    scored = lexical.bm25(records, PHRASE, F.col("content")).select("id", F.col("score").alias("bm25"))
    most = scored.agg(F.greatest(F.max("bm25"), F.lit(1.0)).alias("most"))
    rows = records.join(scored, "id", "left").join(F.broadcast(most))  # one row
    lex = F.greatest(tx.overlap(PHRASE, F.col("content")), F.coalesce("bm25", F.lit(0.0)) / F.col("most"))
    vector = tables.table(spark, d, "embeddings").select(tables.tagged("raw", "vec_id").alias("id"), vx.cosine(F.col("embedding"), vx.literal(PROBE)).alias("semantic"))
    said = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") % 60 * tm.DAY_MICROS)
    near = records.select(F.col("id").alias("src"), F.explode(F.array("source_ref", F.concat(F.lit("lang:"), "ns"))).alias("dst"))
    graph = grounding.neighbour_name_score(near, ["src1"], exact=True).withColumnRenamed("score", "graph")
    joined = rows.join(vector, "id", "left").join(graph, "id", "left")
    channels = joined.select("id", lex.alias("lexical"), "semantic", "graph", tm.decay(said, F.lit(datetime(2024, 1, 30))).alias("temporal"))
    return lexical.top(fusion.weighted(channels), 20, digits=6).select("id", "score")
