"""Metrics, packs, gates and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import evaluation as ev
from memspark.operators import graph
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

RANKED = """
with r as (select source as case_id, doc_id as id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents),
t as (select * from r where rank <= 20), g as (select d.source as case_id, doc_id as id from labels join documents d using (doc_id) where quality = 1),
m as (select t.case_id, count(*) as shown, count(g.id) as found, min(case when g.id is not null then rank end) as first_rank,
             sum(case when g.id is not null then 1 / log2(rank + 1) else 0 end) as dcg from t left join g on t.case_id = g.case_id and t.id = g.id group by t.case_id),
z as (select case_id, count(*) as gold from g group by case_id),
x as (select z.case_id, found > 0 as hit, first_rank, coalesce(1.0::double / first_rank, 0) as rr, found::double / gold as recall,
             dcg / list_sum(list_transform(range(1, least(gold, shown) + 1), lambda i: 1 / log2(i + 1))) as ndcg from z join m using (case_id))"""


def _first(docs, order, n):
    """The first n of each source with their rank: cut in many tasks before a source's rows meet."""
    best = graph.best_of_each(docs, "source", order, n)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("rank") <= n)


def _tracked(spark, d):
    """Cases are sources: their documents by length are the ranked list, the good ones of the labelled are gold."""
    docs, labels = tables.table(spark, d, "documents"), tables.table(spark, d, "labels")
    ranked = _first(docs.select("source", "n_chars", "doc_id"), [F.desc("n_chars"), F.asc("doc_id")], 20).select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"), "rank")
    gold = labels.where("quality = 1").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"))
    return ev.track(ranked, gold, 20)


@query(RANKED + " select case_id, hit, cast(first_rank as integer) as first_rank, round(rr, 6) as rr, round(recall, 6) as recall, round(ndcg, 6) as ndcg from x")
def recall_mrr_ndcg(spark, d):
    t = _tracked(spark, d)
    return t.select("case_id", "hit", "first_rank", *[F.round(c, 6).alias(c) for c in ("rr", "recall", "ndcg")])


@query(RANKED + """
select length(case_id) as category, count(*) as cases, round(avg(hit::int), 6) as hit_rate, round(avg(rr), 6) as mrr, round(avg(recall), 6) as recall, round(avg(ndcg), 6) as ndcg
from x group by 1""")
def hit_rate_by_category(spark, d):
    tracked = _tracked(spark, d).withColumn("category", F.length("case_id").cast("long"))
    return ev.summary(tracked, "category")


@query("""
with v as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, value from v where i = round_even((n - 1) * 0.95, 0)::int""")
def nearest_rank_percentile(spark, d):
    return ev.percentile_of(tables.table(spark, d, "events").select("event_type", "value"), "value", 0.95, "event_type")


@query("""
with a as (select user_id as case_id, max(event_type) as status, round(sum(value), 2) as metric from events where ts < timestamp '2024-01-16' group by user_id),
b as (select user_id as case_id, max(event_type) as status, round(sum(value), 2) as metric from events where ts >= timestamp '2024-01-16' and event_type <> 'view' group by user_id)
select coalesce(a.case_id, b.case_id) as case_id, case when a.case_id is null then 'added' when b.case_id is null then 'removed' when a.status <> b.status then 'changed' else 'same' end as change,
       round(b.metric - a.metric, 2) as delta from a full join b on a.case_id = b.case_id""")
def run_diff(spark, d):
    e = tables.table(spark, d, "events")
    run = lambda rows: rows.groupBy(F.col("user_id").alias("case_id")).agg(F.max("event_type").alias("status"), F.round(F.sum("value"), 2).alias("metric"))
    found = ev.run_diff(run(e.where("ts < timestamp_ntz '2024-01-16'")), run(e.where("ts >= timestamp_ntz '2024-01-16' and event_type != 'view'")))
    return found.withColumn("delta", F.round("delta", 2))


@query("""
with m as (select event_type as metric, round(avg(value), 6) as value from events group by event_type),
r(metric, rule, bound) as (values ('click', 'minimum', 10.0), ('error', 'maximum', 5.0), ('view', 'equals', 0.0), ('absent', 'minimum', 0.0))
select metric, rule, bound::double as bound, value as actual,
       coalesce(case rule when 'equals' then value = bound when 'minimum' then value >= bound else value <= bound end, false) as passed from r left join m using (metric)""")
def gate_rules(spark, d):
    e = tables.table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return ev.gate(e, [("click", "minimum", 10.0), ("error", "maximum", 5.0), ("view", "equals", 0.0), ("absent", "minimum", 0.0)])


COSTS = "ceil(octet_length(encode(text)) / 4.0)::bigint"


def _items(spark, d):
    t = tables.turns(spark, d)
    return t.select(F.col("run").alias("pack"), F.col("seq").alias("pos"), F.concat_ws(":", F.lit("turn"), "run", "seq").alias("id"), tx.token_estimate(F.col("text")).alias("cost"), "text")


@query(f"""
with recursive t as (select conv_id as pack, turn as pos, {COSTS} as cost, row_number() over (partition by conv_id order by turn) as n from conversations),
w(pack, n, used, included, pos) as (select pack, n, case when cost <= 200 then cost else 0 end, cost <= 200, pos from t where n = 1
  union all select t.pack, t.n, used + case when used + cost <= 200 then cost else 0 end, used + cost <= 200, t.pos from w join t on t.pack = w.pack and t.n = w.n + 1)
select pack, pos, included from w""")
def context_pack_greedy(spark, d):
    """Turns of each run under a budget of 200 tokens: one that doesn't fit is skipped, later ones may fit."""
    return ev.context_pack(_items(spark, d).drop("text"), 200).select("pack", "pos", "included")


@query("""
with l as (select conv_id as pack, turn as pos, '- ' || text as line from conversations),
b as (select *, coalesce(sum(length(line) + 1) over (partition by pack order by pos rows between unbounded preceding and 1 preceding), 0) as used from l)
select pack, pos, md5(substr(line, 1, (300 - used)::int)) as line_md5 from b where used < 300""")
def character_context(spark, d):
    return ev.character_context(_items(spark, d), 300).select("pack", "pos", F.md5("line").alias("line_md5"))


@query(f"""
with t as (select conv_id as pack, count(*) as records, least(count(*), 2) as included, sum({COSTS}) as source_cost, sum(case when turn < 2 then {COSTS} else 0 end) as cost from conversations group by conv_id),
c as (select pack, included::double / records as coverage, case when cost <= 120 then 1.0 else 120.0 / greatest(cost, 1) end::double as fit,
             least(1.0, case when source_cost > 0 then source_cost / greatest(cost, 1) else 1.0 end)::double as compression from t)
select pack, round(coverage, 6) as coverage, round(fit, 6) as fit, round(compression, 6) as compression,
       round(0.40 * coverage + 0.25 * fit + 0.20 * compression + 0.15 * coverage, 6)::double as overall from c""")
def pack_score(spark, d):
    """Packs of the first two turns of each run."""
    t = _items(spark, d).groupBy("pack").agg(
        F.count(F.lit(1)).alias("records"), F.least(F.count(F.lit(1)), F.lit(2)).alias("included"), F.sum("cost").alias("source_cost"), F.sum(F.when(F.col("pos") < 2, F.col("cost")).otherwise(0)).alias("cost")
    )
    return ev.pack_score(t.withColumn("budget", F.lit(120)))


@query("""
with c as (select doc_id, source, n_chars, (lang = 'en')::int as task, row_number() over (partition by source order by (lang = 'en')::int desc, n_chars desc, doc_id) as rank from documents)
select source, doc_id, cast(rank as integer) as rank from c where rank <= 5""")
def context_rank(spark, d):
    """The five best candidates of each source by trust, then task, then id."""
    docs = tables.table(spark, d, "documents").select("source", (F.col("lang") == "en").cast("int").alias("task"), "n_chars", "doc_id")
    return _first(docs, [F.desc("task"), F.desc("n_chars"), F.asc("doc_id")], 5).select("source", "doc_id", "rank")


@query("""
with p as (select 'p' || p_partkey as pattern_id, string_split(p_name, ' ') as terms, p_type as operation, least(1.0, p_retailprice / 2000) as trust, p_size as age, p_partkey % 7 as wins from part),
s as (select *, len(list_intersect(terms, ['blue', 'cold', 'widget'])) as i, len(list_distinct(list_concat(terms, ['blue', 'cold', 'widget']))) as u, operation = 'PROMO' as op from p)
select pattern_id, round((i / u) * 0.55 + op::int * 0.15 + trust * 0.20 + greatest(0.0, 1 - age / 40.0) * 0.05 + least(0.05, ln(1 + wins) * 0.02), 6)::double as score
from s where age <= 40 and trust >= 0.46 and (i > 0 or op) order by score desc, pattern_id limit 25""")
def pattern_search(spark, d):
    p = tables.table(spark, d, "part")
    rows = p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pattern_id"), F.split("p_name", " ").alias("terms"), F.col("p_type").alias("operation"),
        F.least(F.lit(1.0), F.col("p_retailprice") / 2000).alias("trust"), F.col("p_size").alias("age_days"), F.pmod("p_partkey", F.lit(7)).alias("successes"),
    )
    found = ev.pattern_scores(rows, ["blue", "cold", "widget"], "promo", 40, 0.46)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "pattern_id").limit(25)


@query("""
with recursive o as (select o_custkey as run, o_orderkey as payload, row_number() over (partition by o_custkey order by o_orderkey) as seq from orders),
w(run, seq, hash) as (select run, seq, sha256('|' || payload) from o where seq = 1 union all select o.run, o.seq, sha256(w.hash || '|' || o.payload) from w join o on o.run = w.run and o.seq = w.seq + 1)
select run, count(*) as events, count(*) as sound from w group by run""")
def ledger_chain(spark, d):
    """A ledger whose hashes chain each customer's orders, built in order and then verified."""
    from memspark.operators.ledger import build_chain

    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"), F.col("o_orderkey").cast("string").alias("payload"))
    checked = ev.chained(build_chain(o))
    return checked.groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("sound"))


@query("""
with r as (select source, doc_id, n_chars / 7.0::double as score, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents)
select source, sha256(string_agg(rank || chr(9) || doc_id || chr(9) || printf('%.17g', score) || chr(9) || 'graph=0.5,lexical=' || printf('%.17g', score), chr(10) order by rank)) as fingerprint from r where rank <= 20 group by source""")
def candidate_fingerprint(spark, d):
    docs = tables.table(spark, d, "documents").select("source", "n_chars", "doc_id")
    ranked = _first(docs, [F.desc("n_chars"), F.asc("doc_id")], 20)
    ranked = ranked.select("source", "rank", F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / 7).alias("score"))
    lined = ev.with_lines(ranked.withColumns({"lexical": F.col("score"), "graph": F.lit(0.5)}), ("lexical", "graph"))
    return lined.groupBy("source").agg(ev.fingerprint().alias("fingerprint"))


@query("select item_id, sha256(text) as sha256, true as intact from benchmark")
def lossless_round_trip(spark, d):
    """Texts packed by the best codec and restored, their hashes compared."""
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    back = ev.restored(ev.lossless(b))
    return back.select(F.col("id").alias("item_id"), F.sha2("content", 256).alias("sha256"), "intact")


@query("""
with c as (select user_id, event_id, sha256('{"id":' || event_id || ',"kind":"' || event_type || '"}') as h from events)
select user_id as run, count(*) as cases, sha256(string_agg(h, '' order by h)) as bundle from c group by user_id""")
def bundle_hashes(spark, d):
    """A run's bundle hash from the hashes of its cases' canonical JSON."""
    e = tables.table(spark, d, "events")
    return ev.bundles(e.select(F.col("user_id").alias("run"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("case")))
