"""Decay, windows, relative references, current state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memspark.functions import temporal as tm
from memspark.operators import lexical
from memspark.plans import query as pq
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

ANCHOR = datetime(2024, 1, 20, 12)


@query("""
select 'evt:' || event_id as id, round(exp(-abs(epoch_us(ts) - epoch_us(timestamp '2024-01-20 12:00:00')) / 8.64e10 / 30), 9) as score
from events order by score desc, id limit 20""")
def temporal_decay_topk(spark, d):
    return lexical.top(tables.event_records(spark, d).withColumn("score", tm.decay(F.col("t0"), F.lit(ANCHOR))), 20).select("id", "score")


@query("""
select event_type as action, count(*) as n, sum(case when ts between timestamp '2024-01-10' and timestamp '2024-01-20' then 1.0 else 0.0 end)::double as inside
from events group by event_type""")
def temporal_window(spark, d):
    rows = tables.event_records(spark, d).withColumn("w", tm.within(F.col("t0"), F.lit(datetime(2024, 1, 10)), F.lit(datetime(2024, 1, 20))))
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("inside"))


@query("""
select kind, count(*) as n, round(sum(p), 6)::double as presence from (
  select 'EVT' as kind, 1.0::double as p from events union all select 'RAW', 0.2::double from documents) group by kind""")
def temporal_presence(spark, d):
    rows = tables.event_records(spark, d).select("kind", "t0").unionByName(tables.raw_records(spark, d).select("kind", F.lit(None).cast("timestamp").alias("t0")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(tm.presence(F.col("t0"))), 6).alias("presence"))


#: Questions, and how far from the anchor what they speak of is.
QUESTIONS = {
    "what happened 2 weeks ago": -14, "two weeks ago?": -14, "Last month, who called": -30, "yesterday": -1, "what comes tomorrow": 1,
    "the sale 3 days before": -3, "and TEN days after": 10, "one year later": 365, "this week": 0, "eleven  months ago": -330,
    "today or 5 days ago": 0, "in 3 days": None, "fortnight ago": None, "13 days": None, "seen on 2024-01-03, a week ago": -17,
}


@query("""
select question, cast(days as double) as days, (select count(*) from events
    where ts between least(there, anchor) and greatest(there, anchor)) as n
from (select question, days, anchor, anchor + to_hours(cast(24 * days as integer)) as there from (
  select question, days, timestamp '2024-01-20 12:00:00' as anchor from (values
  ('what happened 2 weeks ago', -14.0), ('two weeks ago?', -14.0), ('Last month, who called', -30.0), ('yesterday', -1.0), ('what comes tomorrow', 1.0),
  ('the sale 3 days before', -3.0), ('and TEN days after', 10.0), ('one year later', 365.0), ('this week', 0.0), ('eleven  months ago', -330.0),
  ('today or 5 days ago', 0.0), ('seen on 2024-01-03, a week ago', -17.5)) q(question, days)))""")
def relative_offset_days(spark, d):
    """Events between the anchor and what a question speaks of; months have 30 days. One pass over the events."""
    events = tables.event_records(spark, d).select("t0")
    anchor = F.lit(ANCHOR)
    there = [tm.reference_instant(F.lit(q), anchor) for q in QUESTIONS]
    counts = [F.count_if(F.col("t0").between(F.least(t, anchor), F.greatest(t, anchor))) for t in there]
    days = [(F.unix_micros(t) - F.unix_micros(anchor)) / F.lit(tm.DAY_MICROS) for t in there]
    one = events.agg(F.array(*[F.struct(F.lit(q).alias("question"), x.alias("days"), c.alias("n")) for q, x, c in zip(QUESTIONS, days, counts, strict=True)]).alias("rows"))
    return one.select(F.inline("rows")).where("days is not null")


@query("""
select event_id, array_to_string(regexp_extract_all(text, '(?:\\d{4}-\\d{2}-\\d{2}|next week|\\d+ days ago|May 2023)'), '|') as tokens,
       case when ts < timestamp '2024-01-20 12:00:00' then -1 when ts > timestamp '2024-01-20 12:00:00' then 1 else 0 end as side
from (select event_id, ts, event_type || ' on ' || strftime(ts, '%Y-%m-%d') || case event_id % 3 when 0 then ', due next week' when 1 then ', said ' || (event_id % 17) || ' days ago, not two days ago' else ' since May 2023' end as text from events)""")
def temporal_tokens(spark, d):
    """The dates and phrases in a text about each event, and the side of the anchor that the event is on."""
    events = tables.table(spark, d, "events")
    tail = F.when(F.col("event_id") % 3 == 0, ", due next week").when(F.col("event_id") % 3 == 1, F.concat(F.lit(", said "), (F.col("event_id") % 17).cast("string"), F.lit(" days ago, not two days ago")))
    text = F.concat("event_type", F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"), F.coalesce(tail, F.lit(" since May 2023")))
    return events.select("event_id", F.array_join(tm.tokens(text), "|").alias("tokens"), tm.compare(F.col("ts"), F.lit(ANCHOR)).alias("side"))


@query("""
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0') || 'Z' as key from events""")
def timestamp_key(spark, d):
    return tables.event_records(spark, d).select("event_id", tm.key(F.col("t0")).alias("key"))


@query("""
select 'user:' || user_id as actor, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last from events group by user_id""")
def extreme_instants(spark, d):
    rows = tables.event_records(spark, d).groupBy("actor").agg(F.min("t0").alias("a"), F.max("t0").alias("b"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("actor", shown("a").alias("first"), shown("b").alias("last"))


@query("""
select status, count(*) as n from (
  select case when o_orderstatus = 'F' then 'asserted' when o_orderstatus = 'O' then 'observed' else 'superseded' end as status from orders
  union all select case when event_type = 'error' then 'contradicted' else 'observed' end from events)
where status not in ('contradicted', 'superseded', 'deprecated', 'deleted_soft') group by status""")
def current_state_filter(spark, d):
    rows = tables.claim_records(spark, d).select("status").unionByName(tables.event_records(spark, d).select("status"))
    return rows.where(pq.current(F.col("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select conv_id, turn, role, text, cast(timestamp '2024-01-01' + to_days(cast(turn as integer)) as date) as day from conversations)
select cast(day as varchar) as day, count(*) as turns, count(distinct conv_id) as runs from t group by day""")
def date_index(spark, d):
    """Turns grouped by the day that their place in the run stands for."""
    t = tables.turns(spark, d).withColumn("day", F.date_format(F.date_add(F.lit(datetime(2024, 1, 1)).cast("date"), F.col("seq").cast("int")), "yyyy-MM-dd"))
    return t.groupBy("day").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("run").alias("runs"))
