"""Questions of how many over whole conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import counts, lexical
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

ASKED = "How many times did the user and the assistant go on, or make something of their time?"

STEMS = """case when t in ('bought', 'did', 'found', 'got', 'had', 'made', 'met', 'owned', 'saw', 'taken', 'took', 'went', 'won', 'wrote', 'written')
  then list_element(['buy', 'do', 'find', 'get', 'have', 'make', 'meet', 'own', 'see', 'take', 'take', 'go', 'win', 'write', 'write'],
    list_position(['bought', 'did', 'found', 'got', 'had', 'made', 'met', 'owned', 'saw', 'taken', 'took', 'went', 'won', 'wrote', 'written'], t))
  when length(t) > 5 and suffix(t, 'ing') then left(t, -3) when length(t) > 4 and suffix(t, 'ed') then left(t, -2) when length(t) > 4 and suffix(t, 'es') then left(t, -2)
  when length(t) > 3 and suffix(t, 's') then left(t, -1) else t end"""
STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(counts.STOP)) + "]"
NEAR = "['user', 'assistant', 'go', 'make', 'something', 'time']"

EVIDENCE = r"""
with m as (select conv_id, turn, role, conv_id % 9 as score, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as body from conversations),
parts as (select conv_id, turn, unnest(c) as clause, generate_subscripts(c, 1) as i from (
  select conv_id, turn, case when len(c) = 0 then [body] else c end as c from (
    select conv_id, turn, body, list_filter([trim(x) for x in string_split(regexp_replace(regexp_replace(body, '([.!?;])\s+', '\1' || chr(1), 'g'), '(?i)\s+(although|but|however|while)\s+', chr(1), 'g'), chr(1))], lambda x: x <> '') as c from m))),
tok as (select conv_id, turn, i, unnest(list_distinct(regexp_extract_all(lower(clause), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'))) as t from parts),
st as (select conv_id, turn, i, {stem} as s from tok where not list_contains({stop}, t)),
near as (select conv_id, turn, i, count(distinct s) filter (list_contains({near}, s)) + 100 * count(distinct s) filter (s in ('go', 'make')) as n from st where not list_contains({stop}, s) group by all),
cl as (select p.*, coalesce(n, 0) as n, max(coalesce(n, 0)) over (partition by p.conv_id, p.turn) as best, count(*) over (partition by p.conv_id, p.turn) as k from parts p left join near using (conv_id, turn, i)),
says as (select conv_id, turn, case
    when regexp_matches(clause, '(?i)\b(did not|didn''t|does not|doesn''t|has not|hasn''t|have not|haven''t|never|no longer|not yet|without)\b') then 'negated'
    when regexp_matches(clause, '(?i)\b(plan(s|ned|ning)?|hope(s|d)? to|want(s|ed)? to|going to|will|would like to|next (week|month|year|time|weekend)|upcoming|looking forward to|intend(s|ed)? to|might|could)\b') then 'planned'
    when regexp_matches(clause, '(?i)\b(attended|bought|completed|did|finished|found|got|had|has|have|injured|joined|made|met|moved|owned|owns|participated|received|resumed|saw|took|visited|went|won|wrote)\b') then 'observed'
    when regexp_matches(clause, '(?i)^(that|this|those|these|it|they|the same|the event|the trip|the tournament|the show|the game)\b') then 'reference-only' else 'mentioned' end as state
  from cl where k = 1 or n = best and n > 0),
state as (select conv_id, turn, case when count(distinct state) > 1 then 'mixed' else min(state) end as state from says group by all),
own as (select conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(role || ' ' || body), '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'))) as t from m),
stems as (select distinct conv_id, turn, {stem} as s from own where not list_contains({stop}, t)),
said as (select conv_id, turn, count(*) filter (list_contains({near}, s)) as overlap, string_agg(s, ' ' order by encode(s)) as all_terms from stems where not list_contains({stop}, s) group by all)
select 'turn:' || conv_id || ':' || turn as id, coalesce(state, 'mentioned') as state, role as speaker, '2024-01-' || lpad((turn % 28 + 1)::varchar, 2, '0') as date, coalesce(overlap, 0)::int as overlap,
  substr(sha256(lower(role) || chr(31) || '2024-01-' || lpad((turn % 28 + 1)::varchar, 2, '0') || chr(31) || coalesce(all_terms, '')), 1, 12) as group_id,
  round((coalesce(overlap, 0) * 10 + (role in ('user', 'assistant'))::int * 8 + 2 * case coalesce(state, 'mentioned') when 'observed' then 4 when 'mixed' then 3 when 'mentioned' then 3 when 'reference-only' then 2 when 'planned' then 1 else 0 end
    + score - 0.0001 * (turn + 1))::double, 6) as worth
from m left join state using (conv_id, turn) left join said using (conv_id, turn)""".replace("{stem}", STEMS).replace("{stop}", STOPS).replace("{near}", NEAR)


def _evidence(spark, d):
    c = tables.table(spark, d, "conversations")
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"))
    memories = c.select(
        F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("["), "role", F.lit(" "), date, F.lit("] "), F.coalesce("text", F.lit(""))).alias("text"), (F.col("conv_id") % 9).cast("double").alias("score"), (F.col("turn") + 1).alias("rank"),
    )
    return counts.evidence(memories, ASKED).withColumn("worth", F.round("worth", 6))


@query(EVIDENCE)
def event_counts(spark, d):
    """What every turn of every conversation says to a question of how many."""
    return _evidence(spark, d).select("id", "state", "speaker", "date", "overlap", "group_id", "worth")


@query(f"with e as ({EVIDENCE}) select id, state, group_id, worth from e order by worth desc, id limit 48")
def event_count_context(spark, d):
    """The 48 turns that say most to it."""
    return lexical.top(_evidence(spark, d).withColumnRenamed("worth", "score"), 48).select("id", "state", "group_id", F.col("score").alias("worth"))


@query(f"with e as ({EVIDENCE}) select state, count(*) as memories, count(distinct group_id) as groups from e group by state")
def event_count_states(spark, d):
    return counts.summary(_evidence(spark, d))
