"""Batch operations, telemetry, projections, ids by document, merges, reasoning nodes, outcomes, notation and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import language as lg
from memspark.functions import text as tx
from memspark.operators import evaluation as ev
from memspark.operators import fidelity as fi
from memspark.operators import ingest as ig
from memspark.scratch import materialize
from memspark.sources import compact, tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
with i as (select o_custkey as key, o_orderkey as item, o_orderpriority as payload from orders),
n as (select key, count(*) as n, string_agg(item || chr(9) || sha256(payload), chr(10) order by item) as lines from i group by key),
g as (select key, n, case when n <= 12 then sha256(lines) end as digest from n)
select key, n, digest, case when n > 12 then 'too_large' when key % 3 = 0 then 'replay' when key % 3 = 1 then 'conflict' else 'new' end as state from g""")
def batch_operations(spark, d):
    """A customer's orders are an operation of at most 12 items; a third came before, a third with other items."""
    items = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("payload"))
    before = ig.plan_batches(items, items.where("false").select("key", F.lit("").alias("digest")), 12).where("key % 3 != 2")
    stored = before.select("key", F.when(F.col("key") % 3 == 0, F.coalesce("digest", F.lit(""))).otherwise("other").alias("digest"))
    return ig.plan_batches(items, stored, 12)


@query("select o_custkey as key, o_orderkey as item from orders where o_orderstatus <> 'F'")
def batch_resume(spark, d):
    """The items that are still to do of a batch that broke off."""
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    return ig.pending_items(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'"))


@query("""
with e as (select l_orderkey as k, count(*) as n from lineitem group by l_orderkey)
select coalesce(case when k % 17 = 0 then 'run_id' when k % 10 = 0 then 'ranks' when k % 11 = 0 then 'scores' end, 'appended') as outcome, count(*) as n from e group by 1""")
def telemetry_append(spark, d):
    """Retrieval events, one an order: ranks and scores must be as many as candidates; faulty events are told, not appended."""
    e = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("candidate_ids"))  # at most seven lines an order
    k, n = F.col("l_orderkey"), F.size("candidate_ids")
    rows = e.select(
        F.when(k % 17 == 0, "").otherwise(k.cast("string")).alias("run_id"), F.lit("q").alias("query"), F.lit("search").alias("source_kind"), "candidate_ids",
        F.sequence(F.lit(0), F.when(k % 10 == 0, n).otherwise(n - 1)).alias("ranks"), F.when(k % 11 == 0, F.array_repeat(F.lit(0.5), n + 1)).when(k % 2 == 0, F.array_repeat(F.lit(0.5), n)).alias("scores"),
    )
    return rows.groupBy(F.coalesce(ig.telemetry_fault(), F.lit("appended")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
select 'cust:' || o_custkey as record_id, lower(o_orderpriority) as projection_kind, arg_max(o_orderstatus || ' ' || floor(o_totalprice)::bigint, o_orderkey) as text, cast(arg_max(length(o_orderstatus), o_orderkey) as bigint) as token_count
from orders group by 1, 2""")
def derived_projections(spark, d):
    o = tables.table(spark, d, "orders")
    text = F.concat_ws(" ", "o_orderstatus", F.floor("o_totalprice").cast("long").cast("string"))
    rows = o.select(F.concat(F.lit("cust:"), "o_custkey").alias("record_id"), F.lower("o_orderpriority").alias("projection_kind"), text.alias("text"), F.length("o_orderstatus").cast("long").alias("token_count"), F.col("o_orderkey").alias("seq"))
    return ig.projections(rows)


@query("""
select 'clm:' || o_custkey || ':' || o_orderkey as id, case when o_orderstatus = 'F' then 'clm:' || o_custkey || ':' || o_orderkey else 'ent:' || o_orderstatus end as ref from orders""")
def namespaced_ids(spark, d):
    """Claims of a document, which is a customer: a reference within it is renamed, one to what it does not hold stays."""
    o = tables.table(spark, d, "orders")
    rid = tables.tagged("clm", "o_orderkey")
    records = o.select(F.col("o_custkey").alias("document"), rid.alias("id"))
    refs = o.select(F.col("o_custkey").alias("document"), rid.alias("id"), F.when(F.col("o_orderstatus") == "F", rid).otherwise(tables.tagged("ent", "o_orderstatus")).alias("ref"))
    return ig.namespaced_batch(records, refs)[1].select("id", "ref")


MERGES_SQL = """
with recursive ledger as (select c_custkey // 2 as canonical, c_custkey as alias, case c_custkey % 3 when 0 then 'proposed' when 1 then 'accepted' else 'split' end as status from customer where c_custkey > 1),
p as (select c_custkey as canonical, c_custkey // 2 as alias from customer where c_custkey > 1 union select c_custkey // 2, c_custkey from customer where c_custkey > 1
      union select c_custkey + 1, c_custkey from customer union select c_custkey, c_custkey // 8 from customer where c_custkey > 7 union select c_custkey, c_custkey from customer where c_custkey % 10 = 0),
up(node, far, n) as (select alias, canonical, 1 from ledger where status = 'accepted' union all select node, canonical, n + 1 from up join ledger on ledger.alias = far and status = 'accepted' where n < 64),
root as (select node, arg_max(far, n) as root from up group by node),
j as (select p.canonical, p.alias, l.status as held, exists (select 1 from ledger r where r.canonical = p.alias and r.alias = p.canonical and r.status <> 'split') as back,
             (select canonical from ledger a where a.alias = p.alias and a.status = 'accepted') as taken, root
      from p left join ledger l on l.canonical = p.canonical and l.alias = p.alias left join root on root.node = p.canonical),
k as (select *, case when canonical = alias then 'self' when held in ('accepted', 'split') then null when back then 'reverse' when taken <> canonical then 'absorbed' when root = alias then 'cycle' end as reason from j)
select canonical, alias, case when reason = 'self' then 'refused' when reason is not null then 'conflict' when held in ('accepted', 'split') then held else 'proposed' end as status, reason from k"""


@query(MERGES_SQL)
def merge_proposals(spark, d):
    """Proposals against a ledger whose accepted merges form chains."""
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    half = F.floor(F.col("k") / 2).cast("long")
    status = F.when(F.col("k") % 3 == 0, "proposed").when(F.col("k") % 3 == 1, "accepted").otherwise("split")
    ledger = c.where("k > 1").select(half.alias("canonical"), F.col("k").alias("alias"), status.alias("status"))
    made = [(F.col("k"), half, "k > 1"), (half, F.col("k"), "k > 1"), (F.col("k") + 1, F.col("k"), "true"), (F.col("k"), F.floor(F.col("k") / 8).cast("long"), "k > 7"), (F.col("k"), F.col("k"), "k % 10 = 0")]
    proposals = None
    for a, b, where in made:
        one = c.where(where).select(a.alias("canonical"), b.alias("alias"))
        proposals = one if proposals is None else proposals.unionByName(one)
    return ig.classified_merges(proposals, ledger)


@query("""
with t as (select conv_id as run, conv_id || '-' || turn as node, turn, case turn % 3 when 0 then null when 1 then conv_id || '-' || (turn - 1) else (conv_id + 1) || '-0' end as ref from conversations),
ok as (select *, ref is null or exists (select 1 from t u where u.run = t.run and u.node = t.ref) as accepted from t where turn >= 2),
l as (select run, max(turn + 1) as last from t where turn < 2 group by run)
select ok.run, node, accepted, case when accepted then coalesce(last, 0) + row_number() over (partition by ok.run, accepted order by turn, node) end as seq from ok left join l on l.run = ok.run""")
def reasoning_nodes(spark, d):
    """Turns after the second are appended to a run; a third refer to another run and are refused."""
    c = tables.table(spark, d, "conversations")
    name = lambda run, turn: F.concat_ws("-", run.cast("string"), turn.cast("string"))
    run, turn = F.col("conv_id"), F.col("turn")
    ref = F.when(turn % 3 == 1, name(run, turn - 1)).when(turn % 3 == 2, name(run + 1, F.lit(0)))
    t = c.select(run.alias("run"), name(run, turn).alias("node"), turn.alias("pos"), ref.alias("ref"))
    return ig.appended_nodes(t.where("pos < 2").select("run", "node", (F.col("pos") + 1).alias("seq")), t.where("pos >= 2"))


@query("""
with lineitem as (select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus from lineitem group by all),
v as (select l_orderkey as k, l_linenumber as n, l_orderkey % 5 as run, case when l_returnflag <> 'R' then 'passed' else 'failed' end as verdict,
                  exists (select 1 from lineitem m where m.l_orderkey = l.l_orderkey and m.l_linenumber = l.l_linenumber + 1 and m.l_linestatus = 'F' and m.l_linenumber % 2 = 0) as retried from lineitem l)
select o_orderkey as outcome, count(n) as checks, count(n) > 0 and coalesce(bool_and(verdict = 'passed' and not retried and run = case when o_orderkey % 9 = 0 then -1 else o_orderkey % 5 end), false) as accepted
from orders left join v on k = o_orderkey and n <= o_orderkey % 4 group by o_orderkey""")
def verified_outcomes(spark, d):
    """Outcomes that name their order's first lines as checks; an even line retries the one before."""
    line = tables.dealt_lines(spark, d, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    line = materialize(line, "lines")  # read as checks, as retries and as what outcomes name
    vid = lambda n: F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"))
    n = F.col("l_linenumber")
    v = line.select(vid(n).alias("verification"), (F.col("l_orderkey") % 5).alias("run"), F.when(F.col("l_returnflag") != "R", "passed").otherwise("failed").alias("verdict"), F.when((F.col("l_linestatus") == "F") & (n % 2 == 0), vid(n - 1)).alias("retry_of"))
    o = tables.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(F.col("o_orderkey") % 5).alias("run"))
    parts = max(1, -(-o.count() // ig.CHECKS))
    named = line.where(n <= F.col("l_orderkey") % 4).select(F.col("l_orderkey").alias("o_orderkey"), vid(n).alias("verification"))
    rows = o.repartition(parts, "o_orderkey").join(named.repartition(parts, "o_orderkey").hint("merge"), "o_orderkey", "left").select(F.col("o_orderkey").alias("outcome"), "run", "verification")
    return ig.verified_outcomes(rows, v)


@query("""
select 'clm:' || o_orderkey as id, 'C clm:' || o_orderkey || case when o_custkey % 2 = 0 then '' else ' ~n=ns.' || lower(o_orderstatus) end
       || case o_orderstatus when 'F' then '' when 'O' then ' ~s=o' else ' ~s=z' end || ' ~@raw:' || o_custkey
       || ' ~t0="' || strftime(o_orderdate, '%Y-%m-%d') || '" subject=cust:' || o_custkey || ' predicate="' || lower(o_orderpriority) || '" object=' || o_orderstatus || ' n=' || o_orderkey as value from orders""")
def compact_lines(spark, d):
    return compact.encoded(_claims(spark, d))


def _claims(spark, d):
    o = tables.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "asserted").when(F.col("o_orderstatus") == "O", "observed").otherwise("superseded")
    attrs = F.to_json(F.struct(tables.tagged("cust", "o_custkey").alias("subject"), F.lower("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderkey").alias("n")))
    ns = F.when(F.col("o_custkey") % 2 == 0, "local.default").otherwise(F.concat(F.lit("ns."), F.lower("o_orderstatus")))
    return o.select(
        tables.tagged("clm", "o_orderkey").alias("id"), F.lit("CLM").alias("kind"), ns.alias("ns"), F.lit("project").alias("scope"), status.alias("status"), F.lit(1.0).alias("conf"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t0"), F.lit(None).cast("string").alias("t1"),
        F.array(tables.tagged("raw", "o_custkey")).alias("prov"), F.array().cast("array<string>").alias("evidence"), attrs.alias("attrs"),
    )


@query("""
select 'clm:' || o_orderkey as id, 'CLM' as kind, case when o_custkey % 2 = 0 then 'local.default' else 'ns.' || lower(o_orderstatus) end as ns,
       case o_orderstatus when 'F' then 'asserted' when 'O' then 'observed' else 'superseded' end as status, strftime(o_orderdate, '%Y-%m-%d') as t0, 'raw:' || o_custkey as prov,
       '{"subject":"cust:' || o_custkey || '","predicate":"' || lower(o_orderpriority) || '","object":"' || o_orderstatus || '","n":' || o_orderkey || '}' as attrs from orders""")
def compact_round_trip(spark, d):
    rows = compact.decoded(compact.encoded(_claims(spark, d)).select("value"))
    return rows.select("id", "kind", "ns", "status", "t0", F.array_join("prov", ",").alias("prov"), "attrs")


@query("""
select item_id, case when regexp_matches(text, '(?i)\\b(?:all|both|each|every)\\b|\\bhow many\\b|\\b(?:list|enumerate|name)\\b|\\b(?:which|what)\\b.{0,48}\\b(?:{nouns})\\b') then 'set-completion'
  when regexp_matches(text, '(?i)\\b(?:infer|imply|likely|probably|suggests?)\\b|\\bwhat (?:kind|type) of\\b|\\bbased on (?:this|that|the conversation|what)\\b|\\b(?:might|could) (?:be|have|mean|suggest)\\b') then 'inference' else 'direct' end as intent
from (select item_id, case item_id % 6 when 0 then 'How many ' when 1 then 'What does this likely mean: ' when 2 then 'Which of the people ' when 3 then 'What could be ' when 4 then 'What kind of ' else '' end || text as text from benchmark)""".replace("{nouns}", lg.SET_NOUNS))
def conversation_intent(spark, d):
    b = tables.table(spark, d, "benchmark")
    asked = ["How many ", "What does this likely mean: ", "Which of the people ", "What could be ", "What kind of ", ""]
    lead = F.element_at(F.array(*map(F.lit, asked)), (F.col("item_id") % 6 + 1).cast("int"))
    return b.select("item_id", lg.conversation_intent(F.concat(lead, "text")).alias("intent"))


NO_NAMES_SQL = ",".join(f"'{w}'" for w in lg.NO_NAMES)


@query(f"""
with r as (select doc_id, unnest(x) as run, unnest(range(len(x))) as i from (select doc_id, regexp_extract_all(text, '[A-Z][A-Za-z0-9]*(?:\\s+[A-Z][A-Za-z0-9]*)*') as x from documents)),
k as (select doc_id, i, list_aggregate(list_filter(regexp_split_to_array(run, '\\s+'), lambda w: w not in ({NO_NAMES_SQL})), 'string_agg', ' ') as run from r),
f as (select doc_id, arg_min(run, i) as run, min(i) as i from k where run <> '' group by doc_id, lower(run))
select doc_id, count(*) as names, sha256(string_agg(run, '|' order by i)) as digest from f group by doc_id""")
def proper_nouns(spark, d):
    """Names in every whole text; their digest keeps their order."""
    names = lg.proper_nouns(tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"])  # one document's names
    return names.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("names"), F.sha2(F.array_join(ordered, "|"), 256).alias("digest"))


@query("""
with q as (select doc_id, text, split_part(trim(text), ' ', 1) as a, split_part(trim(text), ' ', 2) as b from documents where regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ ')),
c as (select doc_id, text, a || ' ' || b as there, b || ' ' || a as turned from q)
select doc_id, there as found, case when regexp_matches(text, '(?i)(^|[^\\w])' || split_part(turned, ' ', 1) || '\\s+' || split_part(turned, ' ', 2) || '($|[^\\w])') then 'grounded' else 'refused' end as turned from c""")
def grounding_gate(spark, d):
    """Two words as a text begins with them stand in it; turned round they do only if the text says so too."""
    rows = tables.table(spark, d, "documents").where(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ "))
    words = F.split(F.trim("text"), " ")
    there, turned = F.concat_ws(" ", words[0], words[1]), F.concat_ws("  ", words[1], words[0])
    return rows.select("doc_id", lg.grounded(F.upper(there), F.col("text")).alias("found"), F.when(lg.grounded(turned, F.col("text")).isNotNull(), "grounded").otherwise("refused").alias("turned"))


@query("""
with c as (select o_custkey as pack, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n, 'cust:' || o_custkey || ' ' || lower(o_orderpriority) || ' ' || o_orderstatus as said from orders),
s as (select c_custkey as pack, 'segment=' || c_mktsegment || '; nation=' || c_nationkey as said from customer where c_custkey % 4 = 0),
j as (select pack, string_agg(said, '; ' order by o_orderkey) as said from c where n <= 6 group by pack)
select c_custkey as pack, '[general] ' || coalesce(s.said, j.said, 'No narrative context available.') as text from customer left join s on s.pack = c_custkey left join j on j.pack = c_custkey""")
def narrative_pack(spark, d):
    """A customer's first state as a narrative, else the first six claims."""
    cust = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("pack"), "c_mktsegment", "c_nationkey")
    fields = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    states = cust.where("pack % 4 = 0").select("pack", F.lit(1).alias("pos"), fields.alias("fields"))
    o = tables.table(spark, d, "orders")
    claims = o.select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("cust:"), "o_custkey").alias("subject"), F.lower("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"))
    return ev.narratives(cust.select("pack"), states, claims, limit=6)


@query("""
with f(fact, a, b) as (values ('one', '1-urgent', 'f'), ('two', '5-low', 'o'), ('none', null, null)),
x as (select c_custkey, fact, a is not null and (c_custkey % 10 = 0 or exists (select 1 from orders where o_custkey = c_custkey and lower(o_orderpriority) = a and lower(o_orderstatus) = b)) as kept
      from customer, f where c_custkey % 7 <> 0 and (fact <> 'none' or c_custkey % 2 = 0))
select c_custkey as case_id, round(coalesce(avg(kept::int), 1.0), 6) as retention from customer left join x using (c_custkey) group by c_custkey""")
def temporal_retention(spark, d):
    """Two or three facts a customer, recovered by the tokens of an order, or by a time that every tenth has."""
    k = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))
    empty = F.array().cast("array<string>")
    said = {"one": F.array(F.lit("1-urgent"), F.lit("f")), "two": F.array(F.lit("5-low"), F.lit("o")), "none": empty}
    made = [F.struct(F.lit(k).alias("fact"), v.alias("tokens")) for k, v in said.items()]
    facts = k.where("case_id % 7 != 0").select("case_id", F.inline(F.array(*made))).where("fact != 'none' or case_id % 2 = 0")
    claims = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), tx.tokens(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("tokens"))
    return fi.temporal_retention(k, facts, claims, k.where("case_id % 10 = 0")).withColumn("retention", F.round("retention", 6))


@query("""
with s as (select distinct o_custkey, o_orderkey, l_suppkey % 3 = 0 as sound from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber < 3),
c as (select o_custkey, o_orderkey, coalesce(bool_or(sound), false) as sound from s group by all)
select c_custkey as case_id, round(coalesce(avg(sound::int), 1.0), 6) as retention from customer left join c on o_custkey = c_custkey group by c_custkey""")
def provenance_retention(spark, d):
    """Orders as claims, their first two lines as spans, every third supplier as a raw record that is there."""
    k = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))
    line = tables.table(spark, d, "lineitem").where("l_linenumber < 3").select("l_orderkey", F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey").alias("span"), F.col("l_suppkey").alias("raw_id"))
    o = tables.table(spark, d, "orders")
    claims = o.join(line, o["o_orderkey"] == line["l_orderkey"], "left").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("claim"), "span")
    raws = tables.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("raw_id"))
    return fi.provenance_retention(k, claims, line.select("span", "raw_id"), raws).withColumn("retention", F.round("retention", 6))
