"""Trust, reconciliation, identity, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import knowledge as kn
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

TRUST = """
with c as (select o_orderkey as id, case when o_orderpriority = '5-LOW' then 'hypothetical' when o_orderstatus = 'P' then 'superseded' else 'asserted' end as status from orders),
e as (select l_orderkey as id, count(distinct case when l_linestatus = 'F' then l_suppkey end) as support, bool_or(l_returnflag <> 'R') as active from lineitem group by l_orderkey),
x as (select l_orderkey as id, bool_or(l_discount = 0.1 and l_linestatus = 'F') as refuted, bool_or(l_tax = 0.08 and l_linestatus = 'F') as contested from lineitem group by l_orderkey),
t as (select c.id, coalesce(support, 0) as support,
  case when status = 'superseded' then 'superseded' when refuted then 'refuted' when contested then 'contested' when not coalesce(active, true) then 'stale'
       when status = 'hypothetical' then 'unverified' when support >= 2 then 'verified' when support >= 1 then 'supported' else 'unverified' end as state
  from c left join e using (id) left join x using (id))"""


def _trust(spark, d):
    """Orders as claims; their lines as episodes, of which those of line status F are independent of any model."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    status = F.when(F.col("o_orderpriority") == "5-LOW", "hypothetical").when(F.col("o_orderstatus") == "P", "superseded").otherwise("asserted")
    claims = o.select(F.col("o_orderkey").alias("id"), status.alias("status"))
    ref = F.concat(F.lit("supplier://"), F.col("l_suppkey").cast("string"))
    free = kn.independent(ref, F.lit(None).cast("string"), F.col("l_linestatus") == "O", F.lit(False))
    key = kn.evidence_key(ref, F.lit(None).cast("string"), F.col("l_linenumber").cast("string"))
    evidence = line.select(F.col("l_orderkey").alias("id"), key.alias("key"), free.alias("independent"), (F.col("l_returnflag") != "R").alias("active"))
    kind = F.when(F.col("l_discount") == 0.1, "refuted")
    also = F.when(F.col("l_tax") == 0.08, "contested")
    raised = line.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"), F.explode(F.array_compact(F.array(kind, also))).alias("kind"))
    return kn.trust(claims, evidence, raised)


@query(TRUST + " select id, state from t")
def trust_states(spark, d):
    return _trust(spark, d).select("id", "state")


@query(TRUST + " select id from t where state in ('supported', 'verified')")
def assertable_records(spark, d):
    return kn.assertable(_trust(spark, d)).select("id")


@query(TRUST + " select support, count(*) as claims from t group by support")
def independent_evidence_count(spark, d):
    return _trust(spark, d).groupBy("support").agg(F.count(F.lit(1)).alias("claims"))


RECONCILE = """
with c as (select o_custkey as subject, lower(o_orderpriority) as predicate, o_orderkey as id, o_orderstatus as object,
                  case when o_orderstatus = 'P' then null else date_trunc('year', o_orderdate) end as t0, round(o_totalprice / 1000) as conf,
                  case when lower(o_orderpriority) = '5-low' then 'multivalued' else 'functional' end as cardinality from orders),
g as (select *, count(*) over w as n, row_number() over (partition by subject, predicate order by (t0 is not null) desc, t0 desc nulls last, conf desc, id desc) as rn from c
      window w as (partition by subject, predicate)),
w as (select subject, predicate, id as winner, object as wo, t0 as wt from g where rn = 1 and n > 1),
r as (select subject, predicate, id, winner, case when id = winner then 'winner' when object = wo then 'duplicate' when cardinality = 'multivalued' then 'kept'
             when wt > t0 then 'superseded' else 'contradicted' end as relation from c join w using (subject, predicate))"""


def _reconciled(spark, d):
    o = tables.table(spark, d, "orders")
    declared = F.when(F.col("o_orderpriority") == "5-LOW", "Multivalued")
    claims = o.select(
        F.lit("local.default").alias("ns"), F.lit("project").alias("scope"), F.col("o_custkey").alias("subject"), F.lower("o_orderpriority").alias("predicate"),
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("object"), F.when(F.col("o_orderstatus") != "P", F.date_trunc("year", "o_orderdate")).alias("t0"),
        F.round(F.col("o_totalprice") / 1000).alias("conf"), kn.cardinality(F.col("o_orderpriority"), declared).alias("cardinality"),
    )
    return kn.reconcile(claims).select("subject", "predicate", "id", "winner", "relation")


def _relation(name: str):
    def run(spark, d):
        return _reconciled(spark, d).where(F.col("relation") == name).select("subject", "predicate", "id", "winner")

    run.__name__ = {"winner": "reconcile_winner", "superseded": "reconcile_supersedes", "contradicted": "reconcile_contradicts", "duplicate": "reconcile_duplicates", "kept": "reconcile_multivalued"}[name]
    query(RECONCILE + f" select subject, predicate, id, winner from r where relation = '{name}'")(run)


for _name in ("winner", "superseded", "contradicted", "duplicate", "kept"):
    _relation(_name)


@query("""
with m as (select p_type as boundary, lower(p_name) as term, p_partkey as node, p_size > 25 as alias from part),
v as (select boundary, term, node, sum((not alias)::int) as canonical, sum(alias::int) as aliases from m group by all),
l as (select *, row_number() over (partition by boundary, term order by canonical desc, aliases desc, node) as rn, count(*) over (partition by boundary, term) as n,
             max(aliases) over (partition by boundary, term) as m from v),
k as (select boundary, term, node as "into", canonical as votes from l where rn = 1 and n > 1 and m > 0)
select boundary, term, node, "into", case when votes > 0 then 0.6 else 0.4 end::double as confidence from v join k using (boundary, term) where node <> "into" and (aliases > 0 or votes = 0)""")
def merge_candidates(spark, d):
    """Parts of a type with one name; the larger ones mention it as an alias."""
    p = tables.table(spark, d, "part")
    mentions = p.select(F.col("p_type").alias("boundary"), F.lower("p_name").alias("term"), F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("alias"))
    return kn.merge_candidates(mentions)


@query("""
with recursive m as (select c_custkey as node, c_custkey // 2 as target from customer where c_acctbal > 0 and c_custkey > 0),
w(node, place, step) as (select node, target, 1 from m union all select w.node, m.target, step + 1 from w join m on w.place = m.node)
select node, arg_max(place, step) as root from w group by node""")
def resolve_canonical(spark, d):
    c = tables.table(spark, d, "customer").where("c_acctbal > 0 and c_custkey > 0")
    return kn.canonical(c.select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 2).cast("long").alias("into")))


CHAIN = """
with s as (select 'span:' || doc_id as span_id, case when lang = 'es' then 'REL' else 'SPAN' end as kind,
                  case lang when 'fr' then 'raw:gone' else 'raw:' || doc_id end as raw_id, 200 as a, 900 as b from documents),
r as (select 'clm:' || doc_id as id, unnest(case when n_chars < 100 then [null] else ['span:' || doc_id, 'span:' || (doc_id + 1)] end) as span_id,
             unnest(case when n_chars < 100 then [0] else [0, 1] end) as pos from documents),
j as (select r.id, r.pos, r.span_id, case when r.span_id is null then 'no_evidence_links' when s.kind is null then 'span_record_missing' when s.kind <> 'SPAN' then 'referenced_record_is_not_a_span'
             when d.doc_id is null then 'raw_record_missing' when s.b > length(d.text) then 'span_offsets_outside_raw_content' end as defect, substr(d.text, 201, 700) as t
      from r left join s on r.span_id = s.span_id left join documents d on 'raw:' || d.doc_id = s.raw_id)"""


def _chains(spark, d):
    """Claims cite the span of their document and of the next one; some spans are broken."""
    docs = tables.table(spark, d, "documents")
    span = F.array(tables.tagged("span", "doc_id"), F.concat(F.lit("span:"), (F.col("doc_id") + 1).cast("string")))
    records = docs.select(tables.tagged("clm", "doc_id").alias("id"), F.when(F.col("n_chars") < 100, F.array().cast("array<string>")).otherwise(span).alias("evidence"))
    raw_id = F.when(F.col("lang") == "fr", "raw:gone").otherwise(tables.tagged("raw", "doc_id"))
    spans = docs.select(tables.tagged("span", "doc_id").alias("span_id"), F.when(F.col("lang") == "es", "REL").otherwise("SPAN").alias("kind"), raw_id.alias("raw_id"), F.lit(200).alias("start"), F.lit(900).alias("end"))
    raws = docs.select(tables.tagged("raw", "doc_id").alias("raw_id"), F.lit("RAW").alias("kind"), F.col("text").alias("content"))
    return kn.chains(records, spans, raws)


@query(CHAIN + " select id, cast(pos as integer) as pos, span_id, defect, case when defect is null then md5(t) end as text_md5 from j")
def provenance_chain(spark, d):
    pos = F.coalesce("pos", F.lit(0))
    return _chains(spark, d).select("id", pos.cast("int").alias("pos"), "span_id", "defect", F.md5("text").alias("text_md5"))


@query(CHAIN + """,
e as (select id, bool_and(defect is null) as ok from j group by id)
select sum(ok::int)::bigint as complete, count(*) as total, round(sum(ok::int) / count(*), 6)::double as share from e""")
def provenance_completeness(spark, d):
    return kn.completeness(_chains(spark, d))


@query(CHAIN + " select coalesce(defect, 'none') as defect, count(*) as links from j group by 1")
def provenance_defects(spark, d):
    return _chains(spark, d).groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("links"))


@query("""
with m as (select c_custkey as node, c_custkey // 2 as target from customer where c_custkey > 0)
select case when target in (select o_custkey from orders where o_orderstatus = 'F') and node in (select o_custkey from orders where o_orderstatus = 'F') then 'accepted' else 'conflict' end as state, count(*) as merges from m group by 1""")
def merge_revalidation(spark, d):
    """Accepted merges whose nodes are still there stay accepted; the others are in conflict."""
    c = tables.table(spark, d, "customer").where("c_custkey > 0")
    merges = c.select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 2).cast("long").alias("into"))
    nodes = tables.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return kn.revalidated(merges, nodes).groupBy("state").agg(F.count(F.lit(1)).alias("merges"))
