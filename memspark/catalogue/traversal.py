"""Retrieval over relations: what a question's entities lead to under budgets, and all legs fused."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import traversal as tv
from memspark.operators import vectors
from memspark.operators import grounding as gr
from memspark.functions import text as tx
from memspark.plans import query as pq
from memspark.plans import retrieve as rt
from memspark.scratch import materialize
from memspark.sources import tables

from .graph import NODES
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

QUESTION = "nation_3 america"
MODEL = "hash/64"


def _stores(spark, d):
    """Entities and relations of the star schema as records; each relation is grounded in its ends. Edges are written once, as
    every leg and hop scans them; without their supplies' times and counts they are pairs."""
    own = {"ns": F.lit("local.default"), "scope": F.lit("project"), "status": F.lit("asserted"), "conf": F.lit(1.0), "t0": F.lit(None).cast("timestamp")}
    nodes = tables.nodes(spark, d)
    edges = materialize(tables.place_edges(spark, d).unionByName(tables.supply_edges(spark, d).select("src", F.lit("works_with").alias("predicate"), "dst")), "relations")
    ends = F.concat("src", F.lit(">"), "dst")
    relations = edges.select(F.concat(F.lit("e:"), ends).alias("id"), "src", "predicate", "dst", F.concat(F.lit("rel:"), ends).alias("source"))
    entities = nodes.select("id", F.lit("ENT").alias("kind"), F.col("label").alias("content"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("object")).withColumns(own)
    rels = relations.select(F.col("source").alias("id"), F.lit("REL").alias("kind"), F.concat_ws(" ", "src", "predicate", "dst").alias("content"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("object")).withColumns(own)
    pair = F.array(F.struct(F.lit("subject").alias("predicate"), F.col("src").alias("dst")), F.struct(F.lit("object").alias("predicate"), F.col("dst").alias("dst")))
    grounding = relations.select(F.col("source").alias("src"), F.inline(pair)).withColumns({"ns": own["ns"], "scope": own["scope"]})
    return rt.Stores(
        entities.unionByName(rels), relations=relations, entities=entities.select("id", "ns", "scope"), grounding=grounding, model=MODEL
    )


def _walk(hops: int, limit: int, semantic: str) -> str:
    """A traversal of `hops` as that many steps spelled out. semantic: SQL of the records (id) that mean something."""
    nodes = f"greatest((select count(*) from f0), {min(tv.LOAD, max(64, 32 * limit))})"
    edges = f"least(4096, greatest(256, 8 * {nodes}))"
    sql = NODES + f""",
rel as (select 'e:' || src || '>' || dst as id, src, case predicate when 'supplies' then 'works_with' else predicate end as predicate, dst, 'rel:' || src || '>' || dst as source from edges),
rec as (select id, label as content from nodes union all select source, src || ' ' || predicate || ' ' || dst from rel),
lex as (select id, len(list_intersect(regexp_extract_all(lower(content), '[a-z0-9_:-]+'), ['nation_3', 'america'])) / 2.0 as lexical from rec),
said as (select id from lex where lexical > 0 and id in (select src from rel union select dst from rel) order by id limit 200),
own as ({semantic}),
meant as (select distinct unnest([src, dst]) as id from rel join own on source = own.id order by id limit 300),
f0 as (select id from said union select id from meant),
n0 as (select id as child, null::varchar as source, '' as path from f0)"""
    for h in range(1, hops + 1):
        before = " union all ".join(f"select child, source from n{k}" for k in range(h))
        sql += f""",
r{h} as ({before}),
h{h} as (select * from rel where src in (select child from n{h - 1}) or dst in (select child from n{h - 1}) order by id limit {edges}),
c{h} as (select dst as child, {{'p': src, 'e': id, 's': source}} as way from h{h} where src in (select child from n{h - 1}) union all
  select src, {{'p': dst, 'e': id, 's': source}} from h{h} where dst in (select child from n{h - 1})),
m{h} as (select child, min(way) as way from c{h} where child not in (select child from r{h}) group by child),
n{h} as (select m.child, way.s as source, trim(n.path || ',' || way.e, ',') as path from m{h} m join n{h - 1} n on n.child = way.p
  qualify row_number() over (order by m.child) <= least({nodes} - (select count(*) from r{h}), (500 - (select count(*) + count(source) from r{h})) // 2))"""
    every = " union all ".join(f"select child, source, path, {h} as hop from n{h}" for h in range(hops + 1))
    looked = " union all ".join(f"select * from h{h}" for h in range(1, hops + 1))
    late = " union all ".join(
        f"select c.child, way, {h} as hop, n.path from c{h} c join n{h - 1} n on n.child = way.p where c.child in (select child from r{h} union select child from n{h})" for h in range(1, hops + 1)
    )
    return sql + f""",
taken as ({every}), looked as ({looked}),
near as (select u, count(distinct v) as n from (select src as u, dst as v from looked union all select dst, src from looked) group by u),
late as (select way.s as source, min({{'h': hop, 'w': way}}) as least, arg_min(trim(path || ',' || way.e, ','), {{'h': hop, 'w': way}}) as path from ({late}) group by 1),
extra as (select source, least.h as hop, path from late where source not in (select source from taken where source is not null)
  order by source not in (select id from own), hop, source limit (select 500 - count(*) - count(source) from taken)),
found as (select child as id, hop, path, false as attributed from taken union all select source, hop, path, true from taken where source is not null union all select source, hop, path, true from extra),
scored as (select found.id, hop, coalesce(n, 0) as neighbours, path, round((lexical + least(0.6, coalesce(n, 0) * 0.1) + 0.5 * (found.id in (select id from said))::int
    + 0.25 * (found.id in (select id from meant) or attributed and found.id in (select id from own))::int + 0.1 * attributed::int)::double, 9) as score
  from found join lex using (id) left join near on found.id = u)"""


CUSTOMER = "select source as id from rel where src = 'customer:8'"


@query(_walk(3, 10, CUSTOMER) + " select id, hop, neighbours, path, score from scored")
def relation_traversal(spark, d):
    """Three hops from the entities that a question names and those of a customer's relations, with the paths."""
    stores = _stores(spark, d)
    plan = pq.plan(QUESTION, mode="graph", budget=10)
    rels = stores.relations
    meant = rels.where("src = 'customer:8'").select(F.col("source").alias("id"))
    lexical = tx.overlap(plan.residual, F.col("content"))
    words = stores.records.where((F.col("kind") == "ENT") & (lexical > 0)).select("id")
    ends = rels.select(F.col("source").alias("id"), "src", "dst")
    ground = lambda seeds, most, direct: gr.ground_seeds(seeds, stores.entities, stores.records, stores.grounding, ends, most, direct)
    reached = tv.traverse(spark, rels, ground(words, tv.seed_room(True, 10), True), ground(meant, tv.SEEDS, False), 3, 10, meant)
    scores = tv.hits(reached, stores.records, lexical).select("id", "hop", F.array_join(F.transform("path", lambda p: p["edge"]), ",").alias("path"), F.round("score", 9).alias("score"))
    return scores.join(reached.select("id", "neighbours"), "id").select("id", "hop", "neighbours", "path", "score")


HASHED = """
tok as (select id, unnest(regexp_extract_all(lower(entity_type || ' ' || label), '[a-z0-9_:-]+')) as t from nodes),
h as (select t, ('0x' || substr(sha256(t), 1, 8))::bigint % 64 as i, case when ('0x' || substr(sha256(t), 9, 2))::bigint % 2 = 0 then 1.0 else -1.0 end as v
      from (select distinct t from tok union select unnest(['nation_3', 'america']))),
s as (select id, i, sum(v)::double as v from tok join h using (t) group by id, i), q as (select i, sum(v)::double as v from h where t in ('nation_3', 'america') group by i),
z as (select id, sqrt(sum(v * v)) as n from s group by id), zq as (select sqrt(sum(v * v)) as n from q),
cos as (select id, round(sum(s.v * q.v) / (z.n * zq.n), 9) as score from s join q using (i) join z using (id), zq where z.n > 0 group by id, z.n, zq.n having sum(s.v * q.v) > 1e-9),
near_nodes as (select id, score from cos order by score desc, id limit 20)"""


@query(_walk(3, 20, "select id from near_nodes where false").replace("with nodes", "with nodes", 1).replace(
    "own as (", HASHED.lstrip() + ",\nown as (", 1).replace("meant as (select distinct unnest([src, dst]) as id from rel join own on source = own.id order by id limit 300)",
    "meant as (select id from near_nodes where id in (select src from rel union select dst from rel))") + """,
leg as (select 'graph' as leg, id, score from (select id, score from scored order by score desc, id limit 20) union all select 'graph_node', id, score from near_nodes union all
  select 'sql', id, score from (select id, 0.22 * (contains(lower(content), 'nation_3')::int + contains(lower(content), 'america')::int) + 0.55 * contains(lower(content), 'nation_3 america')::int + 0.15 as score
    from rec where contains(lower(content), 'nation_3') or contains(lower(content), 'america') order by score desc, id limit 20)),
ranked as (select leg, id, row_number() over (partition by leg order by score desc, id) as rank from leg)
select id, round(sum(1.0::double / (60 + rank)), 9) as score, string_agg(leg, ',' order by leg) as legs from ranked group by id order by sum(1.0::double / (60 + rank)) desc, id limit 10""")
def graph_retrieval(spark, d):
    """A question over entities and relations: words, graph nodes near it, and the relations around both, fused."""
    stores = _stores(spark, d)
    nodes = tables.nodes(spark, d).select("id", F.col("entity_type").alias("kind"), "label", F.create_map().cast("map<string,string>").alias("properties"), F.lit("asserted").alias("status"), F.lit(None).cast("string").alias("source_record_id"))
    said = gr.node_text(F.col("kind"), F.col("label"), F.col("properties"))
    stores.nodes = nodes
    stores.node_index = nodes.select("id", vectors.hashed(tx.tokens(said)).alias("embedding"), gr.source_hash(said, MODEL).alias("source_hash"))
    plan = pq.plan(QUESTION, mode="mix", budget=10)
    plan = pq.Plan(**{**plan.__dict__, "legs": ("sql", "graph")})
    asked = vectors.hash_embed(tx.query_tokens(QUESTION))
    return rt.retrieve(stores, plan, embedding=asked).select("id", F.round("score", 9).alias("score"), "legs")
