"""Vector search, index health, hash embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.functions import vectors as vx
from memspark.operators import lexical, vectors
from memspark.scratch import folder
from memspark.sources import tables

from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: The query vector: alternating signs.
PROBE = [1.0 if i % 3 else -0.5 for i in range(64)]
SQL_PROBE = "[" + ",".join(str(x) for x in PROBE) + "]::double[64]"
COSINE = f"list_cosine_similarity(embedding::double[], {SQL_PROBE}::double[])"


def _index(spark, d):
    e = tables.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("scope"), "label")


@query(f"""
select vec_id as id, round({COSINE}, 9) as score from embeddings where {COSINE} > 0 order by score desc, id limit 10""")
def vector_cosine_topk(spark, d):
    return vectors.nearest(_index(spark, d), PROBE, 10).select("id", "score")


@query(f"""
select vec_id as id, round({COSINE} + 0.05, 9) as score from embeddings where label = 3 and {COSINE} > 0 order by score desc, id limit 10""")
def vector_cosine_scoped(spark, d):
    """The filtered leg: 0.05 for the matched filter, added after the cut at 0."""
    return vectors.nearest(_index(spark, d), PROBE, 10, where=F.col("scope") == "3", bonus=F.lit(0.05)).select("id", "score")


def _bucket_index(spark, d):
    path = folder(spark, "buckets")
    vectors.write_index(_index(spark, d).select("id", "embedding"), path, 64)
    return spark.read.parquet(path)


@query()
def vector_approximate_topk(spark, d):
    return vectors.approximate(_bucket_index(spark, d), PROBE, 10).select("id", "score")


@query("""
with s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as score
           from embeddings q, embeddings e where q.vec_id % 50 = 0),
t as (select query_id from s where score > 0 qualify row_number() over (partition by query_id order by score desc, id) <= 10)
select query_id, count(*) as exact, true as enough from t group by query_id having count(*) > 0""")
def vector_bucket_recall(spark, d):
    """For every fiftieth vector, whether the index finds nine of ten of the nearest ten over all such queries."""
    index = _bucket_index(spark, d)
    rows = _index(spark, d).select("id", "embedding")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = vectors.approximate_join(asked, index, 64, 10)
    exact = vectors.exact_join(asked, rows, 10)
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("met")), ["query_id", "id"], "left")
    share = both.agg((F.count("met") >= 0.9 * F.count(F.lit(1))).alias("enough"))
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("exact")).join(F.broadcast(share))  # one row


@query("""
select coalesce(case when len(embedding) <> 64 then 'dimension' when list_bool_or(list_transform(embedding, lambda x: isnan(x) or isinf(x))) then 'nonfinite'
                     when list_bool_and(list_transform(embedding, lambda x: x = 0)) then 'zero' end, 'none') as issue, count(*) as n
from embeddings group by 1""")
def vector_issue_report(spark, d):
    found = vectors.issues(_index(spark, d), 64)
    return found.groupBy(F.coalesce("issue", F.lit("none")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select doc_id as id, sha256(text) as h, lang as ns, source as sc from documents),
i as (select e.vec_id as id, coalesce(sha256(d.text), 'gone') as h, coalesce(d.lang, 'en') as ns,
             case when e.label = 9 then 'src-other' else coalesce(d.source, '') end as sc
      from embeddings e left join documents d on d.doc_id = e.vec_id)
select coalesce(r.id, i.id) as id,
       case when r.id is null then 'orphan' when i.id is null then 'missing' when r.h <> i.h then 'source' when r.ns <> i.ns then 'namespace'
            when r.sc <> i.sc then 'scope' end as state
from r full join i on r.id = i.id
where r.id is null or i.id is null or r.h <> i.h or r.ns <> i.ns or r.sc <> i.sc""")
def stale_orphan_vectors(spark, d):
    docs = tables.table(spark, d, "documents")
    records = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("source_hash"), F.col("lang").alias("ns"), F.col("source").alias("scope"))
    held = _index(spark, d).join(records.select("id", "source_hash", "ns", F.col("scope").alias("own")), "id", "left")
    index = held.select(
        "id", "embedding", F.coalesce("source_hash", F.lit("gone")).alias("source_hash"), F.coalesce("ns", F.lit("en")).alias("ns"),
        F.when(F.col("label") == 9, "src-other").otherwise(F.coalesce("own", F.lit(""))).alias("scope"),
    )
    return vectors.stale_and_orphans(records, index, 64)


@query("""
with q as (select label as query_id, list(a order by i) as v from (
             select label, i, avg(embedding[i]::double) as a from embeddings, range(1, 65) t(i) group by label, i) group by label),
s as (select query_id, vec_id, label = query_id as gold, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, q)
select query_id, arg_max(gold, {'s': score, 'i': -vec_id}) as top_is_gold,
       round(coalesce(max(score) filter (gold) - max(score) filter (not gold), 0.0), 6) as margin from s group by query_id""")
def embedding_margin(spark, d):
    """A query a label: the mean vector; gold are the label's own vectors."""
    index = _index(spark, d)
    means = index.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    asked = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("v"))
    return vectors.label_margins(index, asked.select(F.col("label").alias("query_id"), "v")).withColumn("margin", F.round("margin", 6))


@query("""
with q as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_:-]+')) as ts from benchmark), e as (select item_id, unnest(ts) as t from q),
c as (select item_id, ('0x' || substr(sha256(t), 1, 8))::bigint % 64 as i,
             case when ('0x' || substr(sha256(t), 9, 2))::bigint % 2 = 0 then 1.0 else -1.0 end as v from e),
s as (select item_id, i, sum(v)::double as v from c group by item_id, i), n as (select item_id, sqrt(sum(v * v)) as z from s group by item_id)
select item_id, i, round(v / z, 9)::double as x from s join n using (item_id) where v <> 0""")
def hash_embedding_parts(spark, d):
    """Nonzero places of the hash embedding of each benchmark text's distinct tokens."""
    b = tables.table(spark, d, "benchmark")
    words = b.select(F.col("item_id").alias("id"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    return vectors.hash_embedding(words).select(F.col("id").alias("item_id"), "i", F.round("x", 9).alias("x"))


@query("""
with e as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_:-]+')) as t from documents),
h as (select t, ('0x' || substr(sha256(t), 1, 8))::bigint % 64 as i,
             case when ('0x' || substr(sha256(t), 9, 2))::bigint % 2 = 0 then 1.0 else -1.0 end as v
      from (select distinct t from e union select unnest(['the', 'onthe', 'thing', 'of', 'ha']))),
s as (select doc_id, i, sum(v)::double as v from e join h using (t) group by doc_id, i),
q as (select i, sum(v)::double as v from h where t in ('the', 'onthe', 'thing', 'of', 'ha') group by i),
z as (select doc_id, sqrt(sum(v * v)) as n from s group by doc_id), zq as (select sqrt(sum(v * v)) as n from q)
select 'raw:' || doc_id as id, round(sum(s.v * q.v) / (z.n * zq.n), 9) as score
from s join q using (i) join z using (doc_id), zq where z.n > 0 group by doc_id, z.n, zq.n having sum(s.v * q.v) > 0
order by score desc, id limit 10""")
def hash_embedding_topk(spark, d):
    """Documents nearest to a phrase by hash embedding."""
    texts = tables.raw_records(spark, d).select("id", vectors.hashed(tx.tokens(F.col("content"))).alias("v"))
    asked = vx.literal(vectors.hash_embed(["the", "onthe", "thing", "of", "ha"]))
    scored = texts.select("id", F.round(vx.dot(F.col("v"), asked), 9).alias("score"))
    return lexical.top(scored.where(F.round("score", 9) > 0), 10).select("id", "score")
