"""Every query against its SQL in DuckDB, and those without SQL against small references."""

from collections import Counter

import pytest

from memspark.catalogue import collected

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLE = collected()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_as_sql(spark, data, con, name):
    found = QUERIES[name](spark, data)
    result = con.sql(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(repr, map(tuple, found.select(*[found[c] for c in columns]).collect()))) == Counter(map(repr, result.fetchall()))


def test_approximate_search_finds_most_of_the_exact(spark, data):
    from memspark.operators import vectors
    from memspark.sources import tables

    index = tables.table(spark, data, "embeddings").selectExpr("vec_id as id", "embedding").cache()
    buckets = vectors.bucketed(index, 64).cache()
    asked = [[float(x) for x in r.embedding] for r in index.where("id < 8").collect()]
    met = [len({r.id for r in vectors.approximate(buckets, q, 10).collect()} & {r.id for r in vectors.nearest(index, q, 10).collect()}) for q in asked]
    assert sum(met) >= 0.9 * 10 * len(asked)


def test_budgeted_traversal_takes_the_surest_edges(spark, data):
    from memspark.sources import tables

    edges = [(r.src, r.dst, r.confidence) for r in tables.supply_edges(spark, data).collect()]
    near = [(c, a, b) for s, t, c in edges for a, b in ((s, t), (t, s))]
    seen = {"supplier:1": 0, "supplier:2": 0}
    frontier = set(seen)
    for hop in (1, 2):
        met = sorted((-c, u, v) for c, u, v in near if u in frontier and v not in seen)[:64]
        frontier = {v for _, _, v in met}
        seen |= {v: hop for v in frontier}
    assert {r.id: r.hop for r in QUERIES["budgeted_traversal"](spark, data).collect()} == seen


def test_free_text_compiles_to_spans_that_cover_their_text(spark, data):
    from memspark.sources import free_text, tables

    rows = free_text.compiled(tables.raw_records(spark, data)).collect()
    raws = {r.document: r.text for r in rows if r.kind == "RAW"}
    spans = [r for r in rows if r.kind == "SPAN"]
    assert len(spans) >= len(raws) and all(raws[r.document][r.start : r.end] == r.text for r in spans)
    counts = {r.kind: r.n for r in QUERIES["compile_free_text"](spark, data).collect()}
    assert counts == Counter(r.kind for r in rows)


def test_mixed_and_temporal_retrieval_rank_within_their_budget(spark, data):
    for name in ("mixed_retrieval", "temporal_retrieval"):
        rows = QUERIES[name](spark, data).collect()
        assert 0 < len(rows) <= 10 and all(r.score >= 0 for r in rows)


def test_entry(spark, data, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "SMALLEST", data)
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
