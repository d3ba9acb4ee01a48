"""Queries with SQL against DuckDB, and the pipeline against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from memspark.llm import weak_rules
from memspark.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import hits_of, lines_of, near_of

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = QUERIES[name](spark, data)
    result = con.sql(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(result.fetchall())


def test_pipeline_as_brute_force(spark, data):
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string")
    kept = {r.doc_id for r in weak_rules.judge(table).where("kept").collect()}
    rows = [(i, t) for i, t in rows if i in kept]
    docs = corpus_pipeline.quality_rules(spark, table, data)
    assert docs.columns == table.columns and {r.doc_id for r in docs.collect()} == kept
    docs = corpus_pipeline.materialize(corpus_pipeline.line_dedup_stage(spark, docs, data), "t")
    digests = {i: (n, d, h) for i, n, d, h in lines_of(rows)}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(hashlib.sha256(t.encode()).hexdigest() == digests[i][2] for i, t in rows)
    assert {i for i, t in rows} >= {i for i, (_, dropped, _) in digests.items() if not dropped}
    assert all(len(t.split()) >= 50 or not digests[i][1] for i, t in rows)  # what loses lines is held to the base rule again
    docs = corpus_pipeline.materialize(corpus_pipeline.ngram_join_stage(spark, docs, data), "t")
    least = {i for i, c, _ in near_of(rows) if i == c}
    assert {r.doc_id for r in docs.collect()} == least
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {r[0] for r in hits_of([(i, t) for i, t in rows if i in least], items) if not r[5]}
    docs = corpus_pipeline.materialize(corpus_pipeline.decontamination(spark, docs, data), "t")
    assert {r.doc_id for r in docs.collect()} == clean
    packed = corpus_pipeline.best_fit_packing(spark, docs, data).collect()
    assert {r.doc_id for r in packed} == clean
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)
    assert min(r.length for r in packed if not r.piece) > 50
    whole = corpus_pipeline.run(spark, data)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert Counter((r.doc_id, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.ids_crc32) for r in packed)


def test_pipeline_on_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, documents that lose all their lines, and no documents."""
    import random

    from .test_operators import LONG

    draw = random.Random(3)
    line = lambda: " ".join("".join(draw.choices("aeioulnrst", k=draw.randint(3, 8))) for _ in range(12)).capitalize() + "."
    lines = [[line() for _ in range(8)] for _ in range(6)]
    a, b, c, d, e, f = ("\n".join(x) for x in lines)
    mixed = "\n".join([*lines[0][:4], *lines[1][:4]])
    short = "\n".join([*lines[0][:7], "Only this line is its own."])
    rows = [(1, a), (2, b), (3, a), (4, mixed), (5, short), (6, None), (7, ""), (None, c), (None, d), (None, None), (9, e), (9, e), (8, f), (10, LONG)]
    (tmp_path / "d").mkdir()
    for name, table in (("some", rows), ("none", [])):
        base = f"{tmp_path}/{name}"
        spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(1, "no words of it are there at all or so it seems to me"), (None, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        found = [r.doc_id for r in corpus_pipeline.run(spark, base).collect()]
        if not table:
            assert found == []
            continue
        long_kept = 10 in found
        assert Counter(i for i in found if i != 10) == Counter({1: 1, 2: 1, None: 2, 9: 1, 8: 1}), found
        assert not long_kept  # it says the same few words over and over: the base rule
