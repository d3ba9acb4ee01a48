"""Walks under budgets, by hand."""

from pyspark.sql import functions as F

from memspark.operators import traversal as tv


def table(spark, edges):
    return spark.createDataFrame([(f"e{i:05d}", a, "knows", b, f"rel{i:05d}") for i, (a, b) in enumerate(edges)], "id string, src string, predicate string, dst string, source string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_hops_paths_and_records(spark):
    found = {r.id: r for r in tv.traverse(spark, table(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "a"), ("x", "y")]), ids(spark, "a"), ids(spark), 2, 5).collect()}
    assert {i: r.hop for i, r in found.items()} == {"a": 0, "b": 1, "d": 1, "c": 2, "rel00000": 1, "rel00003": 1, "rel00001": 2, "rel00002": 2}
    assert [p.edge for p in found["c"].path] == ["e00000", "e00001"]  # b comes before d
    assert [p.edge for p in found["rel00002"].path] == ["e00003", "e00002"] and found["a"].path == []
    assert found["c"].neighbours == 2 and found["rel00000"].attributed and not found["b"].attributed
    assert found["a"].lexical_seed and not found["a"].semantic_seed


def test_places_are_kept_for_semantic_seeds(spark):
    lexical, semantic = ids(spark, *[f"l{i:03d}" for i in range(400)]), ids(spark, *[f"s{i:03d}" for i in range(90)])
    relations = table(spark, [("z", "y")])
    for asked, room in ((13, 250), (2, 50)):
        found = tv.traverse(spark, relations, lexical, semantic, 1, asked).collect()
        assert sum(r.lexical_seed for r in found) == room and sum(r.semantic_seed for r in found) == min(90, tv.SEEDS - room)
    assert sum(r.lexical_seed for r in tv.traverse(spark, relations, lexical, ids(spark), 1, 13).collect()) == 250


def test_a_hub_is_cut_to_the_budgets(spark):
    """A hub of 3 000 neighbours: edges by id up to the budget, nodes and their records up to 500 in all."""
    relations = table(spark, [("hub", f"n{i:04d}") for i in range(3000)])
    found = tv.traverse(spark, relations, ids(spark, "hub"), ids(spark), 3, 20).collect()
    nodes, edges = tv.budgets(1, 20)
    assert (nodes, edges) == (500, 4000)
    assert sum(not r.attributed for r in found) == 250 and sum(r.attributed for r in found) == 249 == len(found) - 250
    assert {r.id for r in found if not r.attributed} == {"hub", *(f"n{i:04d}" for i in range(249))}
    small = tv.traverse(spark, relations, ids(spark, "hub"), ids(spark), 3, 1).collect()
    assert sum(not r.attributed for r in small) == 64 and max(r.neighbours for r in small) == 512  # edges looked at


def test_places_left_go_to_records_between_reached_nodes(spark):
    relations = table(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c")])
    found = {r.id: r for r in tv.traverse(spark, relations, ids(spark, "a"), ids(spark, "b"), 1, 5, ids(spark, "rel00002")).collect()}
    assert set(found) == {"a", "b", "c", "rel00000", "rel00001", "rel00002", "rel00003"}
    assert found["rel00002"].semantic_seed and not found["rel00001"].semantic_seed
    records = spark.createDataFrame([("a", "ENT", 0.5), ("rel00002", "REL", 0.0), ("c", "RAW", 0.0), ("zz", "ENT", 1.0)], "id string, kind string, lex double")
    hits = {r.id: round(r.score, 6) for r in tv.hits(tv.traverse(spark, relations, ids(spark, "a"), ids(spark, "b"), 1, 5, ids(spark, "rel00002")), records, records["lex"]).collect()}
    assert hits == {"a": 1.1, "rel00002": 0.35}
    assert tv.traverse(spark, relations, ids(spark), ids(spark), 3, 5).collect() == []


def test_stores_of_relations_are_written_once_and_seeds_are_sent_to_them(spark, data):
    from memspark.catalogue import traversal as ct
    from memspark.operators import grounding as gr

    stores = ct._stores(spark, data)
    for rows in (stores.relations, stores.records, stores.grounding):
        assert not [f for f in rows.inputFiles() if "lineitem" in f]
    ends = stores.relations.select(F.col("source").alias("id"), "src", "dst")
    seeds = spark.createDataFrame([("rel:customer:1>nation:3",), ("supplier:1",)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = gr.ground_seeds(seeds, stores.entities, stores.records, stores.grounding, ends, 50)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    assert "supplier:1" in {r.id for r in found.collect()}
