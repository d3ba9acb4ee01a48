"""Streams drained in steps give what a batch gives, and a batch that comes again changes nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memspark.streaming import events as st

SCHEMA = "run int, event_id int, kind string, at timestamp"
KINDS = ("view", "purchase", "error", "view", "view", "error", "purchase", "view")


def rows(first, last):
    start = datetime(2024, 1, 1)
    return [(i % 3, i, KINDS[i % 8], start + timedelta(hours=i)) for i in range(first, last)]


def test_status_over_several_drains(spark, tmp_path):
    log, state = f"{tmp_path}/log", f"{tmp_path}/state"
    for first, last in ((0, 10), (10, 17), (17, 40)):
        spark.createDataFrame(rows(first, last), SCHEMA).coalesce(1).write.mode("append").parquet(log)
        stream = st.run_status(st.read_log(spark, log, "*.parquet", SCHEMA, files_per_batch=1), ("purchase",), ("error",))
        st.drain(stream, st.upserting(state, "run"), f"{tmp_path}/checkpoint", mode="update")
        whole = st.run_status(spark.createDataFrame(rows(0, last), SCHEMA), ("purchase",), ("error",))
        assert sorted(map(tuple, st.latest(spark, state, "run").select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = st.upserting(f"{tmp_path}/s", "run")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "run int, status string")
    two = spark.createDataFrame([(1, "c")], "run int, status string")
    for batch, number in ((one, 0), (two, 1), (one, 0), (two, 1)):
        write(batch, number)
    assert sorted(map(tuple, st.latest(spark, f"{tmp_path}/s", "run").collect())) == [(1, "c"), (2, "b")]


def test_windows_count_events(spark, tmp_path):
    spark.createDataFrame(rows(0, 40), SCHEMA).write.parquet(f"{tmp_path}/log")
    found = []
    counted = st.windowed_counts(st.read_log(spark, f"{tmp_path}/log", "*.parquet", SCHEMA))
    st.drain(counted, lambda b, _: found.extend(b.select(F.col("window.start").alias("s"), "kind", "n").collect()), f"{tmp_path}/c", mode="update")
    assert sum(r.n for r in found) == 40
