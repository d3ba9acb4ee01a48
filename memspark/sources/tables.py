"""Star-schema and text tables as the engine's stores: records, nodes, edges, vectors, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as RAW records."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        tagged("raw", "doc_id").alias("id"), F.lit("RAW").alias("kind"), F.col("lang").alias("ns"), F.lit("project").alias("scope"),
        F.lit("asserted").alias("status"), F.lit(1.0).alias("conf"), F.col("source").alias("source_ref"), F.col("text").alias("content"), "doc_id",
    )


def claim_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as claims of a customer; the order's status is the claim's lifecycle."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "asserted").when(F.col("o_orderstatus") == "O", "observed").otherwise("superseded")
    return o.select(
        tagged("clm", "o_orderkey").alias("id"), F.lit("CLM").alias("kind"), F.lit("local.default").alias("ns"), F.lit("project").alias("scope"),
        status.alias("status"), F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 500000), 6).alias("conf"),
        tagged("cust", "o_custkey").alias("subject"), F.lower("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"),
        F.col("o_orderdate").alias("t0"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as EVT records."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "contradicted").otherwise("observed")
    return e.select(
        tagged("evt", "event_id").alias("id"), F.lit("EVT").alias("kind"), F.lit("local.default").alias("ns"), F.lit("user").alias("scope"),
        status.alias("status"), F.lit(1.0).alias("conf"), tagged("user", "user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("t0"), "value", "props", "event_id",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as entities (id, entity_type, label)."""
    made = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    out = None
    for name, key, label in made:
        one = table(spark, sf_dir, name).select(tagged(name, key).alias("id"), F.lit(name).alias("entity_type"), F.col(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """located_in edges: customers and suppliers in nations, nations in regions."""
    made = [("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey")]
    out = None
    for name, key, above, ref in made:
        one = table(spark, sf_dir, name).select(tagged(name, key).alias("src"), F.lit("located_in").alias("predicate"), tagged(above, ref).alias("dst"))
        out = one if out is None else out.unionByName(one)
    return out


LINES = 500_000  # of a task that groups line items


def dealt_lines(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Line items dealt by keys to as many tasks as they need."""
    line = table(spark, sf_dir, "lineitem")
    return line.repartition(max(1, -(-line.count() // LINES)), *keys)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplies edges: supplier to part, from its first to its last shipment, as sure as its least discount is low."""
    return (  # pairs hardly repeat, so groups are held where their rows meet, and by few rows a task
        dealt_lines(spark, sf_dir, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey")
        .agg(F.min("l_shipdate").alias("t0"), F.max("l_shipdate").alias("t1"), F.round(1 - F.min("l_discount"), 6).alias("confidence"), F.count(F.lit(1)).alias("shipments"))
        .select(tagged("supplier", "l_suppkey").alias("src"), F.lit("supplies").alias("predicate"), tagged("part", "l_partkey").alias("dst"), "t0", "t1", "confidence", "shipments")
    )


def supply_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): suppliers and parts of any supply, each once; the pairs are not made."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(tagged("supplier", "l_suppkey").alias("id")).distinct().unionByName(line.select(tagged("part", "l_partkey").alias("id")).distinct())


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as ordered turns (run, seq, agent, text)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("role").alias("agent"), "text")
