"""Record stores: verification, upserts, coreference, symbols, chunks and inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds and the attributes that each requires.
REQUIRED = {
    "RAW": ("content",), "SPAN": ("raw_id", "start", "end"), "ENT": ("entity_type", "label"), "CLM": ("subject", "predicate", "object"),
    "EVT": ("actor", "action"), "REL": ("src", "predicate", "dst"), "STA": ("target", "fields"), "SYM": ("symbol", "expansion"),
    "PACK": ("mode", "refs", "payload"), "FLOW": ("op",), "PROV": ("entity",), "META": ("schema",),
}
SCOPES = ("global", "org", "project", "user", "thread", "ephemeral")
STATUSES = ("asserted", "observed", "inferred", "hypothetical", "contradicted", "superseded", "deprecated", "deleted_soft")


def issues(records: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(record_id, code) of records(id, kind, ns, scope, status, conf, attrs map) and references(id, ref, role)."""
    codes = [
        F.when(F.trim(F.coalesce("id", F.lit(""))) == "", "invalid_record_id"),
        F.when(~F.col("ns").rlike("^[A-Za-z0-9_.:-]+$"), "invalid_namespace"),
        F.when(~F.col("scope").isin(*SCOPES), "invalid_scope"),
        F.when(~F.col("conf").between(0, 1), "invalid_confidence"),
        F.when(~F.col("status").isin(*STATUSES), "invalid_status"),
    ]
    for kind, names in REQUIRED.items():
        for name in names:
            missing = F.coalesce(F.col("attrs")[name], F.lit("")) == ""
            codes.append(F.when((F.col("kind") == kind) & missing, f"missing_{name}"))
    own = records.select(F.col("id").alias("record_id"), F.explode(F.array_compact(F.array(*codes))).alias("code"))
    twice = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("record_id"), F.lit("duplicate_id").alias("code"))
    out = own.unionByName(twice)
    if references is None:
        return out
    known = records.select(F.col("id").alias("ref"), F.col("kind").alias("ref_kind")).dropDuplicates(["ref"])
    joined = references.join(known, "ref", "left")
    wrong = (
        F.when(F.col("ref_kind").isNull(), F.when(F.col("role") == "prov", "missing_provenance").otherwise("missing_evidence"))
        .when((F.col("role") == "prov") & (F.col("ref_kind") != "PROV"), "invalid_provenance")
        .when((F.col("role") == "evidence") & ~F.col("ref_kind").isin("SPAN", "RAW"), "invalid_evidence")
    )
    return out.unionByName(joined.select(F.col("id").alias("record_id"), wrong.alias("code")).where("code is not null"))


def upsert(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """stored with batch's rows in place of those with the same key. A key that the batch has twice, or whose kind
    would change, is an error."""
    if not batch.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("the batch has a key twice")
    if "kind" in batch.columns:
        changed = batch.select(key, F.col("kind").alias("k")).join(stored.select(key, "kind"), key).where("k != kind")
        if not changed.isEmpty():
            raise ValueError("a record's kind cannot change")
    return stored.join(batch.select(key), key, "left_anti").unionByName(batch)


def coreferent(entities: DataFrame) -> DataFrame:
    """(id, canonical): the first by created_at, then id, of the entities of a boundary with one identity."""
    by = ["ns", "scope", "identity"]
    first = entities.groupBy(*by).agg(F.min(F.struct("created_at", "id"))["id"].alias("canonical"))
    return entities.join(first, by).select("id", "canonical")


def remap(records: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """records whose reference columns follow mapping(id, canonical)."""
    for c in columns:
        m = mapping.select(F.col("id").alias(c), F.col("canonical").alias("__c"))
        records = records.join(m, c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
    return records


def owned_edges(edges: DataFrame) -> DataFrame:
    """One row a (src, type, dst), with its owners."""
    return edges.groupBy("src", "type", "dst").agg(F.array_sort(F.collect_set("owner")).alias("owners"))


def symbols(material: DataFrame, least: int = 2) -> DataFrame:
    """material(ns, expansion) to (ns, expansion, symbol, frequency, ambiguity): what occurs often enough, four
    characters or more; a symbol that n expansions share is ambiguous by (n - 1) / n."""
    long = material.where(F.length("expansion") >= 4)
    counts = long.groupBy("ns", "expansion").agg(F.count(F.lit(1)).alias("frequency")).withColumn("symbol", abbreviated(F.col("expansion")))
    shared = counts.groupBy("symbol").agg(F.count_distinct("expansion").alias("n"))
    joined = counts.join(shared, "symbol").where(F.col("frequency") >= least)
    return joined.select("ns", "expansion", "symbol", "frequency", F.round((F.col("n") - 1) / F.col("n"), 4).alias("ambiguity"))


def abbreviated(expansion: Column) -> Column:
    """Two letters of each part of a predicate, four at most."""
    parts = F.filter(F.split(F.lower(expansion), "[_ ]"), lambda p: p != "")
    return F.substring(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 2)), ""), 1, 4)


def chunks(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """Distinct lines of docs(id, content), with where each occurs first and how often."""
    lines = docs.select("id", F.posexplode(F.split("content", separator)).alias("pos", "chunk")).where("trim(chunk) != ''")
    return lines.groupBy(F.md5("chunk").alias("chunk_id")).agg(F.min(F.struct("id", "pos")).alias("f"), F.count(F.lit(1)).alias("occurrences")).select(
        "chunk_id", F.col("f.id").alias("first_id"), F.col("f.pos").alias("first_pos"), "occurrences"
    )


def inverted(docs: DataFrame, tokens: Column) -> DataFrame:
    """token: in how many of docs(id) it occurs, and how often."""
    words = docs.select("id", F.explode(tokens).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min("id").alias("first_id"))


def numbered_view(turns: DataFrame) -> DataFrame:
    """Distinct lines of each run in the order of their first occurrence, numbered from 1: turns(run, seq, text)."""
    first = turns.groupBy("run", "text").agg(F.min("seq").alias("at"))
    return first.withColumn("line", F.row_number().over(Window.partitionBy("run").orderBy("at", "text")))
