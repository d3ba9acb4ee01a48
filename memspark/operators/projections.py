"""Records as text, labels, signals and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The attributes that a kind's label and signal are made of.
LABELS = {"ENT": ("label",), "CLM": ("subject", "predicate", "object"), "EVT": ("actor", "action"), "REL": ("src", "predicate", "dst"), "RAW": ("content",)}


def attribute(name: str, attrs: str = "attrs") -> Column:
    return F.col(attrs)[name]


def label(limit: int = 180, attrs: str = "attrs") -> Column:
    """A record's label by kind, at most `limit` characters; the id for kinds without one."""
    out = None
    for kind, names in LABELS.items():
        text = F.concat_ws(" ", *[attribute(n, attrs) for n in names])
        out = F.when(F.col("kind") == kind, text) if out is None else out.when(F.col("kind") == kind, text)
    return F.left(F.coalesce(F.nullif(F.trim(out), F.lit("")), F.col("id")), F.lit(limit))


def vector_text(attrs: str = "attrs") -> Column:
    """Text that a record is embedded by: a RAW's content, a label, or the kind and its attributes by sorted key."""
    entries = F.array_sort(F.map_entries(F.col(attrs)))
    rest = F.concat_ws(" ", F.col("kind"), F.array_join(F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: e["value"]), " "))
    return F.when(F.col("kind") == "RAW", attribute("content", attrs)).when(F.col("kind") == "ENT", attribute("label", attrs)).otherwise(rest)


def signal(attrs: str = "attrs") -> Column:
    """The part of a record that a pack carries, as JSON."""
    out = F.to_json(F.col(attrs))
    for kind in ("CLM", "EVT", "REL"):
        names = LABELS[kind] + (("object",) if kind == "EVT" else ())
        out = F.when(F.col("kind") == kind, F.to_json(F.struct(*[attribute(n, attrs).alias(n) for n in names]))).otherwise(out)
    return out


def summary(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def timeline(records: DataFrame, references: DataFrame) -> DataFrame:
    """records(id, t0, created_at) in order of time, each with its references(id, ref) that are records of the batch."""
    inside = references.join(records.select(F.col("id").alias("ref")), "ref", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))
    at = F.coalesce("t0", "created_at")
    return records.join(inside, "id", "left").select("id", at.alias("at"), F.coalesce("refs", F.lit("")).alias("refs"))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()])), ",")


def exact_pack(records: DataFrame, by: str) -> DataFrame:
    """All records of a pack by id, reversibly, with the pack's id from its members."""
    members = F.array_sort(F.collect_list(F.struct("id", "kind", "attrs_json")))
    refs = F.transform(F.col("m"), lambda x: x["id"])
    packed = records.groupBy(by).agg(members.alias("m"))
    name = F.concat(F.lit("pack:exact:"), F.size("m").cast("string"), F.lit(":"), F.left(F.sha2(F.concat(F.lit("exact||0|"), F.array_join(refs, ",")), 256), F.lit(12)))
    return packed.select(by, name.alias("pack_id"), F.size("m").alias("records"), F.to_json("m").alias("payload"))


def unpacked(packs: DataFrame) -> DataFrame:
    kind = "array<struct<id:string,kind:string,attrs_json:string>>"
    return packs.select(F.inline(F.from_json("payload", kind)))


def numbered(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def facets(events: DataFrame) -> DataFrame:
    """events(id, actor, action, t0, props JSON) with who, what, when and how; a facet that props names wins over the
    field that stands for it."""
    said = lambda name: F.get_json_object("props", f"$.{name}")
    return events.select(
        "id",
        F.coalesce(said("who"), "actor").alias("who"),
        F.coalesce(said("what"), "action").alias("what"),
        F.coalesce(said("when"), F.date_format("t0", "yyyy-MM-dd")).alias("when"),
        F.coalesce(said("how"), said("k")).alias("how"),
    )
