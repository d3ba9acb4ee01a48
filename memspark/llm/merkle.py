"""Merkle manifest of a dataset: a tree a language, a tree of their roots above, and a proof for each document.

A level is one window: nodes are partitioned by group and parent, and the ordered list of a parent's children gives both
what the parent's digest is taken of and each child's siblings. The first child of each run stands for the parent in the
next level, so a level has an eighth of the rows of the one below. Paths are then handed down from the root, a join a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, materialize

ARITY = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """The value after its length in bytes, so that no two rows of fields read alike; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """did, doc_id, grp, leaf, tampered (null but where crc32 of the id is divisible by 3): one narrow row a document.

    grp is "-" for a null language and "v" with the language otherwise, which sorts null first and the rest by bytes."""
    fields = [framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        id_key().alias("did"),
        "doc_id",
        F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("-")).alias("grp"),
        digest(*fields, framed(F.col("text"))).alias("leaf"),
        F.when(altered, digest(*fields, framed(F.translate("text", UPPER, LOWER)))).alias("tampered"),
    )


def ranked(rows: DataFrame, group: str, by: list[str], broadcast_rows: int = 100_000) -> DataFrame:
    """rows with i, the place (from 0) in its group in the order of `by`, and n, the rows of the group.

    Rows are range-partitioned by group and order, so a group of any size spreads over many partitions; what each
    partition holds of a group is counted, and places follow from the counts before. Nothing is sorted twice and no
    group meets in one task."""
    slim = materialize(rows, "ranked-rows")  # range partitioning samples its input before it reads it
    spread = slim.repartitionByRange(group, *by).sortWithinPartitions(group, *by)
    placed = materialize(spread.withColumn("__ms_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__ms_part", F.shiftright("__ms_at", 33))
    held = placed.groupBy(group, "__ms_part").agg(F.min("__ms_at").alias("__ms_first"), F.count(F.lit(1)).alias("__ms_n"))
    own = Window.partitionBy(group)  # a row a partition that holds some of the group
    before = F.sum("__ms_n").over(own.orderBy("__ms_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select(
        group, "__ms_part", (F.coalesce(before, F.lit(0)) - F.col("__ms_first")).alias("__ms_shift"), F.sum("__ms_n").over(own).alias("n")
    )
    starts = materialize(starts, "ranked-starts")
    if starts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        starts = F.broadcast(starts)
    return placed.join(starts, [group, "__ms_part"]).withColumn("i", F.col("__ms_at") + F.col("__ms_shift")).drop("__ms_at", "__ms_part", "__ms_shift")


def siblings(nodes: DataFrame) -> DataFrame:
    """nodes (grp, i, n, h, ...) with p (the parent's place), before and after (the digests of the run's others, to the
    left and to the right) and run (all of them)."""
    nodes = nodes.withColumn("p", F.floor(F.col("i") / ARITY).cast("long"))
    whole = Window.partitionBy("grp", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run, at = F.collect_list("h").over(whole), (F.col("i") % ARITY).cast("int")
    return nodes.withColumn("run", run).withColumns({
        "before": F.array_join(F.slice("run", F.lit(1), at), ""),
        "after": F.array_join(F.slice("run", at + 2, F.lit(ARITY)), ""),
    })


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of nodes with siblings: one row a run, that of its first child."""
    return nodes.where(F.col("i") % ARITY == 0).select(
        "grp", F.col("p").alias("i"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("h")
    )


def levels(bottom: DataFrame, name: str) -> list[DataFrame]:
    """Levels above bottom (grp, i, n, h), each with siblings where its group goes on; groups of one node end there."""
    most = bottom.agg(F.max("n")).first()[0] or 0
    out, below = [], siblings(bottom.where("n > 1"))
    while most > 1:
        most = -(-most // ARITY)
        above = parents(below)
        both = siblings(above.where("n > 1")).select("grp", "i", "n", "h", "p", "before", "after", "run")
        alone = above.where("n = 1").selectExpr("grp", "i", "n", "h", "0L as p", "'' as before", "'' as after", "array() as run")
        below = materialize(both.unionByName(alone), name)
        out.append(below)
        below = below.where("n > 1")
    return out


def tops(bottom: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(grp, h): the last node of each group's tree."""
    out = bottom.where("n = 1").select("grp", "h")
    for level in above:
        out = out.unionByName(level.where("n = 1").select("grp", "h"))
    return out


def handed_down(top: DataFrame, above: list[DataFrame], carried: list[str], name: str) -> DataFrame:
    """(grp, i, path, *carried) of the lowest of the levels `above`: a node's path is its siblings, then its parent's path,
    and that of a group's last node is top's (grp, path, *carried). With no levels there are no rows."""
    columns, paths = ["grp", "i", "path", *carried], None
    for level in reversed(above):
        ended = level.where("n = 1").select("grp", "i").join(top, "grp").select(columns)
        if paths is not None:
            up = paths.withColumnRenamed("i", "p")
            own = F.array(F.struct("before", "after")).cast(PATH)
            on = level.where("n > 1").select("grp", "i", "p", "before", "after").join(up, ["grp", "p"])
            ended = ended.unionByName(on.withColumn("path", F.concat(own, F.col("path"))).select(columns))
        paths = materialize(ended, name)
    return paths


def proven(bottom: DataFrame, top: DataFrame, above: list[DataFrame], carried: list[str], name: str) -> DataFrame:
    """bottom (grp, i, n, h, ...) with path and what top carries."""
    alone = bottom.where("n = 1").join(top, "grp")
    paths = handed_down(top, above, carried, name)
    if paths is None:
        return alone.select(*bottom.columns, "path", *carried)
    own = F.array(F.struct("before", "after")).cast(PATH)
    on = siblings(bottom.where("n > 1")).join(paths.withColumnRenamed("i", "p"), ["grp", "p"])
    on = on.withColumn("path", F.concat(own, F.col("path")))
    columns = [*bottom.columns, "path", *carried]
    return alone.select(columns).unionByName(on.select(columns))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """A proof a document: doc_id, leaf, subroot (of its language), root, proof_sha256, folded_root, verified, and n_levels,
    the length of its path.

    Leaves are digests of doc_id, source, lang, n_chars and text, framed by their lengths, so null and empty differ.
    Within a language they ascend by doc_id, null ids last, and rows of one id by their digests; repeated rows are leaves
    of their own. Runs of eight give parents until one node is left; a language of one document has its leaf as its
    subroot. Null languages come first. Documents whose id's crc32 three divides are read as altered (A-Z lower-cased;
    a null id or text stays as it is), and verified says whether what was read still leads to the root. An empty table
    gives no rows; other columns are not read.
    """
    placed = ranked(leaves(docs), "grp", ["did", "leaf"])
    bottom = materialize(placed.withColumnRenamed("leaf", "h").select("grp", "i", "n", "h", "doc_id", "tampered"), "leaves")
    above = levels(bottom.select("grp", "i", "n", "h"), "level")
    subroots = tops(bottom, above).select(F.lit("").alias("all"), F.col("grp").alias("lang"), "h")
    heads = materialize(ranked(subroots, "all", ["lang"]).select(F.col("all").alias("grp"), "i", "n", "h", "lang"), "subroots")
    over = levels(heads.select("grp", "i", "n", "h"), "over")
    root = tops(heads, over).select("grp", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    by_lang = proven(heads, root, over, ["root"], "over-paths").select(F.col("lang").alias("grp"), F.col("h").alias("subroot"), "path", "root")
    by_lang = materialize(by_lang, "lang-paths")
    found = proven(bottom, by_lang, above, ["subroot", "root"], "paths")
    path = F.col("path")
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "h"), path))
    return found.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        F.size(path).alias("n_levels"),
    )
