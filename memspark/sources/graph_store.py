"""A store of records with the graph they project to, kept up by changes alone; whole ingests and what they owe an index.

Everything a change writes becomes current in one rename (see generations): records, edges, links, terms, tallies of nodes,
documents and the intents to index what has changed. An index is another store; intents are taken off after it has followed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.operators import projection as pj
from memspark.scratch import materialize, sent

from .generations import Generations

#: Table, and the column it is dealt by. Rows of the first four belong to the record that is their source.
OWNED = {"edges": "source", "links": "source", "terms": "source", "mentions": "source"}
SCHEMAS = {
    "records": pj.RECORD,
    "edges": "source string, id string, src string, predicate string, dst string, edge_kind string, ns string, scope string, status string, confidence double, "
    "valid_from string, valid_to string, created_at string, updated_at string, expired_at string, agent string",
    "links": "node string, episode string, source string",
    "terms": "node string, term string, term_kind string, ns string, scope string, source string",
    "mentions": "node string, kind string, label string, synthetic boolean, source string",
    "wants": "ref string, source string",
    "tallies": "node string, kind string, label string, synthetic boolean, n long",
    "documents": "document string, ns string, scope string, source_ref string, source_hash string, place string, deleted_at string, created_at string, updated_at string",
    "members": "document string, id string",
    "outbox": "id string, document string, generation long",
}


def read(store: Generations, name: str, buckets: list[int] | None = None) -> DataFrame:
    return store.read(name, buckets, SCHEMAS[name])


def columns(name: str) -> list[str]:
    return T.StructType.fromDDL(SCHEMAS[name]).names


def nodes(store: Generations) -> DataFrame:
    return pj.nodes(read(store, "tallies"))


def of(store: Generations, name: str, ids: DataFrame, key: str) -> DataFrame:
    """A table's rows with one of ids (one column), from the buckets that these lie in alone."""
    there = store.counted(ids)
    rows = read(store, name, list(there))
    return rows.join(sent(ids.toDF(key).distinct(), sum(there.values())), key, "left_semi").select(*columns(name))


def staged(store: Generations, changed: DataFrame, removed: DataFrame | None = None) -> tuple[dict, dict]:
    """What a change of records (whole new rows, one an id) and removals (id) makes of the store's tables, written but not
    current: tables of which some buckets are replaced, and tables that grow.

    Read and written are the buckets of the records that changed or named what changed; tallies and wants only grow."""
    changed = materialize(changed.select(*columns("records")), "changed")
    gone = changed.select("id") if removed is None else materialize(changed.select("id").unionByName(removed.select("id")).distinct(), "gone")
    within = store.counted(gone)
    left = sent(gone, sum(within.values()))
    old = materialize(of(store, "records", gone, "id"), "old")
    before, after = (pj.gist(x).withColumn("g", F.struct("ref_kind", "ref_label", "raw")).select("ref", "g") for x in (old, changed))
    altered = before.join(after.withColumnRenamed("g", "h"), "ref", "full_outer").where(~F.col("g").eqNullSafe(F.col("h"))).select("ref")
    followers = of(store, "wants", materialize(altered, "altered"), "ref").select(F.col("source").alias("id")).distinct().join(left, "id", "left_anti")
    followers = materialize(of(store, "records", materialize(followers, "followers"), "id"), "following")
    todo = changed.unionByName(followers)  # both written
    sources = materialize(gone.unionByName(followers.select("id")), "sources")
    touched = store.counted(sources)
    buckets, own = list(touched), sent(sources.toDF("source"), sum(touched.values()))

    def gist_of(refs: DataFrame) -> DataFrame:
        there = of(store, "records", refs, "id").join(left, "id", "left_anti")
        new = changed.join(sent(refs.toDF("id"), refs.count()), "id", "left_semi")
        return pj.gist(there.unionByName(new))

    named = materialize(pj.references(todo), "named")
    values = materialize(named.select("value").distinct(), "values")
    direct = materialize(gist_of(values), "known")
    further = direct.where("raw is not null").select("raw").join(sent(values.toDF("raw"), values.count()), "raw", "left_anti").distinct()
    known = materialize(direct.unionByName(gist_of(materialize(further, "further"))), "known")

    new = pj.project(todo, named, known)
    replaced, was = {}, None
    for name, key in OWNED.items():
        held = read(store, name, buckets)
        mine = getattr(new, name).select(*held.columns)
        if name == "mentions":
            mine = materialize(mine, "mentions")
            was = pj.tally(held.join(own, "source", "left_semi")).withColumn("n", -F.col("n"))
            added = pj.tally(mine).unionByName(was).groupBy("node", "kind", "label", "synthetic").agg(F.sum("n").alias("n")).where("n != 0")
        replaced[name] = (store.stage(name, held.join(own, "source", "left_anti").select(*held.columns).unionByName(mine), key), buckets)
    kept = read(store, "records", list(within)).join(left, "id", "left_anti").select(*changed.columns)
    replaced["records"] = (store.stage("records", kept.unionByName(changed), "id"), list(within))
    return replaced, {"tallies": store.stage("tallies", added, "node"), "wants": store.stage("wants", new.wants, "ref")}


def reproject(store: Generations, changed: DataFrame, removed: DataFrame | None = None) -> int:
    """Write a change of records and bring the graph up to date, at once; returns the new generation."""
    base = store.latest()
    return store.commit(base, *staged(store, changed, removed))


def rebuild(store: Generations) -> int:
    """Project all records from nothing: what any row of changes must come to."""
    base = store.latest()
    records = read(store, "records")
    new = pj.project(records, materialize(pj.references(records), "named"), materialize(pj.gist(records), "known"))
    tables = {name: (store.stage(name, getattr(new, name).select(*columns(name)), key), None) for name, key in OWNED.items()}
    tables["tallies"] = (store.stage("tallies", pj.tally(new.mentions), "node"), None)
    tables["wants"] = (store.stage("wants", new.wants, "ref"), None)
    return store.commit(base, tables)


def ingest(store: Generations, documents: DataFrame, records: DataFrame, now: str, at: Callable[[str], None] = lambda step: None) -> int:
    """Take in documents(document, ns, scope, source_ref, source_hash) with their records, whole or not at all.

    A document takes the place of the others of its source in its boundary: these are marked as deleted, and their records as
    superseded unless the new records name them or are them. Superseded records keep their edges, which end now. Each
    record that came or was superseded is owed to the index. The same documents and hashes again change nothing. Two
    documents of one source in a batch are refused, as no order says which is the last. `at` is called before each step."""
    base = store.latest()
    place = F.concat_ws("\x1f", "ns", "scope", "source_ref")
    documents = materialize(documents.select("document", "ns", "scope", "source_ref", "source_hash", place.alias("place")), "documents")
    if not documents.groupBy("place").count().where("count > 1").isEmpty():
        raise ValueError("two documents of one source")
    held = materialize(of(store, "documents", documents.select("place"), "place"), "held")
    current = held.where("deleted_at is null").select("document", "source_hash")
    if documents.join(current, ["document", "source_hash"], "left_anti").isEmpty():
        return base
    at("canonical records")
    old = held.alias("o").join(documents.select("place", F.col("document").alias("now")), "place").where("document != now and deleted_at is null").select("document")
    old = materialize(old, "old-documents")
    protected = pj.references(records).select(F.col("value").alias("id")).unionByName(records.select("id")).distinct()
    ids = of(store, "members", old, "document").select("id").join(protected, "id", "left_anti").distinct()
    retired = of(store, "records", materialize(ids, "retired"), "id").withColumns({"status": F.lit("superseded"), "updated_at": F.lit(now)})
    retired = materialize(retired, "superseded")
    at("supersession")
    replaced, added = staged(store, records.unionByName(retired.select(*records.columns)))
    at("document status")
    touched = store.touched(documents.select("place"))
    rows = documents.join(held.select("document", F.col("created_at").alias("was")), "document", "left")
    rows = rows.withColumns({"deleted_at": F.lit(None).cast("string"), "created_at": F.coalesce("was", F.lit(now)), "updated_at": F.lit(now)})
    names = columns("documents")
    kept = read(store, "documents", touched).join(documents.select("document"), "document", "left_anti")
    kept = kept.join(old.select("document", F.lit(now).alias("__end")), "document", "left")
    kept = kept.withColumns({"deleted_at": F.coalesce("deleted_at", "__end"), "updated_at": F.coalesce("__end", "updated_at")})
    replaced["documents"] = (store.stage("documents", kept.select(names).unionByName(rows.select(names)), "place"), touched)
    added["members"] = store.stage("members", records.where("document is not null").select("document", "id"), "document")
    at("intents")
    owed = records.select("id", "document").unionByName(retired.select("id", "document")).withColumn("generation", F.lit(base + 1).cast("long"))
    added["outbox"] = store.stage("outbox", owed, "id")
    at("commit")
    return store.commit(base, replaced, added)


def pending(store: Generations) -> DataFrame:
    """Records that the index still has to follow: id, and the last generation that owes it."""
    return read(store, "outbox").groupBy("id").agg(F.max("generation").alias("generation"))


def replay(store: Generations, index: Generations, embed: Callable[[DataFrame], DataFrame], at: Callable[[str], None] = lambda step: None) -> int:
    """Bring the index up to date with what is owed, then take it off; returns the index's generation.

    embed: records to (id, source_hash, embedding). What is owed is looked up as it is now: records that are current and whose
    hash the index lacks are embedded, others leave it. So a replay after a crash, or twice, changes nothing more. Intents that
    came meanwhile stay owed."""
    base, upto = index.latest(), store.latest()
    owed = materialize(pending(store), "owed")
    if owed.isEmpty():
        return base
    rows = of(store, "records", owed.select("id"), "id").where(~F.col("status").isin(*pj.EXCLUDED))
    made = materialize(embed(rows).select("id", "source_hash", "embedding"), "embedded")
    there = index.read("vectors", index.touched(owed.select("id")), made.schema)
    due = made.join(there.select("id", "source_hash"), ["id", "source_hash"], "left_anti").select(*made.columns)
    stale = there.join(owed.select("id"), "id", "left_semi").join(made, ["id", "source_hash"], "left_anti")
    at("index")
    done = base
    if not due.isEmpty() or not stale.isEmpty():
        kept = there.join(due.select("id").unionByName(stale.select("id")).distinct(), "id", "left_anti").select(*made.columns)
        done = index.commit(base, {"vectors": (index.stage("vectors", kept.unionByName(due), "id"), index.touched(owed.select("id")))})
    at("acknowledge")
    left = read(store, "outbox").where(F.col("generation") > upto)
    store.commit(store.latest(), {"outbox": (store.stage("outbox", left, "id"), None)})
    return done
