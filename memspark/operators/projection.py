"""Records as a graph: edges, episode links, terms and mentions of nodes, each owned by the record it comes from.

What a record projects depends on itself and on the records it names. So a change is projected anew for the changed records
and for those that named a record which came, went or changed its kind, label or source; everything else stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.scratch import materialize

from . import graph, projections

RECORD = (
    "id string, kind string, ns string, scope string, status string, conf double, t0 string, t1 string, created_at string, updated_at string, "
    "agent string, attrs map<string,string>, ext map<string,string>, prov array<string>, evidence array<string>, document string"
)

# Node kinds by record kind, statuses that are not current, the reconciliation fields, kinds that are their own
# episode, and the predicates that say where, how and with what result.
NODE_KINDS = {
    "RAW": "source", "SPAN": "evidence", "ENT": "entity", "CLM": "claim", "EVT": "event", "REL": "relation",
    "STA": "state", "SYM": "symbol", "PACK": "pack", "FLOW": "flow", "PROV": "provenance", "META": "metadata",
}
EXCLUDED = ("contradicted", "superseded", "deprecated", "deleted_soft")
RECONCILING = ("supports", "contradicts", "corrects", "supersedes", "refutes", "corroborates", "derived_from", "unverified_by")
DIRECT = ("CLM", "EVT", "REL", "STA", "FLOW", "META")
WHERE, HOW, RESULT = ("location", "located_in", "at"), ("via", "used_tool", "used_method", "method"), ("resulted_in", "leads_to", "causes")

ENDS = ("subject", "src"), ("object", "dst")


@dataclass
class Projection:
    """edges(id, src, predicate, dst, edge_kind, ns, scope, status, confidence, valid_from, valid_to, created_at, updated_at,
    expired_at, agent, source), links(node, episode, source), terms(node, term, term_kind, ns, scope, source),
    mentions(node, kind, label, synthetic, source), wants(ref, source)."""

    edges: DataFrame
    links: DataFrame
    terms: DataFrame
    mentions: DataFrame
    wants: DataFrame


def text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def attr(*names: str) -> Column:
    return F.coalesce(*[text(F.col("attrs")[n]) for n in names])


def value_node(ns: Column, scope: Column, value: Column) -> Column:
    return F.concat(F.lit("value:"), F.left(F.sha2(F.concat_ws("\x1f", ns, scope, F.lower(value)), 256), F.lit(20)))


def agent_node(agent: Column) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(agent, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""))
    return F.concat(F.lit("agent:"), F.coalesce(text(slug), F.lit("unknown")), F.lit(":"), F.left(F.sha2(agent, 256), F.lit(10)))


def episode_of(key: Column) -> Column:
    return F.concat(F.lit("episode:"), F.left(F.sha2(key, 256), F.lit(20)))


def facets() -> dict[str, Column]:
    """Who, what, when, where, why, how and then: what a record says under `facet.<name>`, else what its fields say."""
    predicate = F.lower(F.coalesce(attr("predicate", "action"), F.lit("")))
    family = graph.family(predicate)
    kind = F.col("kind")
    subject = F.when(kind == "EVT", attr("actor", "subject")).when(kind == "REL", attr("src")).when(kind == "STA", attr("target", "subject"))
    subject = subject.when(~kind.isin("EVT", "REL", "STA"), attr("subject", "actor", "src", "target"))
    obj = F.when(kind == "REL", attr("dst")).otherwise(attr("object"))
    given = lambda name, *rest: F.coalesce(attr(f"facet.{name}"), *rest)
    return {
        "who": given("who", subject),
        "what": given("what", obj),
        "when": given("when", attr("when", "timestamp", "ts"), text(F.col("t0"))),
        "where": given("where", attr("where", "location"), F.when(predicate.isin(*WHERE), obj)),
        "why": given("why", attr("why", "reason"), F.when((family == "causal") & ~predicate.isin(*RESULT), obj)),
        "how": given("how", attr("how", "method", "via"), F.when(predicate.isin(*HOW), obj)),
        "then": given("then", attr("then", "result", "outcome"), F.when((family == "causal") & predicate.isin(*RESULT) | (family == "temporal"), obj)),
    }


def references(records: DataFrame) -> DataFrame:
    """source, kind, ns, scope, role, value, required: a row for each thing that a record names, without blank ones."""
    kind = F.col("kind")
    listed = lambda role: F.transform(F.coalesce(F.col(role), F.array().cast("array<string>")), text).alias(role)
    needed = {
        "subject": F.when(kind == "CLM", attr("subject")),
        "src": F.when(kind.isin("REL", "FLOW"), attr("src")),
        "dst": F.when(kind.isin("REL", "FLOW"), attr("dst")),
        "actor": F.when(kind == "EVT", attr("actor", "subject")),
        "target": F.when(kind == "STA", attr("target", "subject")),
        "raw_id": F.when(kind == "SPAN", attr("raw_id")),
        "entity": F.when(kind == "PROV", attr("entity")),
        **{p: F.coalesce(text(F.col("ext")[p]), attr(p)) for p in RECONCILING},
    }
    free = {"object": F.when(kind.isin("CLM", "EVT"), attr("object")), **facets()}
    # Values become columns first: a generator works out anew all that its input mentions.
    rows = records.select(F.col("id").alias("source"), "kind", "ns", "scope", listed("prov"), listed("evidence"), *[v.alias(role) for role, v in (needed | free).items()])
    ref = lambda role, value, required: F.struct(F.lit(role).alias("role"), value.alias("value"), F.lit(required).alias("required"))
    own = [ref(role, F.col(role), role in needed) for role in needed | free]
    cited = lambda role: F.transform(role, lambda x: ref(role, x, True))
    rows = rows.select("source", "kind", "ns", "scope", F.inline(F.concat(F.array(*own), cited("prov"), cited("evidence"))))
    return rows.where(F.col("value").isNotNull())


def gist(records: DataFrame) -> DataFrame:
    """What others' projections see of a record: ref, ref_kind, ref_label, raw (the source it quotes)."""
    raw = F.when(F.col("kind") == "RAW", F.col("id")).when(F.col("kind") == "SPAN", attr("raw_id"))
    raw = raw.when((F.col("kind") == "PROV") & attr("entity").startswith("raw:"), attr("entity"))
    return records.select(F.col("id").alias("ref"), F.col("kind").alias("ref_kind"), projections.label().alias("ref_label"), raw.alias("raw"))


def wanted(named: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, source): the records that a projection of references looks at, there or not, sources of what is quoted included."""
    direct = named.select(F.col("value").alias("ref"), "source")
    quoted = direct.join(known.where("raw is not null").select("ref", "raw").hint("merge"), "ref").select(F.col("raw").alias("ref"), "source")
    return direct.unionByName(quoted).distinct()


def looked_up(named: DataFrame, known: DataFrame, often: int = 50_000) -> DataFrame:
    """named(value, ...) with what is known(value, ...) of each value. A value that more than `often` rows name, as a status is
    of a third of all claims, would be one task's; there are few of these, so what is known of them is sent to their rows."""
    common = F.broadcast(materialize(named.groupBy("value").count().where(F.col("count") > often).select("value"), "common"))
    rare = named.join(common, "value", "left_anti").join(known.hint("merge"), "value", "left")
    return rare.unionByName(named.join(common, "value", "left_semi").join(F.broadcast(known.join(common, "value", "left_semi")), "value", "left"))


def project(records: DataFrame, named: DataFrame, known: DataFrame) -> Projection:
    """The projection of records, given their references and the gist of all records that they look at (their own too, if
    they name each other); all three are read several times.

    A name that is a record's id is that record. Otherwise a required one is an unresolved reference, and any other a value,
    the same node for the same text but for case and white space in one boundary. Edges without two different ends are left out.

    All that is joined is as large as the change, so it is merged: left alone, Spark goes by the size of files, and ids compress so
    well that millions of rows would be gathered on the driver.
    """
    squashed = F.regexp_replace("value", r"\s+", " ")
    kinds = F.create_map(*[F.lit(x) for pair in NODE_KINDS.items() for x in pair])
    refs = looked_up(named, known.withColumnRenamed("ref", "value"))
    found = F.col("ref_kind").isNotNull()
    refs = refs.withColumns({
        "node": F.when(found | F.col("required"), F.col("value")).otherwise(value_node(F.col("ns"), F.col("scope"), squashed)),
        "node_kind": F.when(found, kinds[F.col("ref_kind")]).when(F.col("required"), "unresolved_reference").otherwise("value"),
        "node_label": F.when(found, F.col("ref_label")).when(F.col("required"), F.col("value")).otherwise(F.lower(squashed)),
    })
    refs = materialize(refs.select("source", "kind", "ns", "scope", "role", "value", "node", "node_kind", "node_label", "raw"), "refs")
    agents = records.where(text(F.col("agent")).isNotNull()).select(F.col("id").alias("source"), "ns", "scope", F.trim("agent").alias("name"))
    agents = agents.withColumn("node", agent_node(F.col("name")))

    facts = records.select(
        F.col("id").alias("source"), "ns", "scope", "status", F.col("conf").alias("confidence"), F.col("t0").alias("valid_from"), F.col("t1").alias("valid_to"),
        "created_at", "updated_at", F.when(F.col("status").isin(*EXCLUDED), F.col("updated_at")).alias("expired_at"), text(F.col("agent")).alias("agent"),
    )
    edges = materialize(ends_of(records, refs, agents).join(facts.hint("merge"), "source"), "edges")
    episodes = episodes_of(records, refs, known)
    nodes = refs.select("source", "node").unionByName(agents.select("source", "node")).unionByName(records.select(F.col("id").alias("source"), F.col("id").alias("node")))
    links = materialize(nodes.repartition("source").distinct().join(episodes.hint("merge"), "source").select("node", "episode", "source"), "links")

    told = refs.where(F.col("node_kind").isin("value", "unresolved_reference")).select("node", F.col("node_kind").alias("kind"), F.col("node_label").alias("label"), "source")
    told = told.unionByName(agents.select("node", F.lit("agent").alias("kind"), F.col("name").alias("label"), "source")).repartition("source").distinct()
    joined = edges.select("source", F.explode(F.array("src", "dst")).alias("node")).unionByName(links.select("source", "node")).repartition("source")
    synthetic = told.join(joined.hint("merge"), ["source", "node"], "left_semi").select("node", "kind", "label", F.lit(True).alias("synthetic"), "source")
    real = records.select(F.col("id").alias("node"), kinds[F.col("kind")].alias("kind"), projections.label().alias("label"), F.lit(False).alias("synthetic"), F.col("id").alias("source"))
    return Projection(edges, links, terms_of(records, refs, agents), real.unionByName(synthetic), wanted(named, known))


def ends_of(records: DataFrame, refs: DataFrame, agents: DataFrame) -> DataFrame:
    """source, id, src, predicate, dst, edge_kind of the edges that records make, each once."""
    role, kind = F.col("role"), F.col("kind")
    done = records.where("kind = 'PROV'").select(F.col("id").alias("source"), attr("activity").alias("activity"))
    done = done.join(agents.select("source", F.col("node").alias("by")).hint("merge"), "source", "left")
    entities = refs.where(role == "entity").join(done.hint("merge"), "source")  # only these look at more of their record
    nothing = F.lit(None).cast("string")
    one = refs.where(role != "entity").withColumns({"activity": nothing, "by": nothing}).unionByName(entities)
    predicate = (
        F.when(role.isin("prov", "evidence"), F.when(role == "prov", "provenance").otherwise("evidence"))
        .when(role == "subject", "about").when(role.isin("object", "dst"), "object").when(role == "src", "subject").when(role == "actor", "participated_in")
        .when(role == "target", "has_state").when(role == "raw_id", "excerpt_of").when(role == "entity", F.coalesce("activity", F.lit("produced"))).otherwise(role)
    )
    base = (
        F.when(role.isin("prov", "evidence", "raw_id", "entity"), "provenance")
        .when(role.isin("who", "what", "when", "where", "why", "how", "then"), "facet")
        .when(kind.isin("CLM", "REL") & role.isin("subject", "object", "src", "dst"), "grounding")
        .when(role.isin(*RECONCILING), graph.family(role)).otherwise("semantic")
    )
    into = role.isin("actor", "target")
    origin = F.when(role == "entity", F.coalesce("by", "source")).otherwise(F.col("source"))
    single = one.where(~((kind == "FLOW") & role.isin("src", "dst"))).select(
        "source", F.when(into, F.col("node")).otherwise(origin).alias("src"), predicate.alias("predicate"), F.when(into, F.col("source")).otherwise(F.col("node")).alias("dst"), base.alias("base")
    )
    pick = lambda names: F.max(F.when(role.isin(*names), F.col("node")))
    ends = refs.where(kind.isin("CLM", "REL", "FLOW") & role.isin(*ENDS[0], *ENDS[1]))
    pairs = ends.repartition("source").groupBy("source").agg(pick(ENDS[0]).alias("src"), pick(ENDS[1]).alias("dst"))
    named = F.coalesce(attr("predicate"), F.when(kind == "CLM", "asserts").when(kind == "REL", "related_to").otherwise("flows_to"))
    double = pairs.join(records.select(F.col("id").alias("source"), named.alias("predicate")).hint("merge"), "source").select("source", "src", "predicate", "dst", F.lit("semantic").alias("base"))
    by = agents.select("source", F.col("node").alias("src"), F.lit("contributed").alias("predicate"), F.col("source").alias("dst"), F.lit("provenance").alias("base"))
    rows = single.unionByName(double).unionByName(by).where("src is not null and dst is not null and src != dst")
    family = graph.family(F.col("predicate"))
    rows = rows.withColumn("edge_kind", F.when((F.col("base") == "semantic") & (family != "semantic"), family).otherwise(F.col("base")))
    named = F.concat(F.lit("kge:"), F.left(F.sha2(F.concat_ws("\x1f", "source", "src", "predicate", "dst", "edge_kind"), 256), F.lit(24)))
    # Edges hardly repeat, and only within a record: dealt once, by records, which they meet there too.
    rows = rows.select("source", "src", "predicate", "dst", "edge_kind").repartition("source").distinct()
    return rows.select("source", named.alias("id"), "src", "predicate", "dst", "edge_kind")


def episodes_of(records: DataFrame, refs: DataFrame, known: DataFrame) -> DataFrame:
    """(source, episode): the sources that a record quotes, itself or through what it cites, as far as there are records of
    them; a structured record with an agent and none is its own episode."""
    own = records.where("kind = 'RAW'").select(F.col("id").alias("source"), F.col("id").alias("raw"))
    cited = refs.where(F.col("role").isin("prov", "evidence") & F.col("raw").isNotNull()).select("source", "raw")
    spanned = refs.where("role = 'raw_id'").select("source", F.col("value").alias("raw"))
    there = known.select(F.col("ref").alias("raw"))
    quoted = own.unionByName(cited.unionByName(spanned).join(there.hint("merge"), "raw", "left_semi").select("source", "raw")).distinct()
    alone = records.where(F.col("kind").isin(*DIRECT) & text(F.col("agent")).isNotNull()).select(F.col("id").alias("source")).join(quoted.hint("merge"), "source", "left_anti")
    return quoted.select("source", episode_of(F.col("raw")).alias("episode")).unionByName(alone.select("source", episode_of(F.concat(F.lit("direct:"), "source")).alias("episode")))


def terms_of(records: DataFrame, refs: DataFrame, agents: DataFrame) -> DataFrame:
    """node, term, term_kind, ns, scope, source: names under which a node may be looked for. Claims and events have none of
    their own; a value is a name while it has at most four words and eighty characters and is no sentence."""
    pair = lambda value, kind: F.struct(text(value).alias("term"), F.lit(kind).alias("term_kind"))
    lists = lambda name: F.split(F.coalesce(F.col("attrs")[name], F.lit("")), ",")
    entity = F.concat(F.array(pair(projections.label(), "canonical")), F.transform(F.concat(lists("alias"), lists("aliases")), lambda x: pair(x, "alias")))
    symbol = F.array(*[pair(F.col("attrs")[n], k) for n, k in (("symbol", "symbol"), ("short", "symbol"), ("expansion", "expansion"), ("long", "expansion"))])
    named = records.where("kind in ('ENT', 'SYM')").select(
        F.col("id").alias("node"), "ns", "scope", F.col("id").alias("source"), F.inline(F.when(F.col("kind") == "ENT", entity).otherwise(symbol))
    )
    label = F.col("node_label")
    short = (F.size(F.split(label, r"\s+")) <= 4) & (F.length(label) <= 80) & ~label.rlike(r"[!?;\n]|\.(\s|$)")
    told = refs.where(F.col("node_kind").isin("entity", "agent", "symbol") | ((F.col("node_kind") == "value") & short))
    told = told.select("node", label.alias("term"), F.lit("reference").alias("term_kind"), "ns", "scope", "source")
    by = agents.select("node", F.col("name").alias("term"), F.lit("agent").alias("term_kind"), "ns", "scope", "source")
    return named.where("term is not null").unionByName(told, allowMissingColumns=False).unionByName(by).distinct()


def tally(mentions: DataFrame) -> DataFrame:
    """node, kind, label, synthetic, n: how often a node is mentioned as what. Sums of tallies are tallies, so a change adds
    what it mentions and takes off what it mentioned."""
    return mentions.groupBy("node", "kind", "label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def nodes(tallies: DataFrame) -> DataFrame:
    """(id, kind, label, synthetic) from all tallies: a record's node is what the record says; without a record, a node lives
    as long as something joins it, and of several labels the least counts."""
    sums = tallies.groupBy("node", "kind", "label", "synthetic").agg(F.sum("n").alias("n")).where("n > 0")
    one = sums.groupBy(F.col("node").alias("id")).agg(F.min(F.struct("synthetic", "kind", "label")).alias("x"))
    return one.select("id", "x.kind", "x.label", "x.synthetic")
