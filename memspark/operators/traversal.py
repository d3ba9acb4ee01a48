"""Traversal of canonical relations under budgets: which nodes a query's seeds reach, by which path, and what that is worth.

Edges stay in Spark: a hop is one scan for edges at the frontier, cut to the budget by a bounded heap in each task. What is
decided on the way, who is taken and who is whose parent, is at most 4 096 edges a hop and 500 nodes in all, whatever the
size of the graph, and is decided on the driver, in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seeds in all and those kept for semantic ones, nodes and sources in all, and the budgets by hits asked for.
SEEDS, RESERVE, LOAD = 300, 50, 500
LEAST_NODES, NODES_A_HIT, LEAST_EDGES, EDGES_A_NODE, MOST_EDGES = 64, 32, 256, 8, 4096
#: Kinds of records that the leg may return.
RETURNED = ("ENT", "CLM", "EVT", "REL", "STA", "RAW")

REACHED = (
    "id string, hop int, neighbours int, lexical_seed boolean, semantic_seed boolean, attributed boolean, "
    "path array<struct<edge:string,predicate:string,src:string,dst:string,source:string>>"
)


def budgets(seeds: int, limit: int) -> tuple[int, int]:
    """How many nodes may be reached, seeds included, and how many edges a hop may look at."""
    nodes = max(seeds, min(LOAD, max(LEAST_NODES, NODES_A_HIT * limit)))
    return nodes, min(MOST_EDGES, max(LEAST_EDGES, EDGES_A_NODE * nodes))


def seed_limit(limit: int) -> int:
    return max(50, min(250, 20 * limit))


def seed_room(semantic: bool, limit: int) -> int:
    """How many lexical seeds there may be: some places are kept if there are semantic ones."""
    return min(seed_limit(limit), SEEDS - (RESERVE if semantic else 0))


@dataclass
class Walk:
    """What a traversal has reached so far. An edge is (id, src, predicate, dst, source)."""

    nodes: int
    hop: dict[str, int] = field(default_factory=dict)
    reached: set[str] = field(default_factory=set)
    sources: set[str] = field(default_factory=set)
    parents: dict[str, tuple] = field(default_factory=dict)
    near: dict[str, set[str]] = field(default_factory=dict)
    late: dict[str, tuple] = field(default_factory=dict)  # by source, the first (hop, parent edge) that joins reached nodes

    def step(self, hop: int, frontier: set[str], edges: list[tuple]) -> set[str]:
        """Take the new nodes that edges lead to, by id, each by its least parent edge, while there is room: a node takes a
        place, and so does the record that its edge comes from."""
        ways: dict[str, list[tuple]] = {}
        for edge, src, predicate, dst, source in edges:
            self.near.setdefault(src, set()).add(dst)
            self.near.setdefault(dst, set()).add(src)
            for parent, child in ((src, dst), (dst, src)):
                if parent in frontier:
                    ways.setdefault(child, []).append((parent, edge, predicate, src, dst, source))
        new: set[str] = set()
        for child in sorted(set(ways) - self.reached):
            if len(self.reached) + len(new) >= self.nodes:
                break
            way = min(ways[child])
            source = way[-1] if way[-1] and way[-1] not in self.sources else None
            if len(self.reached) + len(new) + len(self.sources) + 1 + (source is not None) > LOAD:
                continue
            new.add(child)
            for x in (child, source):
                if x is not None:
                    self.hop[x], self.parents[x] = hop, way
            if source is not None:
                self.sources.add(source)
        self.reached |= new
        for way in (w for own in ways.values() for w in own):
            if way[-1] and way[3] in self.reached and way[4] in self.reached:
                self.late[way[-1]] = min(self.late.get(way[-1], (hop, way)), (hop, way))
        return new

    def fill(self, first: set[str]) -> None:
        """Give the places left to records of edges between reached nodes: those in `first`, then by hop and id."""
        for source in sorted(self.late, key=lambda s: (s not in first, self.late[s][0], s)):
            if len(self.reached) + len(self.sources) >= LOAD:
                break
            if source not in self.sources:
                self.sources.add(source)
                self.hop[source], self.parents[source] = self.late[source]

    def path(self, node: str, hops: int) -> list[tuple]:
        """Edges from a seed to a node, in order; none for a seed."""
        out: list[tuple] = []
        while len(out) < hops and self.hop.get(node) and node in self.parents:
            node, *edge = self.parents[node]
            out.append((edge[0], edge[1], edge[2], edge[3], edge[4]))
        return out[::-1]


def traverse(spark: SparkSession, relations: DataFrame, lexical: DataFrame, semantic: DataFrame, hops: int, limit: int, records: DataFrame | None = None) -> DataFrame:
    """What seeds reach over relations(id, src, predicate, dst, source) in at most `hops`: see REACHED. source is the record
    that a relation comes from; records of taken edges are among the rows.

    lexical and semantic: seeds (id), of which the first by id count, lexical ones before; 50 of 300 places are kept for
    semantic ones if there are any. records (id): semantic seeds that are records, which come first for places left."""
    first = sorted(r[0] for r in semantic.select("id").distinct().orderBy("id").limit(SEEDS).collect())
    said = sorted(r[0] for r in lexical.select("id").distinct().orderBy("id").limit(seed_room(bool(first), limit)).collect())
    meant = first[: SEEDS - len(said)]
    own = set() if records is None else {r[0] for r in records.select("id").distinct().orderBy("id").limit(SEEDS).collect()}
    frontier = set(said) | set(meant)
    nodes, edges = budgets(len(frontier), limit)
    walk = Walk(nodes, dict.fromkeys(frontier, 0), set(frontier))
    columns = ["id", "src", "predicate", "dst", "source"]
    for hop in range(1, hops + 1):
        if not frontier:
            break
        ends = sorted(frontier)  # at most LOAD
        at = relations.where(F.col("src").isin(ends) | F.col("dst").isin(ends)).select(*columns)
        frontier = walk.step(hop, frontier, [tuple(r) for r in at.orderBy("id").limit(edges).collect()])
    walk.fill(own)
    rows = [
        (x, walk.hop.get(x, 0), len(walk.near.get(x, ())), x in said, x in meant or x in walk.sources and x in own, x in walk.sources, walk.path(x, hops))
        for x in sorted(walk.reached | walk.sources)
    ]
    return spark.createDataFrame(rows, REACHED)


def worth(lexical: Column) -> Column:
    """A reached record's score: its lexical score, a tenth a neighbour up to 0.6, and what it is a seed or source by."""
    near = F.least(F.lit(0.6), F.col("neighbours") * 0.1)
    given = F.when(F.col("lexical_seed"), 0.5).otherwise(0.0) + F.when(F.col("semantic_seed"), 0.25).otherwise(0.0) + F.when(F.col("attributed"), 0.1).otherwise(0.0)
    return lexical + near + given


def hits(reached: DataFrame, records: DataFrame, lexical: Column, include_raw: bool = False) -> DataFrame:
    """(id, score, hop, path) of the reached records(id, kind, ...), at most 500, among those given."""
    kinds = [k for k in RETURNED if include_raw or k != "RAW"]
    found = records.where(F.col("kind").isin(kinds)).join(F.broadcast(reached), "id")
    return found.withColumn("score", worth(lexical)).select("id", "score", "hop", "path")
