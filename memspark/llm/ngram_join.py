"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification decides.

A text's signature is cut into trees. A tree's rows, sorted by the signature's values there, are a prefix trie whose nodes
are runs of equal prefixes. All trees are sorted once, at full depth, and one stream over them gives the runs of each
depth. The matched prefixes are then shortened, a value at a time, until the links that the data seem to hold are found
with the target recall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, materialize, numbered, sliced
from .decontam import words_of

TREES, DEPTH, BITS = 24, 8, 14
_draw = np.random.default_rng(20240229)
SCALE = (_draw.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * 2 + 1)[:, None]
SHIFT = _draw.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)[:, None]
HALF = DEPTH // 2
PLACES = _draw.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `width` words; a shorter text's words are one shingle."""
    ws = words_of(text)
    if not ws:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    k = min(width, len(ws))
    total = np.full(len(ws) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        total += mixed(hashes[j : len(ws) - k + 1 + j] * PLACES[j % 64] + np.uint64(j))
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> bytes:
    """MinHash values of a shingle set, BITS bits of each, tree by tree."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    best = None
    for at in range(0, len(low), 1024):
        least = (SCALE * low[None, at : at + 1024] + SHIFT).min(axis=1)
        best = least if best is None else np.minimum(best, least)
    best = (best ^ (best >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((best >> np.uint32(7)) & np.uint32((1 << BITS) - 1)).astype("<u2").tobytes()


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell shingle sets apart, as two signed longs."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype="<i8")
    return int(a), int(b)


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two sets of a similarity share a prefix of a depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, target: float, depth: int = DEPTH) -> int:
    """The longest prefix that finds pairs at the threshold with the target recall, 1 if even that doesn't: no data ask
    for a shorter one, since none of their links is less similar."""
    while depth > 1 and recall(threshold, depth) < target:
        depth -= 1
    return depth


def shortened(pairs: list[tuple[int, float, int]], threshold: float, target: float, doubt: int = 100) -> tuple[int, dict[int, float]]:
    """The longest depth whose estimated recall reaches the target, and the estimates by depth.

    pairs: (longest depth at which they share a prefix, similarity by their signatures, how many). A pair of similarity s
    that is found stands for 1 / recall(s) such pairs. `doubt` more pairs just at the threshold are believed in whatever
    the data say, so a handful of close copies doesn't end the search.
    """
    least, estimates = prefix_depth(threshold, target), {}
    for depth in range(DEPTH, least - 1, -1):
        seen = [(max(s, threshold), n) for own, s, n in pairs if own >= depth and s >= threshold]
        found = sum(n for _, n in seen) + doubt * recall(threshold, depth)
        held = sum(n / recall(s, depth) for s, n in seen) + doubt
        estimates[depth] = found / held
        if estimates[depth] >= target:
            return depth, estimates
    return least, estimates


#: A document is its id and a 128-bit hash of its text: null ids and ids with several texts are told apart.
KEY = ["did", "t1", "t2"]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [id_key(doc_id).alias("did"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """did, t1, t2 (hash of the text), f1, f2 (fingerprint of the shingle set), n (its size), sig; a row a document, n is
    0 without words."""

    def run(batches):
        for b in sliced(batches, 3):
            rows = []
            for text in b.column(3).to_pylist():
                found = shingles(text, width)
                if len(found):
                    rows.append((*fingerprint(found), len(found), signature(found)))
                else:
                    rows.append((0, 0, 0, b""))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *arrays], names=[*KEY, "f1", "f2", "n", "sig"])

    kinds = "did long, t1 long, t2 long, f1 long, f2 long, n long, sig binary"
    return docs.select(*row_key(), "text").mapInArrow(run, kinds)


def forest(texts: DataFrame) -> DataFrame:
    """k1, k2 (tree and the signature's values there), id: the rows that, sorted, are the trees' prefix tries."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u2").reshape(n, TREES, DEPTH).astype(np.int64)
            for t in range(TREES):
                keys = [np.full(n, t), np.zeros(n, dtype=np.int64)]
                for k in range(DEPTH):
                    keys[k // HALF] = (keys[k // HALF] << BITS) + values[:, t, k]
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), b.column(0)], names=["k1", "k2", "id"])

    return texts.select("id", "sig").mapInArrow(run, "k1 long, k2 long, id long")


def prefixes(k1: np.ndarray, k2: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys cut after `depth` values."""
    first, second = BITS * (HALF - min(depth, HALF)), BITS * (DEPTH - max(depth, HALF))
    return k1 >> first << first, k2 >> second << second


def matched(texts: DataFrame, least: int) -> DataFrame:
    """(id, tree, depth, head): each text's runs of equal prefixes of `least` values or more, without the runs of one.

    A run goes by its head, the first of its rows in sorted order; heads have no row for their own run. Of depths with
    the same head, the longest stands for all. So a text's run at depth d is that of its shortest depth >= d.

    The rows of all tries are range-partitioned and sorted once, and each partition is streamed once, in constant memory,
    so a prefix that a third of the texts share spreads over many partitions. A partition may begin in the middle of runs.
    What it can't know, their heads, is settled by two marks a partition and depth.
    """
    slim = materialize(forest(texts), "forest")  # range partitioning samples its input before it reads it
    spread = slim.repartitionByRange("k1", "k2", "id").sortWithinPartitions("k1", "k2", "id")
    names = ["id", "tree", "depth", "head", "open", "mark", "p1", "p2", "k1", "k2"]
    kinds = [np.int64, np.int32, np.int32, np.int64, bool, bool, np.int64, np.int64, np.int64, np.int64]

    def rows(*columns):
        n = max((len(x) for x in columns if isinstance(x, np.ndarray)), default=1)
        arrays = [pa.array(np.broadcast_to(np.asarray(x, dtype=k), (n,))) for x, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def stream(batches):
        runs: dict[int, tuple] = {}  # by depth, the run that the batch before ended in: prefix, head's row, whether it began the partition
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k1, k2, ids = (np.asarray(b.column(c)) for c in ("k1", "k2", "id"))
            places = np.arange(n)
            deeper = None
            for depth in range(DEPTH, least - 1, -1):
                p1, p2 = prefixes(k1, k2, depth)
                new = np.ones(n, dtype=bool)
                new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
                at = np.maximum.accumulate(np.where(new, places, 0))
                heads, opened, told = ids[at], np.zeros(n, dtype=bool), new.copy()
                before = runs.get(depth)
                if before is None:
                    yield rows(0, 0, depth, ids[:1], False, True, p1[0], p2[0], k1[0], k2[0])
                    opened = at == 0
                elif before[0] == (p1[0], p2[0]):
                    heads, opened, told[0] = np.where(at == 0, before[1][2], heads), (at == 0) & before[2], False
                other = ~told & (opened | (heads != deeper) if deeper is not None else True)
                out = np.flatnonzero(other)
                if len(out):
                    yield rows(ids[out], (k1[out] >> (BITS * HALF)), depth, heads[out], opened[out], False, 0, 0, 0, 0)
                deeper = heads
                carried = before is not None and at[-1] == 0 and before[0] == (p1[-1], p2[-1])
                runs[depth] = before if carried else ((p1[-1], p2[-1]), (k1[at[-1]], k2[at[-1]], ids[at[-1]]), bool(opened[-1]))
        for depth, ((p1, p2), (k1, k2, head), _) in runs.items():
            yield rows(0, 0, depth, np.array([head]), False, True, p1, p2, k1, k2)

    schema = "id long, tree int, depth int, head long, open boolean, mark boolean, p1 long, p2 long, k1 long, k2 long"
    streamed = materialize(spread.mapInArrow(stream, schema), "tries")
    tree = F.shiftright("p1", BITS * HALF).cast("int").alias("tree")
    marks = streamed.where("mark").select(tree, "depth", "head", "p1", "p2", "k1", "k2").distinct()
    firsts = marks.groupBy("depth", "p1", "p2").agg(F.min(F.struct("k1", "k2", "head")).alias("least"))
    moved = marks.join(firsts, ["depth", "p1", "p2"]).select("tree", "depth", "head", F.col("least.head").alias("first"))
    moved = materialize(moved.where("head != first").distinct(), "edges")  # two a partition and depth at most
    known = streamed.where("not mark").select("id", "tree", "depth", "head", "open")
    settled = known.where("open").join(F.broadcast(moved), ["tree", "depth", "head"], "left").withColumn("head", F.coalesce("first", "head"))
    columns = ["id", "tree", "depth", "head"]
    return known.where("not open").select(columns).unionByName(settled.select(columns)).unionByName(
        moved.select(F.col("head").alias("id"), "tree", "depth", F.col("first").alias("head"))
    )


def similar(runs: DataFrame, texts: DataFrame) -> list[tuple[int, float, int]]:
    """(depth, similarity, how many) of each text and the head of its longest matched prefix, by their signatures."""
    nearest = runs.groupBy("id").agg(F.max(F.struct("depth", "tree", "head")).alias("r")).select("id", "r.depth", "r.head")
    sigs = texts.select("id", "sig")
    both = nearest.join(sigs, "id").join(sigs.toDF("head", "other"), "head").select("depth", "sig", "other")

    def run(batches):
        for b in batches:
            own, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(b.num_rows, -1) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((own == other).sum(axis=1).astype(np.int32))], names=["depth", "equal"])

    counts = both.mapInArrow(run, "depth int, equal int").groupBy("depth", "equal").count()
    return [(d, e / (TREES * DEPTH), n) for d, e, n in counts.collect()]  # at most a row a depth and number of values


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(id, root) of each node of edges(a, b): the least node that it is connected to, by alternating stars.

    Large stars hang a node's larger neighbours on its least one, small stars its smaller ones, until nothing moves;
    a star of any size is one partial aggregate and one join, whose key carries a salt, and its rows stay rows.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    salted = lambda e: e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(8)).cast("int"))

    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = salted(both.where("v > u")).join(least.select("u", "m", salts), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large).join(least.select("u", "m", salts), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, or of left itself."""
    sets = left if right is None else [*left, *right]
    codes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, back, times = np.unique(codes, return_inverse=True, return_counts=True)
    shared = times[back] > 1
    back, owner = (np.cumsum(times > 1) - 1)[back[shared]], owner[shared]
    order = np.argsort(back, kind="stable")
    back, owner = back[order], owner[order]
    n, m = len(left), len(sets) - (0 if right is None else len(left))
    out = np.zeros((n, m), dtype=np.float32)
    total, step = int((times > 1).sum()), max(256, (1 << 22) // len(sets))
    for at in range(0, total, step):
        a, b = np.searchsorted(back, [at, at + step])
        held = np.zeros((len(sets), min(step, total - at)), dtype=np.float32)
        held[owner[a:b], back[a:b] - at] = 1
        out += held[:n] @ (held if right is None else held[n:]).T
    return out


def spanning(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that suffice to connect what all pairs connect."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def verified(threshold: float, depth: int):
    """For a group (of one block, or of two, side 0 and side 1): a row (a, null, links) a set with links, and rows
    (a, b, 0) that connect what links connect. Links count the copies that the other set stands for. In the groups of a
    run, a pair that shares a prefix in an earlier tree too is left to that tree's run."""

    def met(one: np.ndarray, other: np.ndarray, trees: int) -> np.ndarray:
        out = np.zeros(len(one), dtype=bool)
        for t in range(trees):
            cut = slice(t * DEPTH, t * DEPTH + depth)
            out |= (one[:, cut] == other[:, cut]).all(axis=1)
        return out

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        columns = [table.column(c).to_pylist() for c in ("id", "side", "copies", "codes", "sig")]
        for i, side, copies, codes, sig in zip(*columns, strict=True):
            rows[i, side] = (copies, np.frombuffer(codes, dtype="<u8"), sig)
        names = [[i for i, s in rows if s == k] for k in (0, 1)]
        sides = [[rows[i, k] for i in names[k]] for k in (0, 1)]
        out: list[tuple] = []
        cross = bool(sides[1])
        if sides[0] and (cross or len(sides[0]) > 1):
            left, right = sides[0], sides[1] if cross else sides[0]
            shared = overlaps([x[1] for x in left], [x[1] for x in right] if cross else None)
            sizes = [np.array([len(x[1]) for x in y], dtype=np.float64) for y in (left, right)]
            copies = [np.array([x[0] for x in y], dtype=np.int64) for y in (left, right)]
            linked = shared >= threshold * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-6
            if not cross:
                np.fill_diagonal(linked, False)
            tree = table.column("tree")[0].as_py()
            if tree > 0:
                sigs = [np.frombuffer(b"".join(x[2] for x in y), dtype="<u2").reshape(len(y), -1) for y in (left, right)]
                for at in range(0, len(left), 64):
                    a, b = np.nonzero(linked[at : at + 64])
                    linked[at : at + 64][a, b] = ~met(sigs[0][at + a], sigs[1][b], tree)
            ids = names[0] + (names[1] if cross else [])
            counts = [linked @ copies[1], *([copies[0] @ linked] if cross else [])]
            out += [(i, None, int(w)) for i, w in zip(ids, np.concatenate(counts), strict=True) if w]
            pairs = np.argwhere(linked) + np.array([0, len(left) if cross else 0])
            out += [(ids[a], ids[b], 0) for a, b in spanning(len(ids), pairs)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "b", "links"])

    return run


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    target: float = 0.999,
    block_shingles: int = 250_000,
    block_texts: int = 500,
) -> DataFrame:
    """Link documents whose sets of `width`-word shingles have a Jaccard similarity of at least `threshold`.

    Returns a row a document: doc_id, class_id (the least doc_id that links lead to), copy_id (the least doc_id with
    the same shingles), n_links (the other documents that it is linked to itself, copies each counted). Words are
    those of decontamination. Texts of fewer words are one shingle; null texts and texts without words link to nothing.
    A null doc_id counts as the largest id, and is the class of its document if nothing else is. Repeated rows are
    copies of each other. An empty table gives an empty table.

    Copies meet first, so a text that a third of the corpus holds goes on as one row. Runs of equal prefixes give stars,
    not pairs. Candidates are verified in blocks of bounded size, each pair of blocks a task of its own: those that stars
    connect all against all or, where that moves more texts, as with long chains of loosely like texts, run by run.
    What tasks return is counts and the pairs that connect, never all links.
    """
    kind = docs.schema["doc_id"].dataType
    as_id = lambda c: F.when(c != NULL_ID, c).cast(kind)
    return classes(docs, threshold, width, target, block_shingles, block_texts).select(
        as_id(F.col("did")).alias("doc_id"),
        as_id(F.coalesce("class.did", "did")).alias("class_id"),
        as_id(F.coalesce("rep.did", "did")).alias("copy_id"),
        F.coalesce("total", F.lit(0)).alias("n_links"),
    )


def classes(docs: DataFrame, threshold: float, width: int, target: float, block_shingles: int, block_texts: int) -> DataFrame:
    """did, t1, t2 of each row of docs; rep and class, the least such key with its shingles and in its class, and total,
    its links; these are null without words."""
    profiled = materialize(profiles(docs.select("doc_id", "text"), width), "profiles")
    worded = profiled.where("n > 0")
    owners = worded.groupBy("f1", "f2").agg(
        F.min(F.struct(*KEY)).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    texts = materialize(owners.withColumn("id", F.monotonically_increasing_id()), "texts")  # written, so ids stay as they are
    runs = materialize(matched(texts, prefix_depth(threshold, target)), "runs")
    depth, _ = shortened(similar(runs, texts), threshold, target)
    runs = runs.where(F.col("depth") >= depth).groupBy("id", "tree").agg(F.min_by("head", "depth").alias("head"))
    runs = materialize(runs, "runs")
    candidates = components(runs.select(F.col("id").alias("a"), F.col("head").alias("b")), "candidates")
    members = materialize(candidates.join(texts.select("id", "rep", "copies", "n", "f1", "f2"), "id"), "members")
    groups = assigned(members, runs, block_shingles, block_texts)
    links = materialize(links_of(docs, members, groups, texts, threshold, width, depth), "links")
    found = components(links.where("b is not null").select("a", "b"), "classes")
    counts = links.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    linked = found.toDF("id", "root").join(texts.select("id", "rep"), "id")
    salt = F.pmod(F.xxhash64("id"), F.lit(8)).cast("int")  # a class may hold a third of all texts
    least = linked.groupBy("root").agg(F.min("rep").alias("class")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    classed = linked.withColumn("salt", salt).join(least, ["root", "salt"]).select("id", "class")
    total = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("total")
    nodes = (
        texts.select("id", "f1", "f2", "rep", "copies")
        .join(classed, "id", "left")
        .join(counts.toDF("id", "links"), "id", "left")
        .select("f1", "f2", "copies", "rep", F.coalesce("class", "rep").alias("class"), total)
    )
    return of_each(profiled.select(*KEY, "f1", "f2"), materialize(nodes, "nodes")).drop("f1", "f2", "copies")


def of_each(rows: DataFrame, nodes: DataFrame, hot: int = 1_000, broadcast_rows: int = 100_000) -> DataFrame:
    """rows with what nodes say of their text, null if nothing. The texts of which there are `hot` copies or more are
    broadcast, while they are at most broadcast_rows, so that a text that a third of the rows hold is no one task's."""
    often = nodes.where(F.col("copies") >= hot)
    if often.limit(broadcast_rows + 1).count() > broadcast_rows:
        return rows.join(nodes, ["f1", "f2"], "left")
    own = rows.join(F.broadcast(often), ["f1", "f2"])
    others = rows.join(F.broadcast(often.select("f1", "f2")), ["f1", "f2"], "left_anti")
    return own.unionByName(others.join(nodes.where(F.col("copies") < hot), ["f1", "f2"], "left"))


def blocks_of(texts: Column, shingles: Column, block_texts: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(shingles / block_shingles), F.ceil(texts / block_texts)).cast("int")


def assigned(members: DataFrame, runs: DataFrame, block_shingles: int, block_texts: int) -> DataFrame:
    """(id, places): the groups that each text is verified in, (tree, node, block, blocks) each. A component of candidates
    is one group, with tree -1, or its runs are, whichever moves fewer texts: n of them over k blocks make n * k."""
    n_all, n_shingles = F.count(F.lit(1)), F.sum("n")
    whole = members.groupBy("root").agg(n_all.alias("texts"), blocks_of(n_all, n_shingles, block_texts, block_shingles).alias("blocks"))
    big = materialize(whole.where("blocks > 1"), "big")
    small = lambda df: F.broadcast(df) if big.limit(100_001).count() <= 100_000 else df  # noqa: E731  (at most one a block of texts)
    own = runs.unionByName(runs.select(F.col("head").alias("id"), "tree", "head")).distinct()
    own = own.join(members.join(small(big.select("root")), "root").select("id", "n", "root"), "id")  # texts of big components alone
    sizes = own.groupBy("root", "tree", "head").agg(n_all.alias("texts"), blocks_of(n_all, n_shingles, block_texts, block_shingles).alias("blocks"))
    cost = sizes.groupBy("root").agg(F.sum(F.col("texts") * F.col("blocks")).alias("cost"))
    loose = materialize(big.join(cost, "root").where("cost < texts * blocks").select("root"), "loose")
    by_run = own.join(small(loose), "root").join(sizes.drop("root", "texts"), ["tree", "head"]).select("id", "tree", F.col("head").alias("node"), "blocks")
    at_once = members.join(small(big.select("root", "blocks")), "root", "left").join(small(loose), "root", "left_anti")
    at_once = at_once.select("id", F.lit(-1).alias("tree"), F.col("root").alias("node"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    places = by_run.unionByName(at_once).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return places.groupBy("id").agg(F.collect_list(F.struct("tree", "node", "block", "blocks")).alias("places"))  # one a tree at most


def links_of(
    docs: DataFrame, members: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float, width: int, depth: int, broadcast_rows: int = 500_000
) -> DataFrame:
    """What `verified` returns for every pair of blocks of the groups. Only members' texts are moved: while these are at
    most broadcast_rows, the others are left out before the shuffle."""
    wanted = members.select("id", "rep.*", "copies", "f1", "f2").join(groups, "id").join(texts.select("id", "sig"), "id")
    rows = docs.select(*row_key(), "text")
    if members.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.withColumn("__ms_key", F.xxhash64(*KEY)).join(F.broadcast(members.select(F.xxhash64("rep.did", "rep.t1", "rep.t2").alias("__ms_key"))), "__ms_key", "left_semi").drop("__ms_key")
    joined = rows.join(wanted, KEY)
    names = ["tree", "node", "bi", "bj", "side", "id", "copies", "codes", "sig"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for text, i, f1, f2, copies, sig, places in zip(*(b.column(c).to_pylist() for c in ("text", "id", "f1", "f2", "copies", "sig", "places")), strict=True):
                codes = shingles(text, width)
                if fingerprint(codes) != (f1, f2):
                    continue  # another text with this key's hashes
                own = codes.tobytes()
                for p in places:
                    tree, node, block, blocks = p["tree"], p["node"], p["block"], p["blocks"]
                    held = (i, copies, own, sig if tree > 0 else b"")
                    out += [(tree, node, block, j, 0, *held) for j in range(block, blocks)]
                    out += [(tree, node, k, block, 1, *held) for k in range(block)]
                    if len(out) >= 1000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "tree int, node long, bi int, bj int, side int, id long, copies long, codes binary, sig binary"
    dealt = joined.mapInArrow(run, schema)
    return dealt.groupBy("tree", "node", "bi", "bj").applyInArrow(verified(threshold, depth), "a long, b long, links long")


def one_of_each(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    target: float = 0.999,
    block_shingles: int = 250_000,
    block_texts: int = 500,
) -> DataFrame:
    """docs, all columns, with one document of each class alone, one of least doc_id; of its repeated rows one stays.

    Documents are told apart by doc_id and text, so null ids, or one id with unrelated texts, lose no class. Without
    words a text is a class of its own."""
    found = classes(docs, threshold, width, target, block_shingles, block_texts)
    kept = found.where(F.col("class").isNull() | (F.col("class") == F.struct(*KEY))).select(*KEY).distinct()
    source, names = numbered(docs)
    did, t1, t2 = row_key(names["doc_id"], names["text"])
    known = source.withColumns({"did": did, "t1": t1, "t2": t2}).join(kept, KEY, "left_semi")
    return known.dropDuplicates(KEY).select(*names.values()).toDF(*docs.columns)
