"""MinHash near-duplicate removal by one permutation: a text's shingles are hashed once, the least hash in each of a number
of bins is its signature, and bins without a shingle borrow from one that has some (optimal densification).

Bands of signature values make buckets. A bucket's texts are compared with its head alone, a star in place of all pairs, on
their full sets. Where that leaves a bucket's texts in one component, no other pair in it matters. The rest of the other
buckets gets a new head, and what two more stars leave open is compared in blocks, so no link is lost to the stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, materialize
from .ngram_join import KEY, PLACES, assigned, blocks_of, components, fingerprint, mixed, of_each, overlaps, row_key, spanning
from .runs import later_in_run

#: 32 bands of 5 values: of pairs at the threshold 0.8 a share of 1 - (1 - 0.8^5)^32, all but 3 in a million, meet in one.
BANDS, VALUES = 32, 5
BINS = BANDS * VALUES
EDGES = (np.arange(1, BINS, dtype=object) * 2**64 // BINS).astype(np.uint64)
_draw = np.random.default_rng(20140521)
#: For each bin, all bins in an order of its own: an empty bin takes the value of the first that is not.
DONORS = np.stack([_draw.permutation(BINS) for _ in range(BINS)])
WEIGHTS = _draw.integers(1, 2**62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `width` words; a shorter text's words are one shingle."""
    ws = words_of(text)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    k = min(width, len(ws))
    runs = [hashes[j : len(ws) - k + 1 + j] * PLACES[j % len(PLACES)] + np.uint64(j) for j in range(k)]
    return np.unique(mixed(sum(map(mixed, runs), np.uint64(k)))) if ws else hashes


def signature(found: np.ndarray) -> np.ndarray:
    """The least of the sorted hashes in each bin of their range, bins without one densified."""
    at = np.concatenate([[0], np.searchsorted(found, EDGES), [len(found)]])
    full = at[1:] > at[:-1]
    own = np.where(full, found[np.minimum(at[:-1], len(found) - 1)], np.uint64(0))
    empty = np.flatnonzero(~full)
    if len(empty):
        few = DONORS[empty, :16]
        donor = few[np.arange(len(empty)), full[few].argmax(axis=1)]
        left = np.flatnonzero(~full[donor])  # none of the first sixteen has a value
        if len(left):
            every = DONORS[empty[left]]
            donor[left] = every[np.arange(len(left)), full[every].argmax(axis=1)]
        own[empty] = own[donor]
    return own


def bands(signatures: np.ndarray) -> np.ndarray:
    """A key a band of each row of signatures, as signed longs."""
    cut = mixed(signatures.reshape(len(signatures), BANDS, VALUES)) * WEIGHTS
    return mixed(cut.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """did, t1, t2 (hash of the text), f1, f2 (fingerprint of the shingle set), n (its size), keys (a long a band)."""

    def run(batches):
        for b in batches:
            prints, sizes, keys = [], [], []
            for text in b.column(3).to_pylist():
                found = shingles(text, width)
                prints.append(fingerprint(found) if len(found) else (0, 0))
                sizes.append(len(found))
                keys.append(bands(signature(found)[None])[0].tobytes() if len(found) else b"")
            columns = [pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)]
            columns += [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=[*KEY, "f1", "f2", "n", "keys"])

    kinds = "did long, t1 long, t2 long, f1 long, f2 long, n long, keys binary"
    return docs.select(*row_key(), "text").mapInArrow(run, kinds)


def banded(texts: DataFrame) -> DataFrame:
    """key, id, band: a row a band of each text."""

    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<i8").reshape(b.num_rows, BANDS)
            ids = np.asarray(b.column(0))
            for k in range(BANDS):
                columns = [pa.array(np.ascontiguousarray(keys[:, k])), pa.array(ids), pa.array(np.full(len(ids), k, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "band"])

    return texts.select("id", "keys").mapInArrow(run, "key long, id long, band int")


def compared(docs: DataFrame, placed: DataFrame, width: int, percent: int, broadcast_rows: int = 500_000) -> DataFrame:
    """(a, b): pairs of texts that are linked, enough of them to connect what the links in each group connect.

    placed: id, rep, f1, f2 and places, an array of (tree, node, block, blocks, role). A text of role 0 meets all others of
    its group, a head (role 1) all members (role 2), pairs of blocks each a task of its own. Only these texts are moved;
    while they are at most broadcast_rows, the others are left out before the shuffle."""
    rows = docs.select(*row_key(), "text")
    wanted = placed.select("id", "rep.*", "f1", "f2", "places")
    if placed.limit(broadcast_rows + 1).count() <= broadcast_rows:
        mark = F.xxhash64(*KEY).alias("__ms_key")
        rows = rows.withColumn("__ms_key", mark).join(F.broadcast(wanted.select(mark)), "__ms_key", "left_semi").drop("__ms_key")
    joined = rows.dropDuplicates(KEY).join(wanted, KEY)
    names = ["tree", "node", "bi", "bj", "side", "id", "codes"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def cells(block: int, blocks: int, role: int):
        if role == 1:
            return [(0, j, 0) for j in range(blocks)]
        if role == 2:
            return [(0, block, 1)]
        return [(block, j, 0) for j in range(block, blocks)] + [(k, block, 1) for k in range(block)]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    def deal(batches):
        for b in batches:
            out: list[tuple] = []
            held = 0
            for text, i, f1, f2, places in zip(*(b.column(c).to_pylist() for c in ("text", "id", "f1", "f2", "places")), strict=True):
                codes = shingles(text, width)
                if fingerprint(codes) != (f1, f2):
                    continue  # another text with this key's hashes
                own = codes.tobytes()
                for p in places:
                    for cell in cells(p["block"], p["blocks"], p["role"]):
                        out.append((p["tree"], p["node"], *cell, i, own))
                        held += len(own)
                        if len(out) >= 1000 or held > 16 << 20:
                            yield batch(out)
                            out, held = [], 0
            if out:
                yield batch(out)

    def verify(table: pa.Table) -> pa.Table:
        sides: list[dict] = [{}, {}]
        for i, side, codes in zip(*(table.column(c).to_pylist() for c in ("id", "side", "codes")), strict=True):
            sides[side][i] = np.frombuffer(codes, dtype="<u8")
        left, right = sides
        out: list[tuple] = []
        if left and (right or len(left) > 1):
            other = right or left
            shared = overlaps(list(left.values()), list(right.values()) if right else None).astype(np.float64)
            sizes = [np.array([len(x) for x in y.values()], dtype=np.float64) for y in (left, other)]
            linked = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
            if not right:
                np.fill_diagonal(linked, False)
            ids = [*left, *right]
            pairs = np.argwhere(linked) + np.array([0, len(left) if right else 0])
            out = [(ids[a], ids[b]) for a, b in spanning(len(ids), pairs)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["a", "b"])

    schema = "tree int, node long, bi int, bj int, side int, id long, codes binary"
    return joined.mapInArrow(deal, schema).groupBy("tree", "node", "bi", "bj").applyInArrow(verify, "a long, b long")


def place(tree: Column | int, node: str, block: Column | int, blocks: Column | int, role: int) -> Column:
    as_int = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("int")
    return F.struct(as_int(tree).alias("tree"), F.col(node).alias("node"), as_int(block).alias("block"), as_int(blocks).alias("blocks"), F.lit(role).alias("role"))


def starred(edges: DataFrame, texts: DataFrame, block_shingles: int, block_texts: int) -> DataFrame:
    """texts of edges (id, head) with the places where each head meets its members, in blocks of bounded size."""
    sized = edges.join(texts.select("id", "n"), "id")
    blocks = blocks_of(F.count(F.lit(1)), F.sum("n"), block_texts, block_shingles).alias("blocks")
    stars = materialize(sized.groupBy("head").agg(blocks), "stars")
    many = small(stars.where("blocks > 1"))  # at most one for every block_texts edges or block_shingles shingles
    members = sized.select("id", "head").join(many, "head", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.select("id", place(-1, "head", F.pmod(F.xxhash64("id"), F.col("blocks")), F.col("blocks"), 2).alias("p"))
    heads = stars.select(F.col("head").alias("id"), "head", "blocks").select("id", place(-1, "head", 0, F.col("blocks"), 1).alias("p"))
    places = members.unionByName(heads).groupBy("id").agg(F.collect_list("p").alias("places"))  # a text is in BANDS stars at most, and heads one
    return texts.select("id", "rep", "f1", "f2").join(places, "id")


def blocked(runs: DataFrame, texts: DataFrame, block_shingles: int, block_texts: int) -> DataFrame:
    """texts of runs (id, band, head) with the places where all of a bucket, or of what buckets connect, meet."""
    runs = runs.select("id", F.col("band").alias("tree"), "head")
    found = components(runs.select(F.col("id").alias("a"), F.col("head").alias("b")), "open")
    members = materialize(found.join(texts.select("id", "rep", "n", "f1", "f2"), "id"), "open-members")
    groups = assigned(members, runs, block_shingles, block_texts)
    role = lambda p: F.struct(p["tree"].alias("tree"), p["node"].alias("node"), p["block"].alias("block"), p["blocks"].alias("blocks"), F.lit(0).alias("role"))
    return members.select("id", "rep", "f1", "f2").join(groups.withColumn("places", F.transform("places", role)), "id")


def unjoined(runs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(id, head) of runs, each once, that lie in different components so far."""
    edges = runs.select("id", "head").distinct()
    if roots is None:
        return edges
    edges = edges.join(roots, "id", "left").join(roots.toDF("head", "to"), "head", "left")
    return edges.where(F.coalesce("root", "id") != F.coalesce("to", "head")).select("id", "head")


def still_open(runs: DataFrame, linked: DataFrame, roots: DataFrame) -> DataFrame:
    """band, bucket, id: texts but the head of buckets in which some of these lie in different components.

    runs: id, band, head. Where the head's own links have joined all of a bucket, it needs no look at components."""
    apart = runs.join(linked.select(F.col("a").alias("head"), F.col("b").alias("id")), ["head", "id"], "left_anti")
    wide = small(materialize(apart.select("band", "head").distinct(), "wide"))
    rest = runs.join(wide, ["band", "head"], "left_semi")
    rest = materialize(rest.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rest")
    mixed_ones = rest.groupBy("band", "head").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    mixed_ones = small(materialize(mixed_ones.select("band", "head"), "mixed"))
    return rest.join(mixed_ones, ["band", "head"], "left_semi").select("band", F.col("head").alias("bucket"), "id")


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """rows to be broadcast while they are at most `most`, so that a bucket that many texts share stays where it is read."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def classes(docs: DataFrame, percent: int, width: int, stars: int, block_shingles: int, block_texts: int) -> DataFrame:
    """did, t1, t2 and n of each row of docs, and class, the least such key in its component; null without words."""
    docs = docs.select("doc_id", "text")
    profiled = materialize(profiles(docs, width), "profiles")
    owners = profiled.where("n > 0").groupBy("f1", "f2").agg(
        F.min(F.struct(*KEY)).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    texts = materialize(owners.withColumn("id", F.monotonically_increasing_id()), "texts")  # written, so ids stay as they are
    runs = materialize(later_in_run(banded(texts), ["key"], "id", ["band"], "bands").withColumnRenamed("least", "head"), "runs")
    links, roots = None, None
    for k in range(stars + 1):
        if k < stars:
            placed = starred(unjoined(runs, roots), texts, block_shingles, block_texts)
        else:
            placed = blocked(runs, texts, block_shingles, block_texts)
        linked = materialize(compared(docs, materialize(placed, "placed"), width, percent), "linked")
        links = linked if links is None else links.unionByName(linked)
        roots = materialize(components(links, "components"), "roots")
        if k < stars:
            left = materialize(still_open(runs, linked, roots), "left")
            if not left.limit(1).count():
                break
            left = left.withColumn("own", F.col("band"))
            runs = later_in_run(left, ["band", "bucket"], "id", ["own"], "left").select("id", F.col("own").alias("band"), F.col("least").alias("head"))
            runs = materialize(runs, "runs")
    joined = roots.join(texts.select("id", "rep"), "id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")  # a component may hold a third of all texts
    least = joined.groupBy("root").agg(F.min("rep").alias("class")).select("root", "class", salts)
    classed = joined.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int")).join(least, ["root", "salt"]).select("id", "class")
    nodes = texts.select("id", "f1", "f2", "rep", "copies").join(classed, "id", "left")
    nodes = nodes.select("f1", "f2", "copies", F.coalesce("class", "rep").alias("class"))
    return of_each(profiled.select(*KEY, "n", "f1", "f2"), materialize(nodes, "nodes")).drop("f1", "f2", "copies")


def near_copies(
    docs: DataFrame, percent: int = 80, width: int = 4, stars: int = 3, block_shingles: int = 250_000, block_texts: int = 500
) -> DataFrame:
    """The component of each document among those linked by a Jaccard similarity of at least `percent` / 100 of their sets
    of `width`-word shingles: doc_id, n_shingles, component_id (the least doc_id that links lead to), kept (whether that
    is its own).

    Words lie between ASCII white space, A-Z lower-cased. Texts of fewer words are one shingle; null texts and texts
    without words have none, link to nothing and are kept. A null doc_id counts as the largest id, and is the component of
    its document if nothing else is. Repeated rows are copies of each other, and rows of one id are kept or not by their
    own text's component. An empty table gives an empty table; other columns are not read.

    Copies meet first, so a text that a third of the corpus holds goes on as one row. Each bucket gives a row a text, by
    sorted partitions that stream, however many texts share it. Links are confirmed on full sets, in tasks of at most two
    blocks of block_texts texts: `stars` rounds of heads against their buckets, then, for buckets whose other texts still
    lie in several components, all against all. Tasks return what connects, never all links.
    """
    kind = docs.schema["doc_id"].dataType
    as_id = lambda c: F.when(c != NULL_ID, c).cast(kind)
    component = F.coalesce("class.did", "did")
    return classes(docs, percent, width, stars, block_shingles, block_texts).select(
        as_id(F.col("did")).alias("doc_id"), F.col("n").alias("n_shingles"), as_id(component).alias("component_id"), (component == F.col("did")).alias("kept")
    )


def kept(docs: DataFrame, percent: int = 80, width: int = 4, stars: int = 3, block_shingles: int = 250_000, block_texts: int = 500) -> DataFrame:
    """docs, all columns, without the documents whose component has a smaller doc_id. Rows of one id stay if any of them is
    its component's least; null ids are the largest."""
    found = classes(docs, percent, width, stars, block_shingles, block_texts)
    own = found.where(F.coalesce("class.did", "did") == F.col("did")).select(F.col("did").alias("__ms_did")).distinct()
    return docs.withColumn("__ms_did", id_key()).join(own, "__ms_did", "left_semi").drop("__ms_did").select(*docs.columns)
