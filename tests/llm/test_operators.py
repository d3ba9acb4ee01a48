"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with the operators' own names."""

import hashlib
import html as html_lib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from memspark.llm import decontam, filter_audit, html_main, line_dedup, merkle, ngram_join, oph_dedup, packing, quality_bt, toxic_cnn, url_cascade, warc, weak_rules
from memspark.llm.common import tokenizer_path
from memspark.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, c0 int, votes int, bitmap int, did int, spans int"
LONG = " ".join(f"word{i % 977} of" for i in range(60_000))
SAME = "One shared line of text here.\nAnother line that is long enough, too."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, 5) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, "   \n \t\n"), (4, SAME), (5, SAME), (5, SAME), (None, SAME), (7, LONG), (8, "a"), (9, "ünï çödé 𝒳 " * 30), (10, "\u0000\u000b\u001c x"), (-3, "negative id line of text"), (11, SAME.upper() + "\nnew")]


@pytest.fixture(scope="module")
def edges(spark):
    return docs(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


# Quality rules (7)


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rules_measure_as_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    for text in [*(r.text for r in rows), *(t for _, t in EDGES), "a b c a b c", "x " * 9]:
        assert weak_rules.measure(text)[0] == base_of(text)


def test_rules_edges(edges, nothing):
    found = weak_rules.judge(edges).collect()
    assert len(found) == len(EDGES)
    for r in found:
        if r.n_words < 50:
            assert r.base_failed and not r.kept
    assert weak_rules.judge(nothing).collect() == []
    kept = weak_rules.kept(edges)
    assert kept.columns == edges.columns


def test_rules_keep_good_and_reject_bad(spark, data):
    found = {r.doc_id: r for r in weak_rules.judge(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    good = [found[r.doc_id] for r in labels if r.quality == 1 and not found[r.doc_id].base_failed]
    bad = [found[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in bad]) < 0.1


def em_of(votes, rounds=500, strength=50):
    """EM document by document, in plain loops: log posterior odds of "good" for each."""
    rules, kinds = list(weak_rules.RULES), list(weak_rules.KINDS.values())
    belief = [{r: (0.01, 0.12, 0.87) for r in rules}]
    belief += [{r: (0.6, 0.15, 0.25) if r in own else (0.02, 0.13, 0.85) for r in rules} for own in kinds]
    shares = [0.8] + [0.2 / len(kinds)] * len(kinds)
    chance, share, before = [dict(b) for b in belief], list(shares), None
    for _ in range(rounds):
        post = []
        for v in votes:
            p = [s * math.prod(c[r][x + 1] for r, x in zip(rules, v)) for s, c in zip(share, chance)]
            post.append([x / sum(p) for x in p])
        now = [p[0] for p in post]
        if before and max(abs(x - y) for x, y in zip(now, before)) < 1e-9:
            break
        before = now
        for k in range(len(belief)):
            for i, r in enumerate(rules):
                seen = [strength * x for x in belief[k][r]]
                for p, v in zip(post, votes):
                    seen[v[i] + 1] += p[k]
                chance[k][r] = tuple(x / sum(seen) for x in seen)
        share = [sum(p[k] for p in post) + strength * s for k, s in enumerate(shares)]
        share = [s / sum(share) for s in share]
    return before or []


def test_rules_verdict_as_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = table.collect()
    votes = [weak_rules.measure(r.text)[1] for r in rows]
    want = {r.doc_id: p for r, p in zip(rows, em_of(votes), strict=True)}
    base = {r.doc_id: base_of(r.text) for r in rows}
    for r in weak_rules.judge(table).collect():
        n, repeats = base[r.doc_id][0], base[r.doc_id][4]
        assert abs(r.posterior - want[r.doc_id]) < 1e-6
        assert r.kept == (not (n < 50 or 100 * repeats > 50 * n) and want[r.doc_id] >= 0.5)


def test_one_vote_against_can_be_overruled(spark):
    """Texts in capitals have one vote against them, which the other rules of its kind don't second."""
    draw = random.Random(9)
    line = lambda n=9: " ".join("".join(draw.choices("aeioulnrst", k=draw.randint(3, 8))) for _ in range(n)).capitalize() + "."
    fine = ["\n".join(line() for _ in range(12)) for _ in range(60)]
    lists = ["\n".join(" | ".join(line(1)[:-1] for _ in range(6)) + " ###" for _ in range(12)) for _ in range(12)]
    echo = ["\n".join([line(3)] * 12 + [line(3)] * 10) for _ in range(12)]
    loud = ["\n".join(line() for _ in range(12)).upper() for _ in range(2)]
    texts = [*fine, *lists, *echo, *loud]
    found = {r.doc_id: r for r in weak_rules.judge(docs(spark, list(enumerate(texts)))).collect()}
    assert all(found[i].kept for i in range(60))
    assert not any(found[i].posterior >= 0.5 for i in range(60, 84))
    overruled = [found[i] for i in range(84, 86)]
    assert all(r.votes.count("0") == 1 and r.posterior > 0.5 and r.kept for r in overruled)


def test_em_without_documents_and_with_one_pattern():
    n = len(weak_rules.RULES)
    good, share, _ = weak_rules.fit_votes(np.zeros((0, n), int), np.zeros(0))
    assert len(good) == 0 and abs(share.sum() - 1) < 1e-9
    votes = np.ones((3, n), int)
    votes[1, :2] = -1
    votes[2, 0] = -1
    good, _, conditional = weak_rules.fit_votes(votes, np.array([3.0, 1.0, 1.0]))
    assert good[0] > good[2] > 0.5 > 0.2 > good[1]
    assert np.allclose(conditional.sum(axis=2), 1)


# Line dedup (4)


def lines_of(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    first = {}
    order = lambda i: (1, 0) if i is None else (0, i)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= least:
                first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_edges(edges, nothing):
    assert Counter(map(tuple, line_dedup.line_digest(edges).collect())) == lines_of(EDGES)
    assert line_dedup.line_digest(nothing).collect() == []
    out = line_dedup.deduplicated(edges)
    assert out.columns == edges.columns and out.count() == len(EDGES)


def test_line_dedup_hot_line_spreads_over_partitions(spark):
    """A line in every document fills many range partitions; only the least id keeps it."""
    rows = [(i, f"the same long line everywhere\nown line number {i} of its document") for i in range(4000, 0, -1)]
    assert Counter(map(tuple, line_dedup.line_digest(docs(spark, rows).repartition(7)).collect())) == lines_of(rows)


def test_bitmaps_round_trip():
    bits = np.array([True, False, True] * 5)
    packed = zlib.compress(np.packbits(np.concatenate([bits, [True]])).tobytes())
    assert (line_dedup.unpack(packed, 15) == bits).all()
    assert line_dedup.unpack(None, 3).all() and line_dedup.unpack(packed, 30)[15:].all()


# Near duplicates (3)


def near_of(rows, threshold=0.8):
    sets = [set(ngram_join.shingles(t).tolist()) for _, t in rows]
    n = len(rows)
    links = defaultdict(set)
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-6:
                links[i].add(j), links[j].add(i)
    group = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        group[i] = min((rows[k][0] is None, rows[k][0] or 0) for k in seen)
    return Counter((rows[i][0], None if group[i][0] else group[i][1], len(links[i])) for i in range(n))


def variants(base, n, seed, edits):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"w{draw.random()}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [6, 1000])
def test_near_duplicates_as_brute_force(spark, block):
    base = [" ".join(f"t{k}x{i * (k + 3) % 91}" for i in range(80 + 30 * k)) for k in range(4)]
    texts = [v for k, b in enumerate(base) for v in variants(b, 30, k, 4)] + ["few words", "few words", "", None]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, base[0]), (1, texts[0])]
    found = ngram_join.near_duplicates(docs(spark, rows), block_texts=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == near_of(rows)


def test_near_duplicates_edges(edges, nothing):
    found = ngram_join.near_duplicates(edges).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == near_of(EDGES)
    assert ngram_join.near_duplicates(nothing).collect() == []
    kept = ngram_join.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.where("text like 'One shared%'").collect()) == [4]


def test_one_of_each_class_whatever_the_ids(spark):
    base = [" ".join(f"t{k}x{i * (k + 3) % 91}" for i in range(80)) for k in range(6)]
    near = [f"{b} end" for b in base]
    rows = [(None, base[0]), (None, base[1]), (None, near[1]), (None, base[2]), (None, base[2]), (None, "!"), (None, "?")]
    rows += [(7, base[3]), (7, base[4]), (7, near[4]), (3, near[0]), (9, base[5]), (9, base[5]), (9, None), (9, None)]
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs(spark, rows)).collect())
    assert sum(kept.values()) == len(kept) == 9
    assert set(kept) >= {(None, base[2]), (None, "!"), (None, "?"), (7, base[3]), (3, near[0]), (9, base[5]), (9, None)}
    assert (None, base[0]) not in kept and ((None, base[1]) in kept) != ((None, near[1]) in kept)
    assert ((7, base[4]) in kept) != ((7, near[4]) in kept)


def test_chains_are_verified_run_by_run(spark):
    """Each text is like the next alone, so a component of 500 texts has few links; all against all would move more texts."""
    rows = [(i, " ".join(f"w{k}" for k in range(4 * i, 4 * i + 60))) for i in range(500)]
    table = docs(spark, rows)
    found = ngram_join.near_duplicates(table, block_texts=10).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == near_of(rows)
    members = spark.createDataFrame([(i, 0, 50) for i in range(500)], "id long, root long, n long")
    runs = spark.createDataFrame([(i, t, i - i % 2) for i in range(500) for t in range(6) if i % 2], "id long, tree int, head long")
    places = ngram_join.assigned(members, runs, 10_000, 10).collect()
    assert len(places) == 500 and all(len(r.places) == 6 and {p.tree for p in r.places} == set(range(6)) for r in places)
    places = ngram_join.assigned(members, runs, 10_000, 200).collect()
    assert all([p.tree for p in r.places] == [-1] for r in places)


@pytest.mark.parametrize("partitions", [2, 40])
def test_runs_as_brute_force(spark, partitions):
    """Signatures of few values: runs of every depth that span many partitions, and partitions that hold many runs."""
    draw = np.random.default_rng(8)
    sigs = draw.integers(0, 2, (300, ngram_join.TREES * ngram_join.DEPTH)).astype("<u2")
    sigs[::3] = sigs[0]
    texts = spark.createDataFrame([(int(i) * 7 - 900, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "id long, sig binary").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = ngram_join.matched(texts, 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for depth in range(5, ngram_join.DEPTH + 1):
        shortest = {}
        for r in rows:
            if r.depth >= depth:
                shortest[r.id, r.tree] = min(shortest.get((r.id, r.tree), (99, 0)), (r.depth, r.head))
        found, want = defaultdict(set), defaultdict(set)
        for (i, t), (_, head) in shortest.items():
            found[t, head] |= {i, head}
        for i, x in enumerate(sigs):
            for t in range(ngram_join.TREES):
                want[t, x[t * ngram_join.DEPTH :][:depth].tobytes()].add(i * 7 - 900)
        assert sorted((t, sorted(m)) for (t, _), m in found.items()) == sorted((t, sorted(m)) for (t, _), m in want.items() if len(m) > 1)


def test_prefixes_shorten_until_the_recall():
    depth = ngram_join.prefix_depth(0.8, 0.999)
    assert ngram_join.recall(0.8, depth) >= 0.999 > ngram_join.recall(0.8, depth + 1)
    assert ngram_join.prefix_depth(0.3, 0.999) == 1
    full = ngram_join.DEPTH
    assert ngram_join.shortened([], 0.8, 0.999)[0] == depth  # nothing found: what the threshold asks for
    assert ngram_join.shortened([(full, 0.97, 50)], 0.8, 0.999)[0] == depth  # too few to go by
    close, estimates = ngram_join.shortened([(full, 0.97, 1_000_000)], 0.8, 0.999)
    assert close == full and estimates[full] > 0.999
    mixed, estimates = ngram_join.shortened([(full, 0.97, 1_000_000), (full, 0.81, 500_000)], 0.8, 0.999)
    assert depth <= mixed < full and estimates[full] < 0.999 <= estimates[mixed]


# Decontamination (6)


def hits_of(rows, items, window=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    held, sizes = defaultdict(set), set()
    for name, t in items:
        ws = cut(t)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            held[tuple(ws[i : i + n])].add(name if name is None else str(name))
            sizes.add(n)
    out = []
    for i, t in rows:
        ws, hit, ids = cut(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if names := held.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= names
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [(1, SAME), (2, "word3 of word4 of word5 of word6 of word7 of word8"), (3, None), (4, "..."), (20, "Negative-ID"), (3, "word3 OF word4"), (None, SAME), (None, "word9 of")]


@pytest.mark.parametrize("block", [64 << 20, 40])
def test_decontamination_as_brute_force(spark, edges, nothing, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.matches(edges, items, block_bytes=block)
    assert sorted(r.n_words for r in found.collect()) == sorted(len(decontam.words_of(t)) for _, t in EDGES)
    rows = decontam.contamination(edges, items).collect()
    assert Counter(tuple(r)[:6] for r in rows) == hits_of(EDGES, ITEMS)
    spans = Counter((r.doc_id, tuple(r.spans)) for r in found.collect())
    assert spans == Counter((r.doc_id, tuple(r.spans)) for r in decontam.matches(edges, items).collect())
    assert decontam.contamination(nothing, items).collect() == []
    none = decontam.contamination(edges, items.limit(0)).collect()
    assert len(none) == len(EDGES) and not any(r.contaminated for r in none)
    assert decontam.decontaminated(edges, items).columns == edges.columns


def test_longest_matches():
    tests = decontam.TestSet.of([("x", "a b c d e f")], 3)
    n, spans, items, longest, at = decontam.match_shard(["z a b c q b c d e f a b"], tests)[0]
    assert (n, spans, items, longest, at) == (12, [1, 4, 5, 10], [0], 5, 5)


def test_matches_as_brute_force():
    draw = random.Random(6)
    for seed in range(30):
        word = lambda: f"w{draw.randrange(4)}"
        items = [(str(k), " ".join(word() for _ in range(draw.randint(1, 9)))) for k in range(6)]
        texts = [" ".join(word() for _ in range(draw.randint(0, 60))) for _ in range(5)]
        found = decontam.match_shard(texts, decontam.TestSet.of(items, 4))
        for text, (n, spans, ids, longest, at) in zip(texts, found, strict=True):
            _, words, hits, n_items, _, _ = next(iter(hits_of([(0, text)], items, 4)))
            assert (n, sum(spans[1::2]) - sum(spans[::2]), len(ids)) == (words, hits, n_items)
            ws, best = text.split(), (0, 0)
            for _, item in items:
                x = item.split()
                for i in range(len(ws)):
                    for j in range(len(x)):
                        k = 0
                        while i + k < len(ws) and j + k < len(x) and ws[i + k] == x[j + k]:
                            k += 1
                        if k >= min(4, len(x)):
                            best = max(best, (k, -i))
            assert (longest, at) == (best[0], -best[1] if best[0] else None)


def test_long_copied_item_takes_linear_work():
    import time

    text = " ".join(f"w{i % 1009}" for i in range(60_000))
    start = time.perf_counter()
    found = decontam.match_shard([text, "none"], decontam.TestSet.of([("x", text)], 10))
    assert found[0][1] == [0, 60_000] and found[0][3:] == (60_000, 0)
    assert time.perf_counter() - start < 60


def test_suffix_array_sorts_suffixes():
    text = np.array([3, 1, 2, 3, 1, 2, 0, 3, 1])
    order = decontam.suffix_array(text, 9)
    assert order.tolist() == sorted(range(9), key=lambda i: text[i:].tolist())


# Packing (9)


def test_packing_round_trip(spark, edges, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    whole = Counter()
    for i, t in EDGES:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            whole[i, k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    rows = packing.packed(edges, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == whole
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by) == -(-total // 4096)
    assert packing.packed(nothing, path).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_all_pieces(seed):
    draw = random.Random(seed)
    capacity = draw.choice([4096, 50, 13])
    counts = Counter(min(capacity, max(1, int(draw.lognormvariate(np.log(capacity / 6), 1)))) for _ in range(draw.randint(0, 3000)))
    placed = Counter()
    patterns = packing.plan(counts, capacity)
    for bins in patterns:
        assert bins.count > 0 and bins.gap >= 0 and sum(n * k for n, k in bins.runs) + bins.gap == capacity
        assert sum(k for n, k in bins.runs if 3 * n > capacity) <= 2
        for n, k in bins.runs:
            placed[n] += k * bins.count
    assert placed == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(b.count for b in patterns) <= 1.1 * (total / capacity) + sum(c for n, c in counts.items() if 2 * n > capacity) * 0.2 + 2


def test_words_encode_as_texts_do():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path)
    draw = random.Random(4)
    letters = list("aA'sﬁé́Σς<|>endoftext 12\n\t　 .,!?-_ßİẞ한가")
    texts = ["<|endoftext|> a", "I'LL don't", *("".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(3000))]
    for got, e in zip(own.encode(texts), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == np.array(e.ids, dtype="<u4").tobytes()


# URLs (2)


def verdict_of(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "://x", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/70", "https://com/en/", "http://x.com/en/1", "http://xcom/en/1", "http://net/de/", "http://b.example.net/de/8", "http://c.net/de/8/", "http://o.org/es/#", "http://o.org?/es/", "http://é.com/en/ü", "http://" + "a." * 20_000 + "com/en/", "http://.com/en/", "http://com//en/"]


def test_urls_as_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, html string, verdict int")
    rows = url_cascade.url_verdicts(pages, URL_RULES).collect()
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in rows) == Counter(map(verdict_of, [*URLS, URLS[5]]))
    assert url_cascade.url_verdicts(pages.limit(0), URL_RULES).collect() == []


def test_cascades_are_exact(spark):
    draw = random.Random(1)
    keys = [f"k{draw.random()}" for _ in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[:700]], "key string")
    cascade = url_cascade.build_cascade(spark.createDataFrame([(k,) for k in keys], "key string"), listed, 40, 5)
    assert len(cascade.levels) > 2
    assert [k in cascade for k in keys] == [True] * 700 + [False] * 2300


def test_filters_come_in_blocks(spark):
    """A filter of several blocks holds each key's places and no others; one beyond the limit is refused."""
    keys = [f"host{i}.com/path{i % 7}/" for i in range(30_000)]
    bloom = url_cascade.build_bloom(spark.createDataFrame([(k,) for k in keys], "key string").repartition(3), len(keys), 1e-9, 3)
    want = np.zeros(len(bloom.data), dtype=np.uint8)
    for p in (p for k in keys for p in bloom.places(k)):
        want[p >> 3] |= 1 << (p & 7)
    assert len(bloom.data) > 2 * 4 * url_cascade.BLOCK and (bloom.data == want).all()
    with pytest.raises(ValueError):
        url_cascade.build_bloom(spark.createDataFrame([], "key string"), 2**31, 0.5, 1)


# HTML (5)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = {
    "<nav>menu</nav><article><h1>Head &amp; more</h1><p><b>One<br>two <p>th<i>r</i>ee</article><footer>f</footer>": "Head & more One two three",
    "<header>top</header><div class='sidebar'>s</div><article><p>a</p><div class='ad'>x</div><ul><li>b<li>c</ul></article>": "a b c",
    "<main><p>kept</p><aside>no</aside><form><p>f</p></form><section id=comments><p>c</p></section></main>": "kept",
    "<p>plain\n  text</p><script>var a='<p>';</script><p>more &lt;b&gt; &#233;&nbsp;x</p>": "plain text more <b> é x",
    "<article><p title='a>b'>q</p><!-- <p>no</p> --><p hidden>h</p></article><article class='comment'><p>r</p></article>": "q",
    "<article><table><tr><td>1<td>2<tr><td>3</table><pre> p\n q </pre></article>": "1 2 3 p q",
    "<div class='cookie-notice'>c</div><p>x": "x",
    "": "",
}


def test_html_cases():
    for body, text in CASES.items():
        assert html_main.gather(html_main.parse(page(body))) == text, body
    for broken in ("<", "<p", "<!--", "</", "<a b='", "<p>" * 3000, "&#xD800;", "<script>", "\x00<p>\x00"):
        html_main.gather(html_main.parse(broken))


NAMED = {
    "<div class='page no-sidebar'><main><p>kept</p></main></div>": "kept",
    "<div class='sidebar'><main><p>kept</p></main><p>no</p></div>": "kept",
    "<div id=search><div class='ad'>x</div><article><p>kept</p></article></div>": "kept",
    "<div class='menu-open with-header'><p>kept</p></div>": "kept",
    "<div class='widget'><div role=\"main\" class='search'><p>kept</p></div></div>": "kept",
    "<article><section id='related-work'><p>a</p></section><p class='notice'>b</p><div class='social'>c</div><p id=search>d</p><div class='ads'>x</div></article>": "a b c d",
    "<main><p class=notice>a</p><div class='share'>x</div></main>": "a",
    "<main><article class='no-comments'><p>a</p></article><div class='sidebar'>x</div></main>": "a",
    "<article><p>a</p></article><div class='related'><article><p>teaser</p></article></div>": "a",
    "<div><p>the text of this page</p></div><div class='related'><article><p>teaser</p></article></div>": "the text of this page teaser",
    "<div class='page-header'>x</div><div id='ad-12'>x</div><p>a</p>": "a",
}


def test_names_drop_no_article():
    for body, text in NAMED.items():
        assert html_main.gather(html_main.parse(page(body))) == text, body


def test_templates_recur_on_their_host(spark):
    rows = [(i, f"http://h.com/{i}", page(f"<div><div>site line</div></div><div><p>own text {i}</p><p>shared words</p></div>")) for i in range(9)]
    rows += [(20 + i, "http://g.com/", page("<div><p>copy of a page</p></div>")) for i in range(5)]
    rows += [(30, "http://one.com/", page("<div><div>site line</div></div>")), (31, None, None), (32, "x", "")]
    rows += [(40 + i, f"http://k.com/{i}", page(f"<article><p>text {i} of it, which is long</p><div>follow us</div><p>said twice</p></article>")) for i in range(4)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    for limit in (200_000, 0):
        found = {r.page_id: r.text for r in html_main.main_text(pages, broadcast_rows=limit).collect()}
        assert len(found) == len(rows)
        assert found[3] == "own text 3" and found[20] == "copy of a page" and found[30] == "site line" and found[31] == found[32] == ""
        assert found[41] == "text 1 of it, which is long said twice"
    assert html_main.main_text(pages.limit(0)).collect() == []


def test_templates_take_a_share_of_the_host(spark):
    own = lambda i: f"<p>headline {i}, of this page alone, and some more of its own</p>"
    quote, block = "<div><span>quoted text</span></div>", "<div><div>first half of it,</div><div>second half of it</div></div>"
    rows = [(i, "http://h.com/", page(own(i) + (quote if i < 3 else "") + "<div>site line</div>")) for i in range(20)]
    rows += [(30 + i, "http://b.com/", page(f"<p>day {i}</p>{block}")) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (200_000, 0):
        found = {r.page_id: r.text for r in html_main.main_text(pages, broadcast_rows=limit).collect()}
        assert found[1] == "headline 1, of this page alone, and some more of its own quoted text"
        assert found[9] == "headline 9, of this page alone, and some more of its own"
        assert found[31] == "day 1 first half of it, second half of it"


def test_articles_keep_what_names_might_mean():
    for inner, text in {
        '<pre>x = 1 <span class="comment"># note</span></pre>': "x = 1 # note",
        '<p>a <span class="skip">b</span></p>': "a b",
        '<div class="related-work"><p>a</p></div>': "a",
        '<section class="search-algorithms"><p>a</p></section>': "a",
        '<div class="social-history">a</div>': "a",
        "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>": "so x = 1",
        '<pre><div class="comments">a</div></pre>': "a",
    }.items():
        assert html_main.gather(html_main.parse(page(f"<article>{inner}</article>"))) == text, inner


ONE_OFF = ['<div class="notice">n</div>', '<div class="comments"><p>c</p></div>', '<section id="comments"><p>s</p></section>',
           '<div class="sidebar">b</div>', '<div class="ad">a</div>', '<div class="cookie-notice">k</div>']


@pytest.mark.parametrize("size", [1, 4, 6, 40])
def test_one_rule_on_hosts_of_every_size(spark, size):
    """What one page alone has beside its article goes by its name, and stays without one, however many pages the host has."""
    article = lambda i: f"<article><h1>Head {i}</h1><p>text {i}, all of its own</p><div class='respond'>He will respond {i}.</div></article>"
    lead = lambda i: f"<section><p>lead {i} of the page</p></section>"
    menu = "<div><a href='/'>start</a> <a href='/x'>other</a></div>"
    rows, want = [], {}
    for k, block in enumerate([*ONE_OFF, lead(0), ""]):
        for i in range(size):
            own = block if i == 0 else ""
            rows.append((100 * k + i, f"http://h{k}.com/{i}", page(f"{menu}{own}{article(i)}")))
            kept = f"lead {i} of the page " if own.startswith("<section><p>") else ""
            want[100 * k + i] = f"{'' if size >= 4 else 'start other '}{kept}Head {i} text {i}, all of its own He will respond {i}."
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (200_000, 0):
        assert {r.page_id: r.text for r in html_main.main_text(pages, broadcast_rows=limit).collect()} == want


def test_templates_carry_pages_without_articles(spark):
    """Pages of plain divs: what recurs goes, and without templates it stays."""
    draw = random.Random(12)
    words = lambda n: " ".join("".join(draw.choices("aeioulnrst", k=5)) for _ in range(n))
    menu, foot = f"<div class='qq'><a>{words(3)}</a></div>", f"<div>{words(6)}</div>"
    rows, want = [], {}
    for i in range(12):
        want[i] = f"{words(5)} {words(40)}"
        head, body = want[i].split()[:5], want[i].split()[5:]
        rows.append((i, "http://p.com/", page(f"{menu}<div><div>{' '.join(head)}</div><div>{' '.join(body)}</div></div><div class='ad'>{words(4)}</div>{foot}")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.main_text(pages).collect()} == want
    assert all(html_main.gather(html_main.parse(h)) != want[i] for i, _, h in rows)


def test_templates_of_shape_carry_the_result(spark):
    """Names that no list holds, and words that change from page to page: shapes beside the articles tell."""
    draw = random.Random(5)
    words = lambda n: " ".join("".join(draw.choices("aeioulnrst", k=5)) for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        own = [words(30) for _ in range(draw.randint(2, 5))]
        links = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(draw.randint(2, 6)))
        said = "".join(f"<div class='zz'><p>{words(6)}</p></div>" for _ in range(draw.randint(0, 3)))
        body = f"<div class='qx'><ul>{links}</ul></div><div id='w{i}'>{words(5)}</div><article>{''.join(f'<p>{x}</p>' for x in own[1:])}<div class='zz'><p>{own[0]}</p></div></article>"
        rows.append((i, "http://h.com/", page(f"{body}<div class='yy'>{said}</div><div>{words(3)} once</div>")))
        want[i] = " ".join([*own[1:], own[0]])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (200_000, 0):
        found = {r.page_id: r.text for r in html_main.main_text(pages, broadcast_rows=limit).collect()}
        assert all(found[i].startswith(want[i]) and found[i].endswith("once") and len(found[i].split()) == len(want[i].split()) + 4 for i in want)
    off = html_main.gather(html_main.parse(rows[0][2]))
    assert len(off.split()) > len(found[0].split()) + 5


def test_html_takes_time_in_proportion():
    import time

    n = 80_000
    for broken in ("<b>" * n + "</i>" * n, "<b>" * n + "<p>x</p>" * n, "<ul><li><ul>" + "<b>" * n + "<li>x" * n, "<div>x" * n, "<article>x" * n,
                   "<div class=comment><article>" * n + "x", "<table>" + "<tr><td>" * n, "<b>x" * n + "<main>" * 100):
        start = time.perf_counter()
        found = html_main.parse(broken)
        html_main.subtree_rows("h", found)
        html_main.gather(found, frozenset({found.hashes[-1]}))
        assert time.perf_counter() - start < 20, broken[:30]
    start = time.perf_counter()
    html_main.parse("<b>" * 8000 + "</i>" * n)
    assert time.perf_counter() - start < 1


def test_html_on_the_tables(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_main.main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1].replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html_lib.unescape(re.sub("<[^<>]*>", " ", inner)).split()) and r.n_chars == len(r.text)


# WARC (8)


def test_warc_round_trip(spark):
    big = "payload é " * 200
    htmls = [None, "", "small", "small", big, big, big, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50, "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n", LONG]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: 1" if i % 2 else None, h, "z") for i, h in enumerate(htmls)], "page_id long, url string, html string, record_type string")
    last = {}
    for i, h in enumerate(htmls):
        last[h or ""] = i
    expected = set()
    for i, h in enumerate(htmls):
        raw = (h or "").encode()
        again = len(raw) >= 1000 and last[h or ""] != i
        expected.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None))
    rows = warc.archive_round_trip(pages.repartition(3)).collect()
    assert {tuple(r) for r in rows} == expected and len(rows) == len(htmls)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_warc_null_ids_and_settings(spark):
    before = spark.conf.get(warc.PUSHDOWN, None)
    rows = [(None, None, "p" * 2000), (None, "u", "p" * 2000), (4, "u", "p" * 2000), (4, "u", "p" * 2000), (None, "u", "q" * 2000), (None, "u", "q" * 2000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert found == Counter({(None, 2000, "revisit", 4): 2, (4, 2000, "response", None): 2, (None, 2000, "response", None): 2, (None, 0, "response", None): 1})
    assert spark.conf.get(warc.PUSHDOWN, None) == before


def test_warc_predicates_skip_payloads(spark, tmp_path):
    noise = [random.Random(i).randbytes(40_000).hex() for i in range(30)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", noise[i] if i < 30 else noise[0]) for i in range(40)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages.coalesce(1), path)
    with warc.pushing_filters(spark):
        found = warc.read_archive(spark, path).where("record_type = 'revisit' and target_uri in ('http://h/0', 'http://h/2')")
        assert [(r.target_uri, r.refers_to, r.payload) for r in found.collect()] == [("http://h/0", "<urn:page:39>", bytearray())]
    assert all(r.payload is None for r in warc.read_archive(spark, path, payload=False).collect())
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.FilteredReader({"path": path})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert reader.wanted == {"record_type": {"revisit"}} and len(left) == 1
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 10 and reader.inflated < 40 * 5000 < 30 * 80_000  # some of each member, not the refused payloads
    whole = warc.WarcReader({"path": path})
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 40 and whole.inflated > 30 * 80_000


def test_warc_files_split_and_uncommitted_ones_are_not_read(spark, tmp_path):
    import gzip

    writer = warc.WarcWriter({"path": str(tmp_path / "b"), "split": "3000", "largest": "20000"})
    rows = [("response", f"<urn:page:{i}>", None, None, None, None, random.Random(i).randbytes(700 * (i % 3))) for i in range(60)]
    lost = writer.write([warc.batch(rows[:5])])
    writer.commit([writer.write([warc.batch(rows[:30]), warc.batch(rows[30:])]), writer.write([]), None])
    reader = warc.WarcReader({"path": str(tmp_path / "b")})
    parts = reader.partitions()
    found = [tuple(r) for p in parts for b in reader.read(p) for r in zip(*(b.column(c).to_pylist() for c in ("record_id", "payload")), strict=True)]
    assert len(parts) > 5 and Counter(found) == Counter((r[1], r[6]) for r in rows)
    writer.abort([lost])
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "b").glob("*.gz"))
    for name, data in (("plain.warc", raw), ("whole.warc.gz", gzip.compress(raw))):  # archives of others
        (tmp_path / name).write_bytes(data)
        reader = warc.WarcReader({"path": str(tmp_path / name)})
        found = [r for p in reader.partitions() for b in reader.read(p) for r in b.column("payload").to_pylist()]
        assert Counter(found) == Counter(r[6] for r in rows)
        reader = warc.WarcReader({"path": str(tmp_path / name), "payload": "false"})
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 60


# Classifiers (1, 10)


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, name):
    from pathlib import Path

    path = "/root/testdata/sf0.1" if Path("/root/testdata/sf0.1").is_dir() else None
    if path is None:
        pytest.skip("no test tables")
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    found = (quality_bt.quality_scores if name == "quality" else toxic_cnn.toxicity_scores)(table, labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    right = {v: np.mean([r.predicted == v for r in rows if r[name] == v]) for v in (0, 1)}
    assert right[0] > (0.95 if name == "quality" else 0.97) and right[1] > (0.97 if name == "quality" else 0.85)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("f", [quality_bt.quality_scores, toxic_cnn.toxicity_scores])
def test_classifiers_edges(spark, edges, nothing, f):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (7, 1, 0), (8, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = f(edges, given).collect()
        assert len(rows) == len(EDGES)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert f(nothing, given).collect() == []


def test_quality_threshold_where_most_are_bad(spark):
    """Nine documents of ten are lists of marks: the cut lies at the 0.9 quantile or so."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("aeioulnrst", k=draw.randint(3, 8)))
    text = lambda good: " ".join(word() + ("." if good and k % 9 == 8 else "" if good or draw.random() < 0.5 else "###") for k in range(90))
    rows = [(i, text(i % 10 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int")
    found = quality_bt.quality_scores(docs(spark, rows), labels).collect()
    assert all(r.predicted == (r.doc_id % 10 == 0) for r in found)
    assert all(0.85 < r.level < 0.95 for r in found)


def test_filters_carry_word_order(spark):
    """Only the order of two words, which all texts hold, tells the labels apart; untrained filters can't."""
    draw = random.Random(2)
    texts, y = [], []
    for i in range(600):
        ws = [f"w{draw.randrange(60)}".encode() for _ in range(30)]
        at = draw.randrange(0, 28)
        ws[at : at + 2] = (b"red", b"fox") if i % 2 else (b"fox", b"red")
        texts.append(ws), y.append(i % 2)
    y = np.array(y)
    features, ids = toxic_cnn.numbers(texts[:400])
    right = lambda m: np.mean((toxic_cnn.logits(m, texts[400:]) > 0) == (y[400:] == 1))
    assert right(toxic_cnn.train(features, ids, y[:400], least_steps=800)) > 0.95
    assert right(toxic_cnn.train(features, ids, y[:400], epochs=0)) < 0.7


def test_pooling_as_brute_force():
    draw = np.random.default_rng(1)
    model = toxic_cnn.Model(np.zeros((1, toxic_cnn.SIZE)), [draw.normal(size=(w, toxic_cnn.SIZE, toxic_cnn.FILTERS)) for w in toxic_cnn.WIDTHS],
                            [draw.normal(size=toxic_cnn.FILTERS) for _ in toxic_cnn.WIDTHS], np.zeros(1), 0.0)
    vectors = draw.normal(size=(50, toxic_cnn.SIZE))
    texts = [draw.integers(1, 50, n) for n in (0, 1, 2, 3, 400, 250_000, 7)]
    found = model.pooled(model.tables(vectors), texts)
    for ids, row in zip(texts, found, strict=True):
        want = []
        for f, shift in zip(model.filters, model.shifts, strict=True):
            windows = [sum(vectors[ids[k : len(ids) - len(f) + 1 + k]] @ f[k] for k in range(len(f))) + shift] if len(ids) >= len(f) else []
            want.append(np.maximum(windows[0].max(axis=0), 0) if windows else np.zeros(toxic_cnn.FILTERS))
        assert np.allclose(np.concatenate(want), row, atol=1e-4)


def test_held_out_rows_teach_nothing(spark):
    from memspark.llm.common import labelled_sample

    table = docs(spark, [(i, f"text {i}") for i in range(200)] + [(6, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = labelled_sample(table, labels, "quality", 40, 1000).collect()
    assert Counter(r.label for r in rows) == {0: 40, 1: 40}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


# MinHash near-dedup (11)


def copies_of(rows, percent=80, width=4):
    """(doc_id, shingles, component, kept) by comparing all pairs of rows."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        k = min(width, len(ws))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set())
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both) and top[i] != top[j]:
                old, new = top[i], top[j]
                top = [new if x == old else x for x in top]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {t: min(key(i) for i in range(len(rows)) if top[i] == t) for t in set(top)}
    return Counter((r[0], len(s), None if least[t][0] else least[t][1], least[t] == key(i)) for i, (r, s, t) in enumerate(zip(rows, sets, top, strict=True)))


@pytest.mark.parametrize(("stars", "block"), [(3, 500), (0, 7), (1, 5)])
def test_near_copies_as_brute_force(spark, stars, block):
    """Groups of copies of copies, so that buckets hold texts that their heads are not linked with."""
    draw = random.Random(6)
    rows = []
    for k in range(5):
        text = [f"t{k}x{i * (k + 3) % 91}" for i in range(60 + 25 * k)]
        for _ in range(25):
            other = draw.choice([r[1].split() for r in rows[-20:] if f"t{k}x1" in r[1]] or [text])[:]
            for _ in range(draw.randint(0, 3)):
                other[draw.randrange(len(other))] = f"w{draw.random()}"
            rows.append((draw.randint(0, 10**6), " ".join(other)))
    rows += [(1, "few words"), (2, "FEW\nwords"), (3, ""), (4, None), (None, rows[0][1]), (rows[5][0], rows[30][1])]
    found = oph_dedup.near_copies(docs(spark, rows), stars=stars, block_texts=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == copies_of(rows)


def test_near_copies_edges(spark, edges, nothing):
    found = oph_dedup.near_copies(edges).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == copies_of(EDGES)
    assert oph_dedup.near_copies(nothing).collect() == []
    kept = oph_dedup.kept(edges)
    assert kept.columns == edges.columns
    want = {i for i, _, _, k in copies_of(EDGES) if k}
    assert {r.doc_id for r in kept.collect()} == want and 4 in want and 5 not in want


def test_bins_borrow_from_their_donors():
    for n in (1, 2, 40, 4000):
        found = np.unique(ngram_join.mixed(np.arange(1, n + 1, dtype=np.uint64)))
        sig = oph_dedup.signature(found)
        least = {}
        for h in found.tolist():
            least.setdefault(h * oph_dedup.BINS >> 64, h)
        for b in range(oph_dedup.BINS):
            donor = b if b in least else next(d for d in oph_dedup.DONORS[b].tolist() if d in least)
            assert sig[b] == least[donor]


def test_stars_bound_what_is_compared(spark):
    """A bucket of 3 000 texts that all hang on their head costs a comparison a text, not a pair of texts each."""
    base = [f"x{i}" for i in range(400)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(3000)]
    table = docs(spark, rows)
    texts = oph_dedup.profiles(table.select("doc_id", "text"), 4).where("n > 0").withColumn("id", oph_dedup.F.monotonically_increasing_id())
    texts = oph_dedup.materialize(texts.withColumn("rep", oph_dedup.F.struct(*oph_dedup.KEY)), "t")
    runs = oph_dedup.later_in_run(oph_dedup.banded(texts), ["key"], "id", ["band"], "b").withColumnRenamed("least", "head")
    edges = oph_dedup.unjoined(runs, None)
    placed = oph_dedup.starred(edges, texts, 250_000, 500)
    places = sum(len(r.places) for r in placed.select("places").collect())
    assert edges.count() < 3000 * 4 and places < 3000 * 6
    found = oph_dedup.near_copies(table).collect()
    assert len(found) == 3000 and {r.component_id for r in found} == {0}


# Merkle manifest (12)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_of(rows):
    """rows: (doc_id, source, lang, n_chars, text). Trees as nested lists, proofs by walking them."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def tree(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
        return found

    def proof(levels, at):
        for nodes in levels[:-1]:
            run = nodes[at // 8 * 8 :][:8]
            yield run[: at % 8], run[at % 8 + 1 :]
            at //= 8

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is None, r[0] or 0, sha(*map(enc, r)), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for _, _, leaf, _ in sorted(langs[x], key=lambda y: y[:3])]) for x in order}
    top = tree([trees[x][-1][0] for x in order])
    out = Counter()
    for k, x in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(langs[x], key=lambda y: y[:3])):
            path = [*proof(trees[x], at), *proof(top, k)]
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            h = sha(*map(enc, (*r[:4], r[4].translate(low)))) if altered else leaf
            for before, after in path:
                h = sha(*before, h, *after)
            out[r[0], leaf, trees[x][-1][0], top[-1][0], sha(*(s for p in path for side in p for s in side)), h, h == top[-1][0], len(path)] += 1
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_levels"]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"": 2, None: 65, "é": 74, "z": 1, "a": 513}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_as_brute_force(spark, sizes):
    draw = random.Random(4)
    ids = draw.sample(range(-500, 5000), sum(sizes.values()))
    rows = []
    for lang, n in sizes.items():
        rows += [(ids.pop(), draw.choice(["web", None, ""]), lang, draw.choice([None, 7]), draw.choice([None, "", "Some TEXT ünï", "no capitals"])) for _ in range(n)]
    draw.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp int, h int, path int").repartition(3)
    assert Counter(tuple(r[c] for c in MANIFEST) for r in merkle.manifest(table).collect()) == manifest_of(rows)


def test_manifest_edges(edges, nothing):
    rows = [(i, None, None, None, t) for i, t in EDGES]
    found = merkle.manifest(edges).collect()
    assert Counter(tuple(r[c] for c in MANIFEST) for r in found) == manifest_of(rows)
    assert any(not r.verified for r in found) and any(r.verified for r in found)
    assert merkle.manifest(nothing).collect() == []


# Filter audit (13)


def audit_of(rows, labels):
    """rows: (doc_id, lang, text); every order is run on every document."""
    from itertools import permutations

    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    failed = []
    for i, lang, t in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        of = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        of["E"] = t in least and (i is None or least[t] < i)
        failed.append((lang or "", of, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        shares = Counter()
        for order in permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            for step, k in enumerate(order, 1):
                gone = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                every = [f for f in failed if f[0] == part and f[1][k]]
                alone = [f for f in every if sum(f[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), len(alone), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shares[k] += len(gone)
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shares[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_as_brute_force(spark, data):
    draw = random.Random(2)
    many = " ".join(f"w{i}" for i in range(120))
    texts = [many, many + " #", " ".join(["same"] * 130), many.upper(), "SHORT", "", None, "a | b", "few words", *(f"{many} {k}" for k in range(20))]
    rows = [(draw.choice([None, *range(40)]), draw.choice(["en", "de", None, ""]), draw.choice(texts)) for _ in range(300)]
    labels = [(draw.choice([None, *range(40)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(50)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, lang string, text string, count int, part int").repartition(3)
    known = spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, did int")
    found = filter_audit.audit(table, known).collect()
    names = ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert len(found) == 120 * 5 * 3 and {tuple(r[c] for c in names) for r in found} == audit_of(rows, labels)


def test_audit_edges(spark, edges, nothing):
    known = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", *filter_audit.COUNTS]
    found = {tuple(r[c] for c in names) for r in filter_audit.audit(edges, known.limit(0)).collect()}
    assert found == audit_of([(i, None, t) for i, t in EDGES], [])
    assert filter_audit.audit(nothing, known).collect() == []


def test_batches_are_cut_by_the_bytes_of_their_texts():
    import pyarrow as pa

    from memspark.llm import common

    texts = ["a" * 30, None, "é" * 20, "b" * 500, "", "c" * 10, "d" * 90, "e"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": texts})
    found = list(common.sliced([batch, batch.slice(0, 0)], "text", 100))
    assert [b.column("id").to_pylist() for b in found] == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert [t for b in common.sliced([batch.slice(2)], 1, 1) for t in b.column("text").to_pylist()] == texts[2:]


def test_texts_that_only_almost_match():
    """Runs of test words long enough for a window, and no window among them."""
    from memspark.llm import decontam

    tests = decontam.TestSet.of([("x", "one two three four")], 3)
    assert decontam.match_shard(["two one three two", None], tests) == [(4, [], [], 0, None), (0, [], [], 0, None)]
    assert decontam.match_shard(["a one two three"], tests) == [(4, [1, 4], [0], 3, 1)]
