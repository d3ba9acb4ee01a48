"""Propositions, subjects and claims that their text says."""

import tracemalloc

import pyarrow as pa
import pytest

from memspark.functions import language as lg
from memspark.sources import free_text as ft


def test_propositions_slice_their_text():
    text = "  One here.  Two?! v1.2 is out\nthree... ... and more "
    assert [text[a:b] for a, b in ft.segments(text)] == ["One here.", "Two?!", "v1.2 is out\nthree...", "and more"]
    assert ft.segments("...") == [] == ft.segments("") and ft.segments("word") == [(0, 4)]
    assert len(ft.segments("a. " * 200_000)) == 200_000


@pytest.mark.parametrize(
    ("said", "subject"),
    [("My sister Maria Lopez left.", "sister Maria Lopez"), ("The", "The"), ("the a cat", "a"), ("Ann's dog ran", "Ann's"), ("... !", ""), ("über Ann", "ber Ann"), ("a 3D Printer 2 works", "3D Printer")],
)
def test_leading_subjects(said, subject):
    assert ft.leading_subject(said) == subject


def test_records_hang_on_entities_of_their_text(spark):
    rows = [("n", "s", "a", "My friend Ann left. ANN and The Bob came! ..."), ("n", "s", "b", "Dora Lee: I went home. It rained."), ("n", "s", "c", None), ("n", "s", "d", "!!!")]
    found = ft.compiled(spark.createDataFrame(rows, "ns string, scope string, source_ref string, content string")).collect()
    by_ref = {r.document: r.text for r in found if r.kind == "PROV"}
    said = {}
    for r in found:
        said.setdefault(by_ref[r.document], {}).setdefault(r.kind, []).append(r)
    labels = {r.id: r.text for r in found if r.kind == "ENT"}
    assert {k: [labels[c.subject] for c in v.get("CLM", [])] for k, v in said.items()} == {"a": ["friend Ann", "Ann"], "b": ["Dora Lee", "Dora Lee"], "c": [], "d": []}
    assert sorted(r.text for r in said["a"]["ENT"]) == ["Ann", "Bob", "friend Ann"] and {r.kind for r in found if by_ref[r.document] in "cd"} == {"RAW", "PROV"}
    assert sorted(r.text for r in said["b"]["ENT"]) == ["Dora Lee"]
    raw = {r.document: r.text for r in found if r.kind == "RAW"}
    assert all(raw[r.document][r.start : r.end] == r.text for r in found if r.kind in ("SPAN", "CLM"))


CLAIMS = [
    (("ann", "LIKES", "green  tea"), "  Ann likes green\ttea a lot.", ["Ann", "likes", "green\ttea"]),
    (("likes", "Ann", "tea"), "Ann likes tea.", None),  # reordered
    (("Ann", "likes", "tea"), "Ann really likes tea.", None),  # scattered
    (("Ann", "likes", "tea"), "I know Ann likes tea.", None),  # does not open the proposition
    (("Ann", "likes", "tea"), "Ann likes teabags.", None),
    (("Ann", "likes", "tea"), "Ann likes tea?", None),
    (("Ann and Bob", "like", "tea"), "Ann and Bob like tea.", None),  # holds a word that parts clauses
    (("Ann", "said", '"tea"'), 'Ann said "tea".', None),
    (("Ann's dog", "likes", "tea"), "Ann's dog likes tea.", ["Ann's dog", "likes", "tea"]),
    (("Allegedly Ann", "likes", "tea"), "Allegedly Ann likes tea.", None),
    (("Ann", "likes", "tea"), "Ann\nlikes tea.", None),
    (("Ann", "likes", ""), "Ann likes tea.", None),
    (("a.b", "c*", "(d"), "a.b c* (d", None),  # a full stop parts clauses
    (("a+b", "c*", "(d"), "a+b c* (d", ["a+b", "c*", "(d"]),
    ((None, "x", "y"), "x y", None),
]


def test_claims_that_their_proposition_makes(spark):
    rows = spark.createDataFrame([(i, *parts, said) for i, (parts, said, _) in enumerate(CLAIMS)], "i int, a string, b string, c string, p string")
    for r in rows.select("i", "p", lg.grounded_claim("a", "b", "c", "p").alias("f")).collect():
        want = CLAIMS[r.i][2]
        spans = [r.f.subject, r.f.relation, r.f.object]
        assert [s and s.text for s in spans] == (want or [None] * 3), CLAIMS[r.i]
        assert all(s is None or r.p[s.start : s.end] == s.text for s in spans)


def test_no_pattern_is_made_for_a_claim(monkeypatch):
    def refused(*_):
        raise AssertionError("a pattern was compiled")

    monkeypatch.setattr(lg.re, "match", refused)
    assert [s and [x[2] for x in s] for s in (lg.claim_spans(*parts, said) for parts, said, _ in CLAIMS)] == [want for _, _, want in CLAIMS]
    same = [("STRA\u00dfE", "stra\u00dfe"), ("K", "\u212a"), ("s", "\u017f"), ("\u03a3", "\u03c2")]
    assert all(lg.claim_spans(a, "is", "go", f"{b} IS\tgo.") == [(0, len(b), b), (len(b) + 1, len(b) + 3, "IS"), (len(b) + 4, len(b) + 6, "go")] for a, b in same)
    assert lg.claim_spans("stra\u00dfe", "is", "go", "strasse is go") is None and lg.claim_spans("a b", "is", "go", "ab is go") is None


def test_objects_of_a_few_texts_are_held_at_a_time():
    texts = ["Ann met Bob. " * 4_000, None, "The dog. ", ""] * 40
    tracemalloc.start()
    found = ft.parsed.func(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in found] == [4_000, 0, 1, 0] * 40 and ft.propositions.func(pa.array(texts)) == pa.array([[p["text"] for p in x] for x in found.to_pylist()], pa.list_(pa.string()))
    assert found[2].as_py() == [{"start": 0, "end": 8, "text": "The dog.", "subject": "dog", "names": []}]
    assert peak < 60_000_000  # 48 MB; all 160 000 propositions as objects took 90 MB
