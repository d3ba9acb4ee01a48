"""What a question asks for, names in a text, and whether a phrase stands in its source."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The patterns of questions for whole sets and for inferences, and capitalised words that begin no name.
SET_NOUNS = "activities|books|emotions|events|exercises|facts|games|hobbies|items|names|people|places|reasons|sports|things|types|ways"
SET_NOUNS_WIDE = (
    "areas|artists|bands|children|cities|countries|dogs|foods|friends|goals|injuries|jobs|languages|movies|paintings|pets|plans|skills|songs|states|titles|trips"
)
SETS = [r"\b(?:all|both|each|every)\b", r"\bhow many\b", r"\b(?:list|enumerate|name)\b", rf"\b(?:which|what)\b.{{0,48}}\b(?:{SET_NOUNS})\b"]
SETS_WIDE = [*SETS, r"\b(?:what|which|who|where)\b[^?]{0,60}\bha(?:s|ve)\b", r"\b(?:names?|kinds?|types?|breeds?) of\b", rf"\b(?:which|what)\b.{{0,48}}\b(?:{SET_NOUNS_WIDE})\b"]
INFERENCES = [
    r"\b(?:infer|imply|likely|probably|suggests?)\b", r"\bwhat (?:kind|type) of\b", r"\bbased on (?:this|that|the conversation|what)\b", r"\b(?:might|could) (?:be|have|mean|suggest)\b",
]
NO_NAMES = "The A An My Our Your His Her Its Their This That These Those I It We They He She You If And But Or So Then".split()
NAME_RUN = r"[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*"


def conversation_intent(question: Column, wide: bool = False) -> Column:
    """set-completion, inference or direct, in this order of precedence; null for null."""
    any_of = lambda patterns: question.rlike(f"(?i){'|'.join(patterns)}")
    return F.when(any_of(SETS_WIDE if wide else SETS), "set-completion").when(any_of(INFERENCES), "inference").when(question.isNotNull(), "direct")


def name_runs(text: Column) -> Column:
    """Runs of capitalised words without function words, in order, each form once."""
    bare = lambda run: F.array_join(F.filter(F.split(run, r"\s+"), lambda w: ~w.isin(*NO_NAMES)), " ")
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(runs, bare), lambda r: r != ""))


def proper_nouns(texts: DataFrame) -> DataFrame:
    """(id, pos, name) of texts(id, text): names in order of pos; of those that differ in case alone the first."""
    runs = texts.select("id", F.posexplode(name_runs(F.col("text"))).alias("pos", "name"))
    first = runs.groupBy("id", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name")).alias("f"))
    return first.select("id", "f.pos", "f.name")


def grounded(value: Column, source: Column) -> Column:
    """The first place of a value in its source, whole words, in any case and with any white space between them, as it
    stands there; null if there is none or the value is blank."""
    words = F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\w)"), F.array_join(quoted, r"\s+"), F.lit(r"(?!\w)"))
    found = F.regexp_substr(source, pattern)
    return F.when(F.size(words) > 0, found)


# What parts clauses, quotation marks, and openings of a subject that is only said to be so.
BREAKS = frozenset(
    "and but or yet so while whereas because although though if unless when whenever after before since once until where wherever who whom whose which that".split()
)
CLAUSE = re.compile(rf"[\r\n\]:,.!?;]|\b(?:{'|'.join(BREAKS)})\b", re.I)
QUOTE = re.compile("[\u201c\u201d\u2018\u00ab\u00bb\u2039\u203a\u300c\u300d\u300e\u300f\"]|(?<![^\\W_])['\u2019]|['\u2019](?![^\\W_])|(?<![^\\W_])(?<!`)`+|`+(?![^\\W_]|`)")
HEARSAY = re.compile(r"\s*(?:hypothetical(?:ly)?|rumou?r|allegedly|reportedly|supposedly|perhaps|maybe|according\s+to|in\s+a\s+dream)\b", re.I)

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


@lru_cache(1 << 16)
def same_letter(a: str, b: str) -> bool:
    """Whether two characters are alike in any case, as a pattern has it."""
    return re.fullmatch(re.escape(a), b, re.I) is not None


def alike(word: str, there: str) -> bool:
    """Whether two texts are alike in any case, character by character."""
    if word == there:
        return True
    if word.isascii() and there.isascii():
        return word.lower() == there.lower()
    return len(word) == len(there) and all(map(same_letter, word, there))


def span_of(words: list[str], source: str, at: int) -> tuple[int, int] | None:
    """Where words stand in a source after the white space at a place, whole, in any case and with any white space between
    them. Words hold no white space, so no other place can fit, and no pattern is compiled a row."""
    start = None
    for word in words:
        gap = at
        while gap < len(source) and source[gap].isspace():
            gap += 1
        if (start is not None and gap == at) or not alike(word, source[gap : gap + len(word)]):
            return None
        start, at = (gap if start is None else start), gap + len(word)
    letter = lambda i: 0 <= i < len(source) and (source[i].isalnum() or source[i] == "_")
    return None if letter(start - 1) or letter(at) else (start, at)


def one_clause(part: str) -> bool:
    """Whether a part holds no mark or word that parts clauses and no quotation mark."""
    if part.isascii() and part.isalnum():  # one word
        return part.lower() not in BREAKS
    return not CLAUSE.search(part) and not QUOTE.search(part)


def claim_spans(subject: str | None, relation: str | None, obj: str | None, source: str | None) -> list[tuple[int, int, str]] | None:
    """Where a proposition says subject, relation and object one after the other, or None; see `grounded_claim`."""
    parts = [(x or "").split() for x in (subject, relation, obj)]
    if not all(parts) or not source or "?" in source:
        return None
    spans, at = [], 0
    for p in parts:
        if (span := span_of(p, source, at)) is None:
            return None
        spans.append((*span, source[slice(*span)]))
        at = span[1]
    if HEARSAY.match(spans[0][2]) or not all(one_clause(x) for _, _, x in spans) or re.search(r"[\r\n]", source[spans[0][1] : spans[2][0]]):
        return None
    return spans


@arrow_udf(T.StructType([T.StructField(n, SPAN) for n in ("subject", "relation", "object")]))
def grounded_claim(subject: pa.Array, relation: pa.Array, obj: pa.Array, source: pa.Array) -> pa.Array:
    """struct(subject, relation, object), each struct(start, end, text) with offsets in code points from 0, of a claim that a
    proposition makes; three nulls if it does not.

    The subject opens the proposition, nothing but white space stands between the three, in any case and spacing, and whole
    words count. A question says nothing, and no part may hold a mark or word that parts clauses, a quotation mark or, in
    the subject, a word for hearsay. What is reordered, scattered or blank is refused."""
    found = [claim_spans(*row) for row in zip(*(c.to_pylist() for c in (subject, relation, obj, source)), strict=True)]
    missing = pa.array([f is None for f in found], pa.bool_())
    column = lambda i, k, kind: pa.array([f and f[i][k] for f in found], kind)
    span = lambda i: pa.StructArray.from_arrays([column(i, 0, pa.int32()), column(i, 1, pa.int32()), column(i, 2, pa.string())], names=["start", "end", "text"], mask=missing)
    return pa.StructArray.from_arrays([span(i) for i in range(3)], names=["subject", "relation", "object"])
