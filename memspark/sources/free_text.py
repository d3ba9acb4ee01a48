"""Free text to records: a RAW and a PROV record a document, and for each proposition a SPAN, a claim of its content whose
subject stands in the text, and the entities that it names. A pure function of the document table, one pass a text."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from memspark.functions.language import NAME_RUN, NO_NAMES

ENDS = re.compile(r"[.!?]+(?=\s|\Z)")
WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9'-]*")
NAMES = re.compile(NAME_RUN)
SPEAKER = re.compile(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*:")
# Words before a subject that are no part of it.
DETERMINERS = frozenset("the a an my our your his her its their this that these those".split())


def segments(text: str) -> list[tuple[int, int]]:
    """Where propositions begin and end: runs up to `.`, `!` or `?` before white space or the end, trimmed, with a word in
    them. A text without any is one proposition, if it has a word."""
    out, at = [], 0
    for end in [m.end() for m in ENDS.finditer(text)] + [len(text)]:
        part = text[at:end]
        if re.search(r"\w", part):
            start = at + len(part) - len(part.lstrip())
            out.append((start, start + len(part.strip())))
        at = end
    return out


def leading_subject(proposition: str) -> str:
    """The first word that is no determiner, with the capitalised words that follow it; the determiner if it stands alone."""
    found = WORD.finditer(proposition)
    words = [m[0] for m in islice(found, 2)]
    if not words:
        return ""
    if words[0].lower() in DETERMINERS and len(words) > 1:
        words = words[1:]
    elif len(words) > 1 and not words[1][:1].isupper():
        return words[0]
    for m in found:
        if not m[0][:1].isupper():
            break
        words.append(m[0])
    return " ".join(words)


def names(proposition: str) -> list[str]:
    """Runs of capitalised words without function words, in order, each once whatever its case."""
    found: dict[str, str] = {}
    for m in NAMES.finditer(proposition):
        run = " ".join(w for w in m[0].split() if w not in NO_NAMES)
        if run:
            found.setdefault(run.lower(), run)
    return list(found.values())


CHUNK = 1 << 20  # characters whose propositions are Python objects at a time
PARSED = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())),
]))
ARROW_PARSED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("subject", pa.string()), ("names", pa.list_(pa.string()))]))


def in_chunks(content: pa.Array, of: Callable[[str], list], kind: pa.DataType) -> pa.Array:
    """What is made of each text (null: empty), as an array. Objects of a few texts are held at a time, whatever the batch."""
    done, some, size = [], [], 0
    for text in content:
        text = text.as_py() or ""
        some.append(of(text))
        size += len(text)
        if size >= CHUNK:
            done.append(pa.array(some, kind))
            some, size = [], 0
    return pa.concat_arrays([*done, pa.array(some, kind)])


def with_subject(text: str) -> list[tuple[int, int, str, str]]:
    """A text's propositions that have a subject: start, end, text, subject. Who speaks, `Name:` at the beginning, is the
    subject of all."""
    speaker = m[1] if (m := SPEAKER.match(text)) else None
    cut = [(a, b, text[a:b]) for a, b in segments(text)]
    return [(a, b, t, speaker or s) for a, b, t in cut if (s := leading_subject(t))]


@arrow_udf(PARSED)
def parsed(content: pa.Array) -> pa.Array:
    """A text's propositions that have a subject, with the names in them."""
    of = lambda text: [{"start": a, "end": b, "text": t, "subject": s, "names": names(t)} for a, b, t, s in with_subject(text)]
    return in_chunks(content, of, ARROW_PARSED)


@arrow_udf(T.ArrayType(T.StringType()))
def propositions(content: pa.Array) -> pa.Array:
    """The texts of `parsed` alone."""
    return in_chunks(content, lambda text: [t for _, _, t, _ in with_subject(text)], pa.list_(pa.string()))


def document_id(ns: Column, scope: Column, source_ref: Column, content: Column) -> Column:
    """Stable for a source and its content."""
    return F.substring(F.sha2(F.concat_ws("\n", ns, scope, source_ref, F.sha2(content, 256)), 256), 1, 16)


def compiled(docs: DataFrame) -> DataFrame:
    """docs(ns, scope, source_ref, content) to (document, id, kind, start, end, text, subject) records. A claim's subject is
    the id of an entity whose label stands in the text; labels that differ in case alone are one entity, labelled by the
    first of them. A null content is an empty one; without a word there is the RAW and the PROV record alone."""
    keyed = docs.withColumn("document", document_id(F.col("ns"), F.col("scope"), F.col("source_ref"), F.col("content")))
    entity = lambda label: F.concat(F.lit("ent:"), "document", F.lit("."), F.md5(F.lower(label)))
    made = lambda kind, suffix, text, start=None, end=None, subject=None: F.struct(
        F.concat(F.lit(f"{kind.lower()}:"), "document", suffix).alias("id"), F.lit(kind).alias("kind"),
        (F.lit(None) if start is None else start).cast("int").alias("start"), (F.lit(None) if end is None else end).cast("int").alias("end"), text.alias("text"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
    )
    whole = F.array(made("RAW", F.lit(""), F.col("content")), made("PROV", F.lit(""), F.col("source_ref")))
    found = keyed.select("document", "content", "source_ref", parsed(F.col("content")).alias("found"))
    spread = F.flatten(
        F.transform(
            "found",
            lambda p, i: F.array(
                made("SPAN", F.concat(F.lit("."), i.cast("string")), p["text"], p["start"], p["end"]),
                made("CLM", F.concat(F.lit("."), i.cast("string")), p["text"], p["start"], p["end"], entity(p["subject"])),
            ),
        )
    )
    said = F.flatten(F.transform("found", lambda p: F.concat(p["names"], F.array(p["subject"]))))
    low = F.transform("said", F.lower)
    entities = F.transform(F.array_distinct(low), lambda x: made("ENT", F.concat(F.lit("."), F.md5(x)), F.get("said", (F.array_position(low, x) - 1).cast("int"))))
    return found.withColumn("said", said).select("document", F.inline(F.concat(whole, spread, entities)))
