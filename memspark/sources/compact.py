"""Compact notation: a line a record, a header with the namespace and scope that lines leave out."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The letters of kinds and statuses, and the mark of the header.
CODES = {
    "ENT": "E", "CLM": "C", "REL": "R", "EVT": "V", "STA": "S", "SYM": "Y", "PACK": "P", "FLOW": "F", "PROV": "W", "META": "M", "RAW": "X", "SPAN": "Z",
}
STATUS_CODES = {
    "asserted": "a", "observed": "o", "inferred": "i", "hypothetical": "h", "contradicted": "x", "superseded": "z", "deprecated": "d", "deleted_soft": "_",
}
MAGIC = "!LX1"
KINDS, STATUSES = ({v: k for k, v in m.items()} for m in (CODES, STATUS_CODES))
BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_:./-]*\Z")
#: A name, and its value if that is a plain word or a quoted one without escapes; other JSON is left to the decoder.
FIELD = re.compile(r''' *([^ =]*)(?:="([^"\\\x00-\x1f]*)"|=(?!["\[{])([^ ]*))?''')
NAMES = ("null", "true", "false")
NUMBERS = ("nan", "inf", "infinity")  # words that are numbers
written = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode
held = json.JSONDecoder().raw_decode
SCHEMA = "id string, kind string, ns string, scope string, status string, conf double, t0 string, t1 string, prov array<string>, evidence array<string>, attrs string, fault string"


def shown(value) -> str:
    """A value as it stands in a line: a plain word bare, anything else as JSON."""
    if type(value) is int:
        return str(value)
    if isinstance(value, str) and BARE.match(value) and value not in NAMES:
        return value
    return written(value)


def fields(line: str):
    """(name, value) of each field of a line; a quoted or bracketed value is JSON and may hold blanks."""
    at = 0
    while at < len(line):
        found = FIELD.match(line, at)
        name, quoted, word = found.groups()
        at = found.end()
        if quoted is not None:
            yield name, quoted
        elif word is not None:
            yield name, plain(word)
        elif line[at : at + 1] == "=":
            value, at = held(line, at + 1)
            yield name, value
        elif name:
            yield name, None


def plain(word: str):
    if word in NAMES:
        return json.loads(word)
    if BARE.match(word) and word.lower() not in NUMBERS:
        return word
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    return word


def parsed(line: str, ns: str, scope: str) -> dict:
    """A record of a line, or its fault."""
    out = {"ns": ns, "scope": scope, "status": "asserted", "conf": 1.0, "prov": [], "evidence": []}
    attrs = {}
    try:
        code, rid, *rest = line.split(" ", 2)
        out |= {"kind": KINDS[code], "id": rid}
        for name, value in fields(rest[0] if rest else ""):
            if name[:2] in ("~@", "~^"):
                out["prov" if name[1] == "@" else "evidence"].append(name[2:])
            elif name in ("~n", "~sc", "~t0", "~t1"):
                out[{"~n": "ns", "~sc": "scope"}.get(name, name[1:])] = None if value is None else str(value)
            elif name == "~c":
                out["conf"] = float(value)
            elif name == "~s":
                out["status"] = STATUSES[str(value)]
            elif not name.startswith("~"):
                attrs[name] = value
    except (KeyError, ValueError, TypeError) as e:
        return {"fault": f"{type(e).__name__}: {e}"}
    out["attrs"] = written(attrs)
    return out


def encoded(records: DataFrame, ns: str = "local.default", scope: str = "project") -> DataFrame:
    """(id, value): the line of each record(id, kind, ns, scope, status, conf, t0, t1, prov, evidence, attrs JSON); what equals
    the header's or stands for itself is left out."""
    letter = lambda codes, c: F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col(c)]
    marked = lambda mark, c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x)), " ")
    flat = records.select(
        "id", letter(CODES, "kind").alias("code"), F.when(F.col("ns") != ns, F.col("ns")).alias("n"), F.when(F.col("scope") != scope, F.col("scope")).alias("sc"),
        F.when(F.abs(F.col("conf") - 1) > 1e-9, F.round("conf", 6)).alias("c"), F.when(F.col("status") != "asserted", letter(STATUS_CODES, "status")).alias("s"),
        F.concat_ws(" ", F.nullif(marked("~@", "prov"), F.lit("")), F.nullif(marked("~^", "evidence"), F.lit(""))).alias("refs"),
        F.nullif("t0", F.lit("")).alias("t0"), F.nullif("t1", F.lit("")).alias("t1"), "attrs",
    )

    def run(batches):
        for b in batches:
            lines = []
            for rid, code, n, sc, c, s, refs, t0, t1, attrs in zip(*(column.to_pylist() for column in b.columns), strict=True):
                parts = [code, rid]
                parts += [f"~{k}={shown(x)}" for k, x in (("n", n), ("sc", sc)) if x is not None]
                parts += [f"~{k}={x}" for k, x in (("c", c), ("s", s)) if x is not None]
                parts += [refs] if refs else []
                parts += [f"~{k}={shown(x)}" for k, x in (("t0", t0), ("t1", t1)) if x is not None]
                parts += [f"{k}={shown(v)}" for k, v in json.loads(attrs or "{}").items()]
                lines.append(" ".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lines, pa.string())], names=["id", "value"])

    return flat.mapInArrow(run, "id string, value string")


def decoded(lines: DataFrame, ns: str = "local.default", scope: str = "project") -> DataFrame:
    """Records of lines(value), or a null id and the fault. Header, blank and # lines are none; a file's header is read by
    `read`, which hands ns and scope on."""
    kept = lines.select(F.trim("value").alias("value")).where(f"value != '' and not startswith(value, '#') and not startswith(value, '{MAGIC}')")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    lists = {"prov", "evidence"}

    def run(batches):
        for b in batches:
            rows = [parsed(line, ns, scope) for line in b.column("value").to_pylist()]
            kinds = [pa.list_(pa.string()) if n in lists else pa.float64() if n == "conf" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return kept.mapInArrow(run, SCHEMA)


def header(ns: str = "local.default", scope: str = "project") -> str:
    return f"{MAGIC} ns={shown(ns)} sc={shown(scope)}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder of lines, whose headers must agree."""
    lines = spark.read.text(path)
    heads = [r.value for r in lines.where(f"startswith(trim(value), '{MAGIC}')").select(F.trim("value").alias("value")).distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("files with different headers must be read apart")
    said = dict(fields(heads[0][len(MAGIC) :])) if heads else {}
    return decoded(lines, said.get("ns", "local.default"), said.get("sc", "project"))


def savings(texts: DataFrame) -> DataFrame:
    """(id, original_tokens, compact_tokens, ratio) of texts(id, original, compact), by estimated tokens."""
    from memspark.functions.text import token_estimate

    rows = texts.select("id", token_estimate(F.col("original")).alias("original_tokens"), token_estimate(F.col("compact")).alias("compact_tokens"))
    ratio = F.when(F.col("original_tokens") > 0, 1 - F.col("compact_tokens") / F.col("original_tokens")).otherwise(0.0)
    return rows.withColumn("ratio", F.round(ratio, 6))
