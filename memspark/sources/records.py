"""Records as text: `KIND|id|json` lines, JSON lines, and the block language."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of records.
KINDS = ("RAW", "SPAN", "ENT", "CLM", "EVT", "REL", "STA", "SYM", "PACK", "FLOW", "PROV", "META")
ENVELOPE = "id string, kind string, ns string, scope string, status string, conf double, t0 string, t1 string, prov array<string>, evidence array<string>, attrs string, ext string"
DEFAULTS = {"ns": "local.default", "scope": "project", "status": "asserted", "conf": 1.0}


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of lines(value): kind, id, and a JSON object with the rest of the envelope. A line that is none is kept
    with a null id, so that a load can count what it refuses."""
    parts = F.split("value", "\\|", 3)
    body = F.from_json(F.get(parts, F.lit(2)), "ns string, scope string, status string, conf double, t0 string, t1 string, prov array<string>, evidence array<string>, attrs string, ext string")
    ok = F.get(parts, F.lit(0)).isin(*KINDS) & F.get(parts, F.lit(2)).isNotNull()
    found = lines.select(F.when(ok, F.get(parts, F.lit(1))).alias("id"), F.when(ok, F.get(parts, F.lit(0))).alias("kind"), body.alias("b"))
    filled = {c: F.coalesce(F.col(f"b.{c}"), F.lit(v)).alias(c) for c, v in DEFAULTS.items()}
    return found.select("id", "kind", *filled.values(), "b.t0", "b.t1", F.coalesce("b.prov", F.array().cast("array<string>")).alias("prov"), F.coalesce("b.evidence", F.array().cast("array<string>")).alias("evidence"), "b.attrs", "b.ext")


def to_lines(records: DataFrame) -> DataFrame:
    """lines(value) of records; absent fields are left out."""
    rest = [c for c in ("ns", "scope", "status", "conf", "t0", "t1", "prov", "evidence", "attrs", "ext") if c in records.columns]
    return records.select(F.concat_ws("|", "kind", "id", F.to_json(F.struct(*rest))).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path).where("trim(value) != ''"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).json(path)


def write_lines(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_lines(records).write.mode(mode).text(path)


BLOCK = re.compile(r"(claim|state|pack|retrieve|raw|span|rel|symbol)\s+(\S+):")
ENTITY = re.compile(r'entity\s+(\w+)\s+"([^"]+)"\s+as\s+(\S+)')
# The kind of each block, its fields with what stands for those left out, and the statuses.
BLOCK_KINDS = {"raw": "RAW", "span": "SPAN", "claim": "CLM", "state": "STA", "pack": "PACK", "retrieve": "FLOW", "rel": "REL", "symbol": "SYM"}
BLOCK_FIELDS = {
    "raw": {"content": ("text", ""), "source_ref": ("source", None)},
    "span": {"raw_id": ("raw", None), "start": ("start", 0), "end": ("end", 0)},
    "claim": {"subject": ("subject", None), "predicate": ("predicate", None), "object": ("object", None)},
    "state": {"target": ("target", None), "fields": ("fields", {})},
    "pack": {"mode": ("mode", "context"), "lens": ("lens", "general"), "budget": ("budget", 512), "refs": ("include", []), "profile": ("profile", "default")},
    "retrieve": {"query": ("query", None), "lens": ("lens", "general"), "budget": ("budget", 10)},
    "rel": {"src": ("src", None), "predicate": ("predicate", None), "dst": ("dst", None)},
    "symbol": {"symbol": ("symbol", None), "expansion": ("expansion", None)},
}
STATUSES = ("asserted", "observed", "inferred", "hypothetical", "contradicted", "superseded", "deprecated", "deleted_soft")


def scalar(text: str):
    """A value of the block language: quoted text, a [list], a whole or decimal number, a status in any case, else bare
    text; true, false and null are bare text."""
    text = text.strip()
    if text[:1] == text[-1:] == '"':
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    return text.lower() if text.lower() in STATUSES else text


def parse_blocks(source: str) -> list[dict]:
    """Entity lines, then indented blocks, as records. Such sources are written by hand, so they are small.

    `entity TYPE "label" as ID` is a record on its line. A block begins with `KIND ID:`; its fields, a name and a value
    apart by a space, are indented by two spaces. `include` may come often, and `field NAME VALUE` fills a state's fields.
    """
    entities: list[dict] = []
    blocks: list[tuple[str, str, dict]] = []
    for number, line in enumerate(source.splitlines(), 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if m := ENTITY.fullmatch(text):
            entities.append({"id": m[3], "kind": "ENT", **DEFAULTS, "attrs": {"entity_type": m[1], "label": m[2]}})
            continue
        if m := BLOCK.fullmatch(text):
            blocks.append((m[1], m[2], {}))
            continue
        name, _, rest = text.partition(" ")
        if not blocks or not line.startswith("  ") or not rest or name == "field" and " " not in rest:
            raise ValueError(f"line {number} is no field of a block: {text}")
        fields = blocks[-1][2]
        if name == "include":
            fields.setdefault("include", []).append(scalar(rest))
        elif name == "field":
            own, _, value = rest.partition(" ")
            fields.setdefault("fields", {})[own] = scalar(value)
        else:
            fields[name] = scalar(rest)
    return entities + [block_record(*block) for block in blocks]


def block_record(kind: str, name: str, fields: dict) -> dict:
    attrs = {attr: fields.get(field, default) for attr, (field, default) in BLOCK_FIELDS[kind].items()}
    if kind == "raw" and attrs["source_ref"] is None:
        attrs["source_ref"] = f"dsl://{name}"
    if kind == "span":
        attrs |= {"start": int(attrs["start"]), "end": int(attrs["end"])}
    if kind in ("pack", "retrieve"):
        attrs["budget"] = int(attrs["budget"])
    if kind == "pack":
        attrs |= {"payload": {}, "token_cost": 0, "reversible": attrs["mode"] == "exact"}
    if kind == "retrieve":
        attrs["op"] = "search"
    status = fields.get("status", DEFAULTS["status"])
    if status not in STATUSES:
        raise ValueError(f"{name} has no such status: {status}")
    several = lambda x: [] if x is None else [str(y) for y in x] if isinstance(x, list) else [str(x)]
    return {
        "id": name,
        "kind": BLOCK_KINDS[kind],
        "ns": str(fields.get("namespace", DEFAULTS["ns"])),
        "scope": str(fields.get("scope", DEFAULTS["scope"])),
        "status": status,
        "conf": float(fields.get("confidence", fields.get("conf", DEFAULTS["conf"]))),
        "prov": several(fields.get("prov")),
        "evidence": several(fields.get("evidence")),
        "attrs": attrs,
    }


def from_blocks(spark: SparkSession, source: str) -> DataFrame:
    rows = [
        (r["id"], r["kind"], r["ns"], r["scope"], r["status"], float(r["conf"]), r.get("t0"), r.get("t1"), r.get("prov") or [], r.get("evidence") or [], json.dumps(r["attrs"], sort_keys=True), None)
        for r in parse_blocks(source)
    ]
    return spark.createDataFrame(rows, ENVELOPE)
