"""Query text to a plan: inline filters, the rest of the query, intent, legs and their limits. No Spark work here
except `apply_filters`, which turns the filters into predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that are not current.
NOT_CURRENT = ("contradicted", "superseded", "deprecated", "deleted_soft")
FILTER = re.compile(r"\b(id|kind|ns|scope|predicate|subject|object):(\S+)")
MAX_IDS, MAX_KINDS = 64, 32
#: Legs of each mode.
MODES = {"vector": ("vector",), "graph": ("graph",), "hybrid": ("sql", "vector"), "mix": ("sql", "vector", "graph")}


@dataclass(frozen=True)
class Filters:
    ids: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    ns: str | None = None
    scope: str | None = None
    predicate: str | None = None
    subject: str | None = None
    object: str | None = None

    def any(self) -> bool:
        return self != Filters()


@dataclass(frozen=True)
class Plan:
    query: str
    residual: str
    filters: Filters
    intent: str
    legs: tuple[str, ...]
    limits: dict[str, int] = field(default_factory=dict)
    budget: int = 5
    explicit_boundary: bool = False


def parse_filters(text: str, ns: str | None = None, scope: str | None = None) -> Filters:
    """The inline filters of a query. One that contradicts the caller's namespace or scope is an error."""
    found: dict[str, str] = {name: value for name, value in FILTER.findall(text)}
    for name, given in (("ns", ns), ("scope", scope)):
        if given and found.get(name, given) != given:
            raise ValueError(f"{name}:{found[name]} contradicts the caller's {given}")
    ids = tuple(x for x in found.get("id", "").split(",") if x)
    kinds = tuple(x.upper() for x in found.get("kind", "").split(",") if x)
    if len(ids) > MAX_IDS or len(kinds) > MAX_KINDS:
        raise ValueError(f"at most {MAX_IDS} ids and {MAX_KINDS} kinds")
    rest = {k: found.get(k) for k in ("predicate", "subject", "object")}
    return Filters(ids, kinds, found.get("ns", ns), found.get("scope", scope), **rest)


def residual(text: str) -> str:
    return " ".join(FILTER.sub(" ", text).split())


def intent(filters: Filters, rest: str, mode: str) -> str:
    if mode in ("graph", "mix"):
        return mode
    if not rest:
        return "structured"
    return "hybrid" if filters.any() else "semantic"


def plan(text: str, mode: str = "hybrid", budget: int = 5, ns: str | None = None, scope: str | None = None, temporal: bool = False) -> Plan:
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    filters, rest = parse_filters(text, ns, scope), residual(text)
    legs = list(MODES[mode])
    if not rest and "sql" not in legs and mode != "vector":
        legs.insert(0, "sql")
    if temporal:
        legs.append("temporal")
    each = max(2 * budget if mode in ("hybrid", "mix") else budget, 5)
    explicit = {name for name, _ in FILTER.findall(text)} >= {"ns", "scope"}
    return Plan(text, rest, filters, intent(filters, rest, mode), tuple(legs), {leg: each for leg in legs}, budget, explicit)


def leg_weights(spec: str) -> dict[str, float]:
    """`graph=0.3,vector=1`; anything malformed refuses the whole spec."""
    out: dict[str, float] = {}
    for part in spec.split(","):
        m = re.fullmatch(r"\s*([a-z_]+)\s*=\s*([0-9]*\.?[0-9]+)\s*", part)
        if not m or m[1] in out:
            raise ValueError(f"malformed leg weights: {spec}")
        out[m[1]] = float(m[2])
    return out


def current(status: Column) -> Column:
    return ~status.isin(*NOT_CURRENT)


def apply_filters(records: DataFrame, filters: Filters) -> DataFrame:
    """Equality for id, kind, ns and scope; for predicate and subject without regard to case; object is a substring."""
    checks: list[Column] = []
    if filters.ids:
        checks.append(F.col("id").isin(*filters.ids))
    if filters.kinds:
        checks.append(F.col("kind").isin(*filters.kinds))
    for name in ("ns", "scope"):
        if value := getattr(filters, name):
            checks.append(F.col(name) == value)
    for name in ("predicate", "subject"):
        if value := getattr(filters, name):
            checks.append(F.lower(name) == value.lower())
    if filters.object:
        checks.append(F.contains(F.lower("object"), F.lit(filters.object.lower())))
    for check in checks:
        records = records.where(check)
    return records


def resolve_flags(defaults: dict, stored: dict | None = None, environment: dict | None = None) -> dict:
    """Defaults, overridden by what is stored, overridden by the environment; unknown names are refused."""
    out = dict(defaults)
    for layer in (stored or {}, environment or {}):
        if unknown := set(layer) - set(defaults):
            raise ValueError(f"unknown flags: {sorted(unknown)}")
        out |= {k: type(defaults[k])(v) if not isinstance(defaults[k], bool) else str(v).lower() in ("1", "true", "yes", "on") for k, v in layer.items()}
    return out


def ancestry(ns: str) -> list[str]:
    """A dotted namespace and those above it."""
    parts = ns.split(".")
    return [".".join(parts[: i + 1]) for i in range(len(parts))]


def expand_symbols(text: str, symbols: list[tuple[str, str, str, float]], ns: str) -> str:
    """text with each whole token that is a symbol replaced by its expansion: symbols (ns, symbol, expansion,
    ambiguity) of the namespace's ancestry that are ambiguous by at most 0.34."""
    known = {s: e for n, s, e, a in symbols if s and e and a <= 0.34 and n in ancestry(ns)}
    return " ".join(known.get(t, t) for t in text.split())
