"""Tokens and lexical measures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_:-]+"


def tokens(text: Column) -> Column:
    """Tokens of the lower-cased text, in order, repeats kept; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def query_tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def overlap(query: str, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for a query without tokens."""
    wanted = sorted(set(query_tokens(query)))
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), tokens(text))) / F.lit(float(len(wanted)))


def contains(text: Column, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def token_estimate(text: Column) -> Column:
    """Tokens a text costs, estimated as a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def joined(*columns: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *columns)
