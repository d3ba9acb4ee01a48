"""Instants, windows and decay. Naive times are UTC; malformed ones are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
# Days of the units of relative phrases and of named ones, the number words, and the forms of dates.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
NAMED_DAYS = {
    "yesterday": -1, "today": 0, "tomorrow": 1,
    "last week": -7, "this week": 0, "next week": 7,
    "last month": -30, "this month": 0, "next month": 30,
    "last year": -365, "this year": 0, "next year": 365,
}
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
COUNTED = rf"\b(\d+|{'|'.join(NUMBER_WORDS)})\s+(day|week|month|year)s?\s+(ago|before|after|later)\b"
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
TOKENS = [
    rf"\b{MONTH}\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b(?:last|this|next)\s+(?:week|month|year)\b",
    r"\b(?:yesterday|today|tomorrow)\b",
    r"\b\d+\s+(?:days?|weeks?|months?|years?)\s+(?:ago|after|before|later)\b",
]


def instant(text: Column) -> Column:
    """The UTC instant of an ISO text; null for blank and malformed texts."""
    return F.try_to_timestamp(F.when(F.trim(text) != "", F.trim(text)))


def key(at: Column) -> Column:
    """Fixed-width text of an instant, which sorts as the instants do."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(float(DAY_MICROS))


def decay(at: Column, reference: Column, scale_days: float = 30.0) -> Column:
    """exp(-|days| / scale); 0 where either instant is missing."""
    return F.coalesce(F.exp(-F.abs(days_between(at, reference)) / F.lit(scale_days)), F.lit(0.0))


def within(at: Column, start: Column, end: Column) -> Column:
    """1 from start to end, both included, else 0."""
    return F.when(at.between(start, end), 1.0).otherwise(0.0)


def presence(at: Column) -> Column:
    return F.when(at.isNotNull(), 1.0).otherwise(0.2)


def visible_at(start: Column, end: Column, end_missing: Column, moment: Column) -> Column:
    """start <= moment < end. A missing end is open; a malformed one (null but not missing) hides the row."""
    return F.coalesce((start <= moment) & F.when(end_missing, True).otherwise(end > moment), F.lit(False))


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1 as left is before, at or after right; null unless both are instants."""
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def tokens(text: Column) -> Column:
    """The dates and relative phrases in a text, in order, as they stand there."""
    return F.regexp_extract_all(text, F.lit(f"(?i){'|'.join(TOKENS)}"), F.lit(0))


def relative_days(text: Column) -> Column:
    """Days from the anchor that a text speaks of, anywhere in it: a named phrase, else the first counted one. Months have
    30 days, years 365; null if it speaks of none."""
    low = F.lower(text)
    named = [F.when(low.rlike(rf"\b{phrase}\b"), F.lit(days)) for phrase, days in NAMED_DAYS.items()]
    part = lambda k: F.regexp_extract(low, COUNTED, k)
    count, unit, direction = part(1), part(2), part(3)
    number = F.coalesce(count.try_cast("long"), *[F.when(count == w, F.lit(n).cast("long")) for n, w in enumerate(NUMBER_WORDS, 1)])
    days = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in UNIT_DAYS.items()])
    counted = number * days * F.when(direction.isin("ago", "before"), -1).otherwise(1)
    return F.coalesce(*[n.cast("long") for n in named], counted)


def reference_instant(text: Column, anchor: Column) -> Column:
    """The instant that a text is, else the first valid ISO date in it, else what it speaks of counted from the anchor; null
    if nothing is there."""
    whole = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]"), instant(text))
    dates = F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)), instant)
    stated = F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(whole, stated, F.timestamp_micros(F.unix_micros(anchor) + relative_days(text) * DAY_MICROS))
