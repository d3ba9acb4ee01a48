"""Evidence for questions of how many: what each memory says of the thing counted, and its rank."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# What asks for a count, the head of a memory, tokens, the patterns that say a clause's state, where clauses part,
# words that say nothing, verbs by their forms, verbs that are actions, and the weight of a state.
QUESTION = r"(?i)\b(?:how many(?:\s+times)?|number of)\b"
HEADER = re.compile(r"\[(?P<speaker>[^\]\d]+?)\s+(?P<date>\d{4}-\d{2}-\d{2}|[^\]]+)\]\s*(?P<body>.*)$", re.S)
TOKEN = re.compile(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*")
NEGATED = re.compile(r"\b(?:did not|didn't|does not|doesn't|has not|hasn't|have not|haven't|never|no longer|not yet|without)\b", re.I)
PLANNED = re.compile(
    r"\b(?:plan(?:s|ned|ning)?|hope(?:s|d)? to|want(?:s|ed)? to|going to|will|would like to|next (?:week|month|year|time|weekend)|"
    r"upcoming|looking forward to|intend(?:s|ed)? to|might|could)\b", re.I,
)
OBSERVED = re.compile(
    r"\b(?:attended|bought|completed|did|finished|found|got|had|has|have|injured|joined|made|met|moved|owned|owns|participated|received|"
    r"resumed|saw|took|visited|went|won|wrote)\b", re.I,
)
REFERENCE = re.compile(r"^(?:that|this|those|these|it|they|the same|the event|the trip|the tournament|the show|the game)\b", re.I)
CLAUSES = re.compile(r"(?<=[.!?;])\s+|\s+(?:although|but|however|while)\s+", re.I)
STOP = frozenset(
    "a an and are as at be been did do does for had has have her his how in is it many of on or the their them they times to was were what when which who with".split()
)
FORMS = {
    "bought": "buy", "did": "do", "found": "find", "got": "get", "had": "have", "made": "make", "met": "meet", "owned": "own",
    "saw": "see", "taken": "take", "took": "take", "went": "go", "won": "win", "wrote": "write", "written": "write",
}
ACTIONS = frozenset(FORMS.values()) | frozenset(
    "attend buy complete do enter finish find get go have injure join make meet move own participate receive resume see take visit win write".split()
)
WEIGHT = {"observed": 4, "mixed": 3, "mentioned": 3, "reference-only": 2, "planned": 1, "negated": 0}
ENDINGS = (("ing", 5), ("ed", 4), ("es", 4), ("s", 3))  # cut off words longer than this


def stem(token: str) -> str:
    if token in FORMS:
        return FORMS[token]
    for end, length in ENDINGS:
        if token.endswith(end) and len(token) > length:
            return token.removesuffix(end)
    return token


def terms(text: str) -> set[str]:
    """Stems of the words that say something."""
    return {stem(t) for t in TOKEN.findall(text.lower()) if t not in STOP} - STOP


def clause_state(clause: str) -> str:
    if NEGATED.search(clause):
        return "negated"
    if PLANNED.search(clause):
        return "planned"
    if OBSERVED.search(clause):
        return "observed"
    return "reference-only" if REFERENCE.search(clause) else "mentioned"


def state(body: str, asked: set[str]) -> str:
    """What the clauses nearest to the question say: the state they share, or `mixed`; `mentioned` if none is near. Actions
    in common bring clauses nearest, then other terms. A body of one clause is near, whatever it says."""
    clauses = [c for c in map(str.strip, CLAUSES.split(body)) if c] or [body]
    if len(clauses) > 1 and asked:
        near = [(100 * len(t & asked & ACTIONS) + len(t & asked)) for t in map(terms, clauses)]
        clauses = [c for c, n in zip(clauses, near, strict=True) if n == max(near) > 0]
    states = {clause_state(c) for c in clauses}
    return "mentioned" if not states else states.pop() if len(states) == 1 else "mixed"


READ = T.StructType([T.StructField(n, k) for n, k in (
    ("state", T.StringType()), ("speaker", T.StringType()), ("date", T.StringType()), ("overlap", T.IntegerType()), ("speaker_overlap", T.IntegerType()), ("group_id", T.StringType()),
)])


def read_for(question: str):
    """A function of a column of memories: READ, what each says to a question."""
    asked = terms(question)

    def of(text: str | None) -> tuple:
        line = " ".join((text or "").split())
        m = HEADER.match(line)
        speaker, date, body = (m["speaker"].strip(), m["date"].strip(), m["body"].strip()) if m else ("", "", line)
        said = terms(f"{speaker} {body}")
        group = hashlib.sha256("\x1f".join((speaker.lower(), date, " ".join(sorted(said)))).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        return state(body, asked), speaker, date, len(asked & said), len(asked & terms(speaker)), group

    @pandas_udf(READ)
    def read(memories: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(x) for x in memories], columns=READ.names)

    return read


def asks_for_count(question: Column) -> Column:
    return F.coalesce(question.rlike(QUESTION), F.lit(False))


def evidence(memories: DataFrame, question: str) -> DataFrame:
    """memories(id, text, score, rank) with what each says to a question of how many, and `worth`, by which they rank: terms
    in common, those that name the speaker again, the state, the score, and at last the rank it had. Rows of one group_id say
    the same of the same day. Null texts are empty, a null score is 0; a question for no count has no evidence."""
    if not re.search(QUESTION, question or ""):
        return memories.limit(0).select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in READ.fields], F.lit(0.0).alias("worth"))
    rows = memories.withColumn("r", read_for(question)("text"))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair])[F.col("r.state")]
    worth = F.col("r.overlap") * 10.0 + F.col("r.speaker_overlap") * 8.0 + weight * 2.0 + F.coalesce("score", F.lit(0.0)) - F.col("rank") * 0.0001
    return rows.select("id", "r.*", worth.alias("worth"))


def summary(rows: DataFrame) -> DataFrame:
    """(state, memories, groups) of evidence: how many memories say so, and of how many different things."""
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("memories"), F.countDistinct("group_id").alias("groups"))
