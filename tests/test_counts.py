"""What memories say to a question of how many."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import counts

ASKED = "How many times did Ann go hiking or win a game?"


@pytest.mark.parametrize(
    ("said", "state"),
    [
        ("I went hiking.", "observed"), ("I will go hiking.", "planned"), ("I never went hiking.", "negated"), ("That was the game", "reference-only"), ("The game was long", "reference-only"), ("A game was long", "mentioned"),
        ("I went hiking. I could win a game.", "mixed"), ("It rained. We went hiking but Bob will not come.", "observed"), ("Nice weather. Blue sky.", "mentioned"),
        ("That game? I won.", "observed"), ("", "mentioned"), ("I haven't won. I did not go.", "negated"),
    ],
)
def test_states_of_the_nearest_clauses(said, state):
    assert counts.state(said, counts.terms(ASKED)) == state


def test_terms_are_stems_of_words_that_say_something():
    assert counts.terms("The hiking trips, Ann's wishes did written boxes the-re us bed") == {"hik", "trip", "ann'", "wish", "write", "box", "the-re", "us", "bed"}
    assert counts.terms("times was has") == set() and "do" not in counts.terms("did")


def test_evidence_ranks_and_groups(spark):
    rows = [
        ("a", "[Ann 2023-05-01] I went hiking", 0.5, 1), ("b", "[Bob 2023-05-01] I went hiking", 0.5, 2), ("c", "[Ann 2023-05-01]  went hiking, I", 0.1, 3), ("d", None, None, 4), ("e", "no head at all", 0.0, 5),
        ("f", "[Ann 2023-05-02] I will go hiking", 0.5, 6),
    ]
    table = spark.createDataFrame(rows, "id string, text string, score double, rank int")
    found = {r.id: r for r in counts.evidence(table, ASKED).collect()}
    assert found["a"].group_id == found["c"].group_id != found["b"].group_id and (found["a"].speaker, found["a"].date) == ("Ann", "2023-05-01")
    assert round(found["a"].worth, 4) == 10 * 3 + 8 + 8 + 0.5 - 0.0001 and round(found["f"].worth, 4) == 10 * 3 + 8 + 2 + 0.5 - 0.0006
    assert (found["d"].state, found["d"].overlap, found["d"].speaker) == ("mentioned", 0, "") and round(found["d"].worth, 4) == 6 - 0.0004
    assert {r.state: (r.memories, r.groups) for r in counts.summary(counts.evidence(table, ASKED)).collect()} == {"observed": (3, 2), "planned": (1, 1), "mentioned": (2, 2)}
    assert counts.evidence(table, "When did Ann go?").collect() == [] == counts.evidence(table.limit(0), ASKED).collect()
    asked = spark.createDataFrame([("The NUMBER of x",), ("how much",), (None,)], "q string").select(counts.asks_for_count(F.col("q")).alias("x"))
    assert [r.x for r in asked.collect()] == [True, False, False]
