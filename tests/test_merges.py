"""Replay of a merge ledger, component by component, against one run over all decisions."""

import random

import pytest

from memspark.operators import merges as mg


def sequential(ops, held):
    """Every decision on whole tables, by what the ledger says at that moment."""
    table = {(n, s, c, a): [st, r] for n, s, c, a, st, r in held}
    accepted = lambda n, s, alias, skip=None: sorted(c for (x, y, c, a), (st, _) in table.items() if (x, y, a) == (n, s, alias) and st == "accepted" and (c, a) != skip)
    out = []
    for seq, op, n, s, c, a in sorted(ops):
        key = (n, s, c, a)
        if not c or not a or c == a:
            out.append((seq, "refused", "self" if c and c == a else "blank"))
            continue
        if op != "propose" and key not in table:
            out.append((seq, "refused", "unknown"))
            continue
        status = table.get(key, [None])[0]
        if op == "split":
            table[key] = ["split", None]
        elif op == "accept" and status == "split":
            out.append((seq, "refused", "split"))
            continue
        elif status not in ("accepted", "split"):
            skip = (c, a) if op == "accept" else None
            reason = None
            if table.get((n, s, a, c), [""])[0] in ("proposed", "accepted"):
                reason = "reverse"
            elif (t := accepted(n, s, a, skip)) and t[0] != c:
                reason = "absorbed"
            else:
                node, seen = c, set()
                while (t := accepted(n, s, node)) and node not in seen and (t[0], node) != skip:
                    seen.add(node)
                    node = t[0]
                    if node == a:
                        reason = "cycle"
                        break
            table[key] = ["conflict" if reason else "accepted" if op == "accept" else "proposed", reason]
        out.append((seq, *table[key]))
    return out, {(*k, *v) for k, v in table.items()}


@pytest.mark.parametrize("seed", range(2))
def test_components_replay_as_one_run(spark, seed):
    draw = random.Random(seed)
    name = lambda: draw.choice([*map(str, range(12))])
    held = {}
    for _ in range(12):
        held[draw.choice("nm"), "s", name(), name()] = draw.choice(["proposed", "accepted", "split", "conflict"])
    held = [(*k, v, None) for k, v in held.items() if k[2] != k[3]]
    ops = [(i, draw.choice(["propose", "propose", "accept", "accept", "split"]), draw.choice("nm"), "s", name(), name()) for i in range(300)]
    ops += [(900, "propose", "n", "s", "", "1"), (901, "accept", "n", "s", "98", "99"), (902, "propose", "n", "s", None, "1")]
    done, ledger = mg.replayed(spark.createDataFrame(ops, mg.OPERATION), spark.createDataFrame(held, mg.MERGE))
    want, after = sequential([(a, b, c, d, e or "", f) for a, b, c, d, e, f in ops], held)
    assert sorted((r.seq, r.status, r.reason) for r in done.collect()) == sorted(want)
    assert {tuple(r) for r in ledger.select("ns", "scope", "canonical", "alias", "status", "reason").collect()} == after


def test_a_circle_within_a_batch(spark):
    ops = [(1, "propose", "n", "s", "a", "b"), (2, "propose", "n", "s", "b", "a"), (3, "accept", "n", "s", "a", "b"), (4, "propose", "n", "s", "c", "a"), (5, "accept", "n", "s", "c", "a"), (6, "propose", "n", "s", "b", "c")]
    done, _ = mg.replayed(spark.createDataFrame(ops, mg.OPERATION), spark.createDataFrame([], mg.MERGE))
    assert [(r.status, r.reason) for r in done.orderBy("seq").collect()] == [("proposed", None), ("conflict", "reverse"), ("accepted", None), ("proposed", None), ("accepted", None), ("conflict", "cycle")]
    with pytest.raises(ValueError):
        mg.replayed(spark.createDataFrame(ops, mg.OPERATION), spark.createDataFrame([], mg.MERGE), most=3)
