import hashlib
import heapq
import random
import zlib

import pytest

from dayglass.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(rows):
    """Shortest path over (rows done, state), cost first, then the edits as text."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, done, state, out = heapq.heappop(heap)
        if done == len(rows) and state in (0, 3):
            return cost, audit, out
        if (done, state) in seen:
            continue
        seen.add((done, state))
        for role in ("user", "assistant"):
            if state in NEXT[role[0]]:
                heapq.heappush(heap, (cost + 5, audit + "I", done, NEXT[role[0]][state], (*out, f"{role}:")))
        if done == len(rows):
            continue
        role, text, fault = rows[done]
        heapq.heappush(heap, (cost + 2, audit + "D", done + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if state in NEXT.get(role[:1], {}):
            heapq.heappush(heap, (cost + more, audit + "K", done + 1, NEXT[role[0]][state], (*out, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if state in NEXT[new[0]]:
                heapq.heappush(heap, (cost + more + 1, audit + "R", done + 1, NEXT[new[0]][state], (*out, f"{new}:{text}")))


def expected(rows):
    found = {}
    for conv_id, turn, role, text in rows:
        found.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        found[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, rows in found.items():
        rows = [r for _, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))]
        seen, judged = set(), []
        for _, role, text in rows:
            end = text.rstrip(SPACE)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        faults = [f for _, _, f in judged]
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(text).encode()).hexdigest()
        out[conv_id] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def made(rng, conversations, longest):
    rows = []
    for conv_id in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice((1, 1, 1, 2))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"))
            text = rng.choice(("Yes.", "No!", "so it", "  ", "", None, "Ü?\n", f"word {rng.randrange(40)}.", "a.b"))
            rows.append((conv_id, turn, role, text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("rounds", [0, 4])
def test_against_shortest_paths(spark, rounds):
    rows = made(random.Random(3), 150, 14)
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA), grammar=C.Grammar(rounds=rounds, rules=8))) == expected(rows)


def test_long_conversations_in_chunks(spark):
    rng = random.Random(4)
    rows = made(rng, 30, 6) + [(99, t, r, x) for _, t, r, x in made(rng, 1, 1)] + [
        (99, t, rng.choice(("user", "assistant", "system")), f"text {rng.randrange(150)}" + rng.choice((".", ""))) for t in range(900)
    ]
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), bounds=C.Bounds(rows=7))) == expected(rows)
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA), bounds=C.Bounds(chars=30))) == expected(rows)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (5, None, "user", "Hi."), (5, 1, "user", "Hi."), (5, 2, "assistant", "Yes." + " " * 50)]
    rows += [(6, 1, "user", "the same.")] * 40 + [(7, 2, "assistant", "long " * 200_000 + ".")] + [(8, None, "user", None)]
    rows += [(k, 0, "system", "only this.") for k in range(20, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 AS part", "'x' AS signs", "2 AS cost", "3 AS copies", "4 AS mark", "5 AS first", "6 AS kind")
    want = expected(rows)
    assert got(C.repair(more)) == want
    assert ("" in [w[6] for w in want.values()]) and got(C.repair(df.where("false"))) == {}


def test_rules_share_their_matrices():
    rules = [("Ā", ("u", "a")), ("ā", ("Ā", "Ā"))]
    known = C.matrices(rules, C.Costs())
    plain = C.matrices([], C.Costs())
    for signs in ("uaua", "uauaua", "xuauaUs", "o", "uauauauaS"):
        one, two = C.product(signs, rules, known), C.product(signs, [], plain)
        assert {k: (c, str(e)) for k, (c, e) in one.items()} == {k: (c, str(e)) for k, (c, e) in two.items()}
    assert C.compress("uauaua", rules) == "āĀ"
