"""Conversation repair against a search over all edit strings."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from datalumen.llm import conversations

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, present string, cost string"


def first_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sage"]
    texts = ["One.", "Two?", "Three", "", " \t", None, "Four!", "Five. ", "\x0b", "Six.", "é!", "Seven ..,", "\xa0"]
    out = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(1, 5)):
            out.append((conv, rng.choice([None, 0, 1, 2, 3, 7, -2]), rng.choice(roles), rng.choice(texts), "x", "y", "z"))
    return out + [out[3], out[3], out[40]]


def damage(rows):
    """What is left of each conversation, in order; conversations without rows stay."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]  # noqa: B018
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def expected(rows):
    """Cheapest edits by search over (cost, string): the first finished string is the cheapest and the least."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, edits, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            best = cost, edits, lines
            break
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[after]
        if cost < 4 * len(rows) + 3:
            heapq.heappush(heap, (cost + 3, edits + "I", i, after, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                stay = cost + 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (stay + 3, edits + "R", i + 1, after, (*lines, f"{name}:{text}")))
                if role[:1] == after or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (stay, edits + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            illegal, *best[:2], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(first_rows(), SCHEMA).repartition(5)


def found(df, present=None):
    return {r.conv_id: tuple(r)[1:] for r in conversations.assess(df, present).collect()}


def test_damage_and_repair(turns):
    want = {c: expected(r) for c, r in damage(first_rows()).items()}
    assert found(conversations.damaged(turns), "present") == want
    assert sum(v[5] > 6 for v in want.values()) > 10 and len({c for v in want.values() for c in v[6]}) == 4


def test_undamaged_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (2, 0, "assistant", "A."), (3, 5, "user", "cut")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = found(table)
    assert got[1][4:7] == (0, 0, "KKK") and got[2][4:7] == (0, 3, "IK")
    assert got[3] == expected([(5, "user", "cut")])
    lines = [tuple(r) for r in conversations.repair(table).orderBy("conv_id", "position").collect()]
    assert lines[:5] == [(1, 0, "K", 0, "system", "S."), (1, 1, "K", 1, "user", "Q?"), (1, 2, "K", 2, "assistant", "A."),
                         (2, 0, "I", None, "user", ""), (2, 1, "K", 0, "assistant", "A.")]
    assert conversations.repair(table).schema["conv_id"].dataType == table.schema["conv_id"].dataType


def test_nothing(spark):
    assert conversations.assess(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA)), "present").count() == 0


def whole_strings(rows):
    """The same program with whole strings instead of shared nodes."""
    best, seen = {"": (0, "")}, set()

    def offer(into, state, cost, text):
        into[state] = min(into.get(state, (cost, text)), (cost, text))

    def insert(into):
        for state, after in 2 * [("", "u"), ("s", "u"), ("a", "u"), ("u", "a")]:
            if state in into:
                offer(into, after, into[state][0] + 3, into[state][1] + "I")
    insert(best)
    for _, role, text in rows:
        bare, into = text.rstrip(WHITE), {}
        for state, (cost, edits) in best.items():
            offer(into, state, cost + 4, edits + "D")
            if bare and (role, text) not in seen:
                stay, after = cost + 3 * (bare[-1] not in ".!?"), {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                offer(into, after, stay + 3, edits + "R")
                if role[:1] == after or role[:1] == "s" and state == "":
                    offer(into, role[:1], stay, edits + "K")
        seen.add((role, text))
        insert(into)
        best = into
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("base", [conversations._BASE, 0, 1])
def test_long_conversations_and_colliding_hashes(monkeypatch, base):
    monkeypatch.setattr(conversations, "_BASE", base)
    rng = random.Random(base)
    for n, roles in ((400, ["user"]), (900, ["user", "assistant", "user", "assistant", "system"]), (300, ["tool"]), (500, ["assistant", "user", "user"])):
        rows = [(i, rng.choice(roles), rng.choice([f"t{i}.", f"t{i}", "", "same."])) for i in range(n)]
        edits = []
        run = conversations.Repair(lambda edit, *_: edits.append(edit))
        held = 0
        for r in rows:
            run.add(*r)
            held = max(held, len(run.pending))
        assert (run.finish()[-1], "".join(edits)) == whole_strings(rows)
        assert held <= n


def test_a_long_conversation_is_settled_on_the_way():
    run = conversations.Repair(lambda *_: None)
    most = 0
    for i in range(20_000):
        run.add(i, ("user", "assistant")[i % 2], f"line {i}.")
        most = max(most, len(run.pending), len(run.edits.sign))
    assert most < 2_000 and run.finish()[-1] == 0


def test_one_conversation_holds_most_rows(spark):
    rows = [(i if i % 3 else 0, i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(3000)]
    got = found(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    mine = [r[1:] for r in rows if r[0] == 0]
    assert len(got) == 2001 and got[0][5:7] == whole_strings(mine)
