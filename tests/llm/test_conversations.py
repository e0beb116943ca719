"""Conversation repair against brute force: all edits tried, least cost and least letters kept."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tradewind.llm import conversations, registry

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation of (turn, role, text)."""

    def digest(role, text):
        return hashlib.md5(f"{role}\0{text}".encode()).hexdigest()

    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", [])}  # kept initials so far, as state -> least (cost, letters, lines)
    state_of = lambda x: x if x in ("", "s") else x[-1]
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def add(to, state, cost, letters, lines):
        if state not in to or (cost, letters) < to[state][:2]:
            to[state] = (cost, letters, lines)

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, letters, lines) in list(out.items()):
                for r in follows[s].replace("s", ""):
                    add(out, state_of(r), c + 5, letters + "I", [*lines, {"u": "user:", "a": "assistant:"}[r]])
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (c, letters, lines) in inserted(best).items():
            add(new, s, c + 2, letters + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            if role[:1] and role[:1] in follows[s]:
                add(new, state_of(role[:1]), c + extra, letters + "K", [*lines, f"{role}:{text}"])
            for r in follows[s].replace("s", ""):
                add(new, state_of(r), c + 1 + extra, letters + "R", [*lines, f"{'user' if r == 'u' else 'assistant'}:{text}"])
        best = new
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in ("", "a"))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
    texts = ["Yes.", "No!", "Why? ", "and then", "", " \n", None, "é.", "ok"]
    return [(rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for _ in range(n)]


def reported(df):
    out = {}
    for r in conversations.repair_conversations(df).report().collect():
        assert r.conversation not in out
        out[r.conversation] = (*r[1:8], hashlib.sha256(r.repaired.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def many():
    rng = random.Random(3)
    cases = {i: conversation(rng, rng.choice([1, 2, 3, 5, 8, 13, 40])) for i in range(150)}
    cases[None] = conversation(rng, 7)
    cases[1000] = [(i, "user" if i % 2 else "assistant", "Same.") for i in range(60)]
    cases[1001] = [(0, "user", "x" * 300_000 + ".")] * 3 + [(1, "assistant", "y" * 200_000 + "!")]
    cases[1002] = conversation(rng, 400)
    return cases


@pytest.mark.parametrize("block", [1 << 20, 30_000])
def test_report_equals_brute_force(spark, many, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_BYTES", block)
    rows = [(c, *r) for c, rs in many.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(7).selectExpr("*", "'clash' AS block", "'clash' AS rows", "1 AS place", "'' AS kinds")
    found = reported(df)
    assert found.keys() == many.keys()
    for key, rs in many.items():
        assert found[key] == brute(rs), key


def test_repaired_rows_follow_the_rules(spark, many, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BYTES", 30_000)
    df = spark.createDataFrame([(c, *r) for c, rs in many.items() for r in rs], COLUMNS)
    told = {}
    for r in sorted(conversations.repair_conversations(df).rows().collect(), key=lambda r: (r.block, r.place)):
        told.setdefault(r.conversation, []).append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows)) for rows in told.values())
    for key, rows in told.items():
        text = "\n".join(f"{r.role}:{r.text}" for r in rows)
        assert hashlib.sha256(text.encode()).hexdigest() == brute(many[key])[-1]


def test_nothing(spark):
    assert conversations.repair_conversations(spark.createDataFrame([], COLUMNS)).report().collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_auction_prices_are_distances(seed):
    rng = random.Random(seed)
    kinds = "".join(rng.choice("xdsua-SUA+") for _ in range(rng.randrange(0, 12)))
    goal = [rng.choice([0, 3, 9, conversations.NEVER]) for _ in range(4)]
    if all(g >= conversations.NEVER for g in goal):
        goal[0] = 0

    def distance(i, state):
        """Over all ways: at most two insertions before each row."""
        if i == len(kinds):
            return goal[state]
        out, paid = conversations.NEVER, 0
        for _ in range(4):
            out = min([out, *(paid + cost + distance_of(i + 1, to) for _, to, cost, _ in conversations.EDITS[kinds[i]][state])])
            state, paid = conversations.AFTER[state], paid + conversations.INSERT
        return min(out, conversations.NEVER)

    memo = {}

    def distance_of(i, state):
        if (i, state) not in memo:
            memo[i, state] = distance(i, state)
        return memo[i, state]

    for state in range(4):
        parts = conversations.lattices(kinds, goal)
        found = parts[0][1].auction(0, state) if parts else goal[state]
        assert found == distance_of(0, state)


def test_least_letters_among_all_audits():
    """Every audit of a short conversation is tried outright."""
    for kinds in map("".join, itertools.product("xu-aS", repeat=4)):
        ways = [(0, "", 0)]
        for kind in kinds:
            ways = [*ways, *[(c + 5, a + "I", conversations.AFTER[s]) for c, a, s in ways]]
            ways = [(c + cost, a + letter, to) for c, a, s in ways for letter, to, cost, _ in conversations.EDITS[kind][s]]
        ends = [(c + conversations.END[s], a + "I" * len(conversations.ENDING[s])) for c, a, s in ways]
        found = conversations.edits_from(kinds, conversations.END, conversations.START, True)
        assert (found["cost"], found["audit"]) == min(ends)


def test_query_damages_as_told(spark, tmp_path, many):
    rows = [(c, t, r, x) for c, rs in many.items() if c not in (1001, 1002) for t, r, x in rs] + [(5000, 1, "user", "Gone?")]
    gone = next(t for t in range(10_000) if zlib.crc32(f"5000:{t}".encode()) % 20 == 0)
    rows[-1] = (5000, gone, "user", "Gone?")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = {}
    for c, t, r, x in rows:
        damage = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        r = "user" if damage == 4 else r
        x = "" if damage == 1 else re.sub("[.!?]", "", x) if damage == 2 else x
        expected.setdefault(c, []).extend([(t, r, x)] * {0: 0, 3: 2}.get(damage, 1))
    found = {r.conv_id: tuple(r)[1:] for r in registry.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert found == {c: brute(rs) for c, rs in expected.items()}
    assert found[5000] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
