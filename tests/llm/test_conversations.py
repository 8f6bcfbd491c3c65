"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tilewright.llm import conversations as repairs

TURNS = "conv_id long, turn long, role string, text string, audit string, place int, `a.b` int"
SPACES = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    say = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        one = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [one] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_repair(rows):
    """``rows(turn, role, text)`` of one conversation: the least (cost, audit) by a search over built roles, and all that is reported."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        left = text.rstrip(SPACES)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = lambda built: re.fullmatch("(s?(ua)*u?|s)?", built) is not None  # noqa: E731  a beginning of what is allowed
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, built, lines = heapq.heappop(heap)
        key = (at, built[-1:], len(built) > 0)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", built):
            break
        if key in done:
            continue
        done.add(key)
        moves = [(3, "I", at, r) for r in ("user", "assistant")]
        lines_of = {"I": lambda r: (f"{r}:",)}
        if at < len(rows):
            _, role, text = rows[at]
            moves.append((4, "D", at + 1, None))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] == "truncated" else 0
                moves.append((more, "K", at + 1, role))
                moves += [(3 + more, "R", at + 1, r) for r in ("user", "assistant")]
            lines_of |= {"K": lambda r: (f"{r}:{text}",), "R": lambda r: (f"{r}:{text}",)}
        for price, letter, then, role in moves:
            if role is None:
                heapq.heappush(heap, (cost + price, audit + letter, then, built, lines))
            elif role and fits(built + role[0]):
                heapq.heappush(heap, (cost + price, audit + letter, then, built + role[0], lines + lines_of[letter](role)))
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first[:-1], first[1:], strict=True))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest), lines


def conversation(r, conv, n):
    roles = ["system", "user", "assistant"]
    out = []
    for t in range(n):
        role = r.choice([*roles, "user", "assistant", "user", "assistant", "tool", "Super", ""]) if r.random() < 0.5 else roles[1 + t % 2]
        text = r.choice(["Yes.", "No!", "Why?", "cut", "  ", "", "é.", "no end\n", "End. \n\t"]) if r.random() < 0.5 else f"text {r.random()}."
        out.append((conv, None if r.random() < 0.03 else t + (t > 4), role, text))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(13)
    out = [row for c in range(120) for row in conversation(r, c, r.randint(1, 9))]
    out += conversation(r, 200, 90) + conversation(r, None, 12) + [(201, None, None, None), (202, 1, "user", "Long. " * 30_000), (202, 2, "assistant", "x" * 100_000)]
    return out + [out[3]] * 2 + [(203, 5, "user", "Same.")] * 4 + [(204, 0, "user", "b."), (204, 0, "user", "a."), (204, 0, "assistant", "c.")]


def groups(rows):
    out = {c: [] for c, *_ in rows}
    for c, *rest in slow_damage(rows):
        out[c].append(tuple(rest))
    return out


def key(x):
    return (x is not None, x or 0)


def test_repair_against_search(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(3)
    assert sorted(map(tuple, repairs.damaged(df).collect()), key=str) == sorted(slow_damage(rows), key=str)
    want = {c: slow_repair(g) for c, g in groups(rows).items()}
    for length in (repairs.SEGMENT, 3):  # whole conversations, and all but the shortest in segments
        got = repairs.repair(df, repairs.damaged(df), length)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in sorted(repairs.repaired_turns(df, repairs.damaged(df), 5).collect(), key=lambda r: (key(r.conv_id), r.place)):
        turns.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for c, (_, lines) in want.items():
        assert turns.get(c, []) == list(enumerate(lines, 1))


def test_no_rows_and_text_ids(spark):
    df = spark.createDataFrame([(0, 0, "user", "Hi.", "", 1, 2)], TURNS)
    assert repairs.repair(df.limit(0), repairs.damaged(df.limit(0))).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repairs.repair(df, df.limit(0)).collect()] == [(0, 0, 0, 0, 0, 0, 0, "", none)]
    named = spark.createDataFrame([("c", 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in repairs.repair(named, named).collect()] == [("c", 0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())]
