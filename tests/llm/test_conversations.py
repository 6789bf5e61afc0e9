"""Repairs against a search over all edits, on short and on chunked conversations."""

import hashlib
import random
import re
import zlib

import pytest

from loomwright.llm import conversations

TURNS = "conv_id long, turn long, role string, text string"
LETTER = re.compile(r"[^\x20\x09-\x0D]")
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows):
    """The expected row for one conversation: (turn, role, text) in any order."""
    def order(r):
        text = " " if r[2] is None else r[2]
        return (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], hashlib.md5(text.encode()).hexdigest())

    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in sorted(rows, key=order)]
    faults, seen = [], set()
    for _, role, text in rows:
        final = LETTER.findall(text)
        faults.append("blank" if not final else "duplicate" if (role, text) in seen
                      else "truncated" if final[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # Forward over rows: the least (cost, audit) for each state, by trying every edit.
    states = {"": (0, "", [])}

    def better(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def emit(state, role):
        if role == "s":
            return "s" if state == "" else None
        if role == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if role == "a" and state == "u" else None

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for name in ("user", "assistant"):
                    to = emit(state, name[0])
                    if to:
                        better(out, to, (cost + 2, audit + "I", [*lines, name + ":"]))
        return out

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in inserted(states).items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            to = emit(state, role[:1])
            if to:
                better(after, to, (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                to = emit(state, name[0])
                if to:
                    better(after, to, (cost + 2 + extra, audit + "R", [*lines, f"{name}:{text}"]))
        states = after
    ends = [v for k, v in inserted(states).items() if k in ("", "a")]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    counts = tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    by_id = {}
    for conv, *rest in rows:
        by_id.setdefault(conv, []).append(tuple(rest))
    return {conv: brute(r) for conv, r in by_id.items()}


def drawn(seed, conversations_, longest):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "And", "", " \t", "Why? ", "Long text.\n", "…", "x\x0b", "ok.\x00"]
    out = []
    for conv in range(conversations_):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", "", None])
            if draw.random() < 0.5:
                role = ("user", "assistant")[turn % 2]
            text = draw.choice(texts) if draw.random() < 0.4 else f"turn {turn} {draw.choice(['.', '?', ''])}"
            out.append((conv, draw.choice([turn, turn, turn, None, turn + 3]), role, draw.choice([text, text, text, None])))
    return out


def check(spark, rows):
    got = conversations.repair(spark.createDataFrame(rows, TURNS)).collect()
    want = expected(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_short_conversations(spark):
    check(spark, drawn(1, 400, 7))


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_chunked_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    check(spark, drawn(bits + 2, 40, 40) + [(None, t, "user", "Hm") for t in (1, None, 5)])


def test_conversation_over_many_partitions(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Row {t // 3}" + "."[:t % 5]) for t in range(6000)]
    rows += [(1, 7000, "user", "Same.")] * 500 + [(0, 1, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    check(spark, rows)


def test_repaired_rows(spark):
    data = drawn(9, 60, 12)
    rows = conversations.ordered(spark.createDataFrame(data, TURNS))
    _, _, audits = conversations.plan_repairs(rows)
    edits = conversations.repaired_turns(rows, audits).orderBy("conv_id", "step").collect()
    want = expected(data)
    for conv in want:
        mine = [e for e in edits if e.conv_id == conv]
        lines = "\n".join(f"{e.role}:{e.text}" for e in mine if e.role is not None)
        assert "".join(e.edit for e in mine) == want[conv][6]
        assert hashlib.sha256(lines.encode()).hexdigest() == want[conv][7]


def test_hard_tables(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, None, None), (None, 1, "user", "A."), (5, 1, "user", "x" * 300_000), (5, 1, "user", "x" * 300_000),
            (6, -3, "assistant", "Ünïcode 漢字。"), (6, 2**40, "system", "."), (7, 1, "s", "."), (8, 1, "User", "?")]
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in (
        "at", "first", "chunk", "codes", "audit", "state", "tie", "print", "fault", "kind", "copy", "_conv", "ends", "n")})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(frame).collect()}
    assert got == expected(rows)
    none = spark.createDataFrame([], TURNS)
    assert conversations.repair(none).count() == 0
    only = conversations.repair(none, spark.createDataFrame([(3, 1, "user", "x")], TURNS)).collect()
    assert [tuple(r) for r in only] == [(3, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(10)]
    rows += [(None, None, None, None), (1, None, "user", None)]
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind:
            row = (conv, turn, "user" if kind == 4 else role,
                   "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    got = conversations.damage(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(out, key=repr)
