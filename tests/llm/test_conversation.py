import hashlib
import itertools
import random
import re
import zlib

import pytest

from linkloom.llm import conversation as c
from tests.llm.helpers import clashing, rows

GOOD = re.compile(r"(s?(ua)+)?")
COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def least_edits(codes):
    """All edit strings by growing cost and then by letters: the first that reads as it should."""
    best = None

    def go(i, cost, ops, roles, inserted):
        nonlocal best
        if best and (cost, "") > best[:1] + ("",) and cost > best[0]:
            return
        if i == len(codes) and GOOD.fullmatch(roles) and (best is None or (cost, ops) < best):
            best = (cost, ops)
        if inserted < 3:
            for r in "ua":
                go(i, cost + 3, ops + "I", roles + r, inserted + 1)
        if i < len(codes):
            initial, fault = "sua?"[codes[i] % 4], codes[i] // 4
            go(i + 1, cost + 4, ops + "D", roles, 0)
            if fault not in (1, 2):
                late = 3 if fault == 3 else 0
                if initial != "?":
                    go(i + 1, cost + late, ops + "K", roles + initial, 0)
                for r in "ua":
                    go(i + 1, cost + late + 3, ops + "R", roles + r, 0)

    go(0, 0, "", "", 0)
    return best or (0, "")


def table_edits(codes):
    """Cheapest and least edits by a whole table of strings."""
    now = {0: (0, "")}
    for code in codes:
        new = {}
        for p, (cost, ops) in now.items():
            for q, more, step in c.WAYS[code][p]:
                way = (cost + more, ops + step)
                new[q] = min(new.get(q, way), way)
        now = new
    return min((cost + c._END[q][0], ops + c._END[q][1]) for q, (cost, ops) in now.items())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_conversations_exhaustively(n):
    for codes in itertools.product(range(16), repeat=n):
        assert c.repair(bytes(codes)) == least_edits(codes), codes


def test_random_conversations():
    rnd = random.Random(5)
    for _ in range(60):
        codes = bytes(rnd.choice([0, 1, 2, 3, 1, 2, 5, 6, 9, 13, 14]) for _ in range(3))
        assert c.repair(codes) == least_edits(codes), codes
    for _ in range(400):
        codes = bytes(rnd.randrange(16) for _ in range(rnd.randrange(1, 60)))
        assert c.repair(codes) == table_edits(codes), codes


def test_long_conversation():
    rnd = random.Random(6)
    codes = bytes(rnd.randrange(16) for _ in range(20_000))
    cost, audit = c.repair(codes)
    assert len(audit.replace("I", "")) == len(codes) and cost == table_edits(codes[:20_000])[0]


def brute(data):
    """The same over rows ``(conv, turn, role, text)``."""
    text = lambda v: " " if v is None else str(v)
    out = []
    for conv in {r[0] for r in data}:
        told = []
        for _, turn, role, body in (r for r in data if r[0] == conv):
            role, body = text(role), text(body)
            kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
            body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
            told += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(body.encode()).hexdigest(), body)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        told.sort()
        codes, seen, n = [], set(), [0] * 4
        for _, _, role, _, body in told:
            last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", body)
            fault = 1 if not last else 2 if (role, body) in seen else 3 if last[1] not in ".!?" else 0
            seen.add((role, body))
            n[fault] += 1
            codes.append(("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + 4 * fault)
        cost, audit = table_edits(codes) if codes else (0, "")
        lines, state, at = [], "", 0
        for op in audit:
            need = "assistant" if state[-1:] == "u" else "user"
            if op == "I":
                lines.append(f"{need}:")
            else:
                role, body = told[at][2], told[at][4]
                at += 1
                if op == "D":
                    continue
                lines.append(f"{need if op == 'R' else role}:{body}")
            state += lines[-1][0]
        assert GOOD.fullmatch(state)
        turns = {t[1] for t in told if t[0]}
        firsts = [t[2][:1] for t in told]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n[1:], sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


ODD = [(None, 0, "user", "hello there."), (None, 1, "assistant", "yes."), (None, None, "user", "no turn"), (1, None, None, None), (1, None, "user", "a"), (1, 5, "", ""),
       (1, 5, "", ""), (1, 6, "assistant", " \t\n\x0b\x0c\r"), (1, 7, "usher", "ends. \n"), (1, 9, "tool", "x?"), (1, -3, "system", "be good!"), (2, 0, "user", "Q?"),
       (2, 0, "user", "Q?"), (2, 0, "assistant", "Q?"), (3, 4, None, "日本語。"), (3, 5, "assistant", "é" * 1000 + "."), (4, 1, "user", "x " * 300_000 + " ")]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    data = ODD + ODD[:3] + [(k, t, ("user", "assistant")[t % 2], f"{t % 9} ok.") for k in range(10, 60) for t in range(7)]
    got = rows(c.repair_conversations(clashing(spark.createDataFrame(data, schema)).withColumnsRenamed({})), *COLS)
    assert got == brute(data)
    assert c.repair_conversations(spark.createDataFrame([], schema)).count() == 0


def test_one_long_conversation_over_many_stretches(spark):
    rnd = random.Random(8)
    data = [(7, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", f"{t}!", "", f"{t % 50}?"])) for t in range(5000)] + ODD
    got = rows(c.repair_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")), *COLS)
    assert got == brute(data)
