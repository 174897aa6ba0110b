"""Repair of conversations whose roles no longer alternate, by divide and conquer in linear space.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles, so four states follow the reader: nothing
yet, after the system message, after a user and after an assistant. Every row is kept, given another role or deleted,
and empty messages may be inserted; the cheapest edits win, and of equally cheap ones those whose initials come first
in ASCII.

The reconstruction is Hirschberg's: costs of the four states run forward to the middle row and backward from the end;
the state in which both halves cost least in sum is the crossing, and both halves are solved alike. Forward vectors
also carry the order of the four best edit strings. No such string is the beginning of another one that ends at the
same row, so that order alone says which of several optimal crossings gives the least string. Only vectors are kept,
never a table of rows by states.

Where it runs: damage and faults are DataFrame functions; texts are reduced to digests before anything is grouped.
Stretches of turns become packed row codes of one byte, in parallel also inside one long conversation. A conversation's
codes meet in one task, which is the size of its edit string, a value of the result. Its texts pass the same task in
order, as a stream, for the digest of the repaired conversation.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.arrays import spread
from linkloom.llm.arrow import map_arrow
from linkloom.session import cut

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NAMES = {2: "user", 3: "assistant"}  # the role by which a state is reached
KEEP, REROLE, DELETE, INSERT, UNREPAIRED = 0, 3, 4, 3, 3
STRETCH = 512  # turns whose rows are packed by one task
CACHE = 50_000  # edit strings of conversations of at most CACHE_ROWS rows kept by a task
CACHE_ROWS = 64
_NEXT = (2, 2, 3, 2)  # the state after an inserted or renamed message
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LETTER = r"[^\x20\x09-\x0D]"


def _row_table() -> list:
    """For each code and state the ways over one row, messages inserted before it included: ``(state, cost, initials)``."""
    table = []
    for code in range(16):
        initial, fault = code % 4, code // 4
        ways = []
        for p in range(4):
            best, state = {}, p
            for k in range(4):
                late = UNREPAIRED if fault == TRUNCATED else 0
                found = [(state, DELETE, "D")]
                if fault not in (BLANK, DUPLICATE):
                    found.append((_NEXT[state], REROLE + late, "R"))
                    if (initial, state) in ((SYSTEM, 0), (USER, 0), (USER, 1), (USER, 3), (ASSISTANT, 2)):
                        found.append((initial + 1, KEEP + late, "K"))
                for q, cost, op in found:
                    best[q] = min(best.get(q, (99, "")), (cost + k * INSERT, "I" * k + op))
                state = _NEXT[state]
            ways.append([(q, *v) for q, v in sorted(best.items())])
        table.append(ways)
    return table


WAYS = _row_table()


def _forward(codes: bytes, start: dict) -> dict:
    """``state -> (cost, rank of its edit string)`` after the rows, from the same before them."""
    now = start
    for code in codes:
        ways, best = WAYS[code], {}
        for p, (cost, rank) in now.items():
            for q, more, ops in ways[p]:
                way = (cost + more, rank, ops)
                if q not in best or way < best[q]:
                    best[q] = way
        order = sorted(best, key=lambda q: best[q][1:])
        now = {q: (best[q][0], i) for i, q in enumerate(order)}
    return now


def _backward(codes: bytes, end: dict) -> dict:
    """``state -> cost`` before the rows, from the same after them."""
    now = end
    for code in reversed(codes):
        before = {}
        for p, ways in enumerate(WAYS[code]):
            costs = [more + now[q] for q, more, _ in ways if q in now]
            if costs:
                before[p] = min(costs)
        now = before
    return now


def _between(codes: bytes, p: int, q: int) -> str:
    """The least of the cheapest edit strings over the rows from state ``p`` to state ``q``."""
    if len(codes) == 1:
        return next(ops for state, _, ops in WAYS[codes[0]][p] if state == q)
    half = len(codes) // 2
    there, back = _forward(codes[:half], {p: (0, 0)}), _backward(codes[half:], {q: 0})
    crossing = min((there[x][0] + back[x], there[x][1], x) for x in there if x in back)[2]
    return _between(codes[:half], p, crossing) + _between(codes[half:], crossing, q)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a conversation, given one code per row: initial plus four times fault."""
    if not codes:
        return 0, ""
    end = _forward(codes, {0: (0, 0)})
    cost, _, last = min((cost + _END[q][0], rank, q) for q, (cost, rank) in end.items())
    return cost, _between(codes, 0, last) + _END[last][1]


def illegal(codes: bytes) -> int:
    """Neighbouring rows whose initials are none of su, ua and au."""
    good = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    return sum((a % 4, b % 4) not in good for a, b in itertools.pairwise(codes))


class Writer:
    """Digest of ``role:text`` lines, taking rows one by one as the edit string says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sum, self.any = audit, 0, 0, hashlib.sha256(), False

    def _line(self, role: str, text: str):
        self.sum.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _NEXT[self.state]
            self._line(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str):
        self._inserts()
        op = self.audit[self.at]
        self.at += 1
        if op == "R":
            self.state = _NEXT[self.state]
            self._line(NAMES[self.state], text)
        elif op == "K":
            self.state = "sua".index(role[0]) + 1
            self._line(role, text)

    def digest(self) -> str:
        self._inserts()
        return self.sum.hexdigest()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` after the damage that the CRC-32 of ``conversation:turn`` decides; nulls count as one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    made = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
                       kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = made.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return spread(made, F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))), "copy", "conv", "turn", "role", "text").drop("copy")


def _stretch(turn):
    return F.floor(turn / STRETCH)


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """``(conv, stretch, codes, least, most, turns)``: the rows of a stretch of turns in order, one byte each."""
    text = F.col("text")
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    light = rows.select(
        "conv", "turn", "role", F.unhex(F.md5(text.cast("binary"))).alias("sum"), (~text.rlike(LETTER)).alias("blank"), (~tail.isin(".", "!", "?")).alias("open"))
    light = light.groupBy("conv", "turn", "role", "sum").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = light.groupBy("conv", "role", "sum").agg(F.min(order).alias("first")).withColumnsRenamed({"conv": "c", "role": "r", "sum": "s"})
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sum") == F.col("s"))
    light = light.join(firsts, same).select("conv", "turn", "role", "sum", "n", "blank", "open", (order != F.col("first")).alias("again"), _stretch(F.col("turn")).alias("stretch"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NONE)
    later = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)  # of further equal rows
    light = light.select("conv", "stretch", "turn", "role", "sum", "n", (code + 4 * fault).alias("code"), (code + 4 * later).alias("later"))
    light = light.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", F.asc_nulls_first("turn"), "role", "sum")

    def pack(batches):
        names = ["conv", "stretch", "codes", "least", "most", "turns"]

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

        types, now, done = None, None, []
        for batch in batches:
            types = types or [batch.schema.field("conv").type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for conv, stretch, turn, n, one, more in zip(*[batch.column(c).to_pylist() for c in ("conv", "stretch", "turn", "n", "code", "later")], strict=True):
                if now is None or now[:2] != [conv, stretch]:
                    if now:
                        done.append([*now[:2], bytes(now[2]), *now[3:]])
                    now = [conv, stretch, bytearray(), turn, turn, 0]
                    fresh = True
                now[2] += bytes([one]) + bytes([more]) * (n - 1)
                if turn is not None:
                    now[5] += fresh or turn != now[4]
                    now[4] = turn
                fresh = False
            if len(done) > 1000:
                yield out(done)
                done = []
        if now:
            yield out([*done, [*now[:2], bytes(now[2]), *now[3:]]])

    return map_arrow(light.select("conv", "stretch", "turn", "n", "code", "later"), pack, f"conv {key}, stretch long, codes binary, least long, most long, turns long")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         damaged: bool = True) -> DataFrame:
    """``(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every conversation in ``rows``.

    With ``damaged`` the rows are damaged first (see ``damage``); conversations that lose all rows have zeros, an empty
    edit string and the digest of nothing. Rows are taken by turn, null turns first, then by role and by the MD5 of the
    text. A null conversation id is a conversation of its own; null roles and texts are one blank. Repeated rows are
    duplicates but the first. An empty table gives no rows; other columns are left behind.
    """
    key = rows.schema[conv_col].dataType.simpleString()
    if damaged:
        told = damage(rows, conv_col, turn_col, role_col, text_col)
    else:
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        told = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    packed = _packed(told, key)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    first = packed.select("conv", F.lit(0).alias("part"), F.col("stretch").alias("turn"), *none("binary", "sum"), *none("string", "role", "text"), "codes", "least", "most", "turns")
    texts = told.select("conv", F.lit(1).alias("part"), "turn", F.unhex(F.md5(F.col("text").cast("binary"))).alias("sum"), "role", "text", *none("binary", "codes"),
                        *none("long", "least", "most", "turns"))
    stream = first.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "part", F.asc_nulls_first("turn"), "role", "sum")
    stream = stream.select("conv", "part", "role", "text", "codes", "least", "most", "turns")

    def solve(batches):
        known: dict[bytes, tuple[int, str]] = {}
        kind, done, name, codes, span, writer, cost = None, [], None, None, None, None, 0

        def best():
            row_codes = bytes(codes)
            if len(row_codes) > CACHE_ROWS:
                return repair(row_codes)
            if row_codes not in known:
                if len(known) >= CACHE:
                    known.clear()
                known[row_codes] = repair(row_codes)
            return known[row_codes]

        def close():
            faults = np.bincount(np.frombuffer(codes, np.uint8) >> 2, minlength=4).tolist()
            gaps = span[1] - span[0] + 1 - span[2] if span[0] is not None else 0
            done.append((name, gaps, *faults[1:], illegal(codes), cost, writer.audit, writer.digest()))

        def out():
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)],
                                              names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, part, role, text, some, least, most, turns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part == 0:
                    if writer is not None or codes is None:  # the rows before belong to another conversation
                        if codes is not None:
                            close()
                        name, codes, span, writer = conv, bytearray(), [None, None, 0], None
                    codes += some
                    if least is not None:
                        span = [least if span[0] is None else span[0], most, span[2] + turns]
                else:
                    if writer is None:
                        cost, audit = best()
                        writer = Writer(audit)
                    writer.row(role, text)
            if len(done) > 1000:
                yield out()
                done.clear()
        if codes is not None:
            close()
            yield out()

    found = map_arrow(stream, solve, f"conv {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    found = cut(found)
    every = rows.select(F.col(conv_col).alias("c")).distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("c").eqNullSafe(F.col("conv")), "left").select(
        F.col("c").alias(conv_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair_sql(table: str = "conversations") -> str:
    """The same as SQL: the cheapest way to each of the four states, row by row, with its edits and texts written out."""
    from linkloom.llm.resampling import crc32_sql, crc_table_sql

    way = lambda v, cost, op, line="''": f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{op}', 't': {v}.t || {line}}}"
    least = lambda *ways: f"list_sort([{', '.join(ways)}])[1]"
    line = lambda role: f"chr(10) || {role} || ':' || text"
    late = f"(CASE WHEN fault = {TRUNCATED} THEN {UNREPAIRED} ELSE 0 END)"
    barred = f"CASE WHEN fault IN ({BLANK}, {DUPLICATE}) THEN 1000000000::BIGINT ELSE 0 END"
    kept = lambda v, ini: way(v, f"{late} + {barred} + CASE WHEN ini = {ini} THEN 0 ELSE 1000000000::BIGINT END", "K", line("role"))
    named = lambda v, role: way(v, f"{REROLE} + {late} + {barred}", "R", line(f"'{role}'"))
    gone = lambda v: way(v, DELETE, "D")
    added = lambda v, role: way(v, INSERT, "I", f"chr(10) || '{role}:'")
    letter = r"[^\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE crc AS ({crc_table_sql()}),
k AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM {table}),
r AS (SELECT k.*, {crc32_sql('name')} % 20 AS kind FROM k, crc),
d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM r WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS ini,
  CASE WHEN NOT regexp_matches(text, '{letter}') THEN {BLANK} WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN {DUPLICATE}
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN {TRUNCATED} ELSE {NONE} END AS fault FROM o),
w AS (
  SELECT c, 0 AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v0, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS v1, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS v2,
    {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS v3 FROM (SELECT DISTINCT c FROM f)
  UNION ALL
  SELECT c, i, {gone('v0')}, {least(gone('v1'), kept('v0', 0))},
    {least(gone('x2'), kept('v0', 1), kept('v1', 1), kept('x3', 1), named('v0', 'user'), named('v1', 'user'), named('x3', 'user'))},
    {least(gone('x3'), kept('x2', 2), named('x2', 'assistant'))}
  FROM (SELECT *, {least('y2', added('x3', 'user'))} AS x2 FROM (SELECT *, {least('v3', added('y2', 'assistant'))} AS x3 FROM (
    SELECT f.*, v0, v1, v2, v3, {least('v2', added('v0', 'user'), added('v1', 'user'), added('v3', 'user'))} AS y2
    FROM w JOIN f ON f.c IS NOT DISTINCT FROM w.c AND f.i = w.i + 1) p) q) s),
e AS (SELECT c, {least('v0', 'v3', added('u1', 'assistant'), added('v2', 'assistant'))} AS v
  FROM (SELECT w.*, {added('w.v1', 'user')} AS u1, w.i = max(w.i) OVER (PARTITION BY w.c) AS last FROM w) WHERE last),
n AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND (before || ini) NOT IN ('01', '12', '21')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) AS before FROM f) GROUP BY c)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {table}) z LEFT JOIN n ON n.c IS NOT DISTINCT FROM z.conv_id LEFT JOIN e ON e.c IS NOT DISTINCT FROM z.conv_id"""
