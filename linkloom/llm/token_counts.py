"""Token counts of fields and sections, from one encoding of the whole document.

Counting each section by itself gives other numbers than the model sees: tokens depend on what stands before them.
Here the document is encoded once, tokens get character spans, and each span is joined to the sections it overlaps. A
token that crosses a boundary is given away by a rule:

* ``first``: to the section of its first character; ``last``: to that of its last character;
* ``most``: to the section that holds most of its characters, the earlier one on a tie;
* ``share``: to each section by the share of its characters.

Sections are sorted and do not overlap, so the join is a binary search in the sorted starts of the same document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow, slices
from linkloom.llm.bpe import encoder, vocabulary_path

RULES = ("first", "last", "most", "share")


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a text; a line keeps its line break, so the lines cover the text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    starts = starts[starts < len(raw)]
    return starts, np.concatenate([starts[1:], [len(raw)]])


def allocate(starts, ends, tok_starts, tok_ends, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, tokens in it that also touch something else, and tokens outside every section."""
    n = len(starts)
    tokens, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n:
        return tokens, crossing, float(len(tok_starts))
    # first and last section that a token overlaps
    lo, hi = np.searchsorted(ends, tok_starts, "right"), np.searchsorted(starts, tok_ends, "left") - 1
    outside = 0.0
    inside = (lo == hi) & (tok_starts >= starts[np.minimum(lo, n - 1)]) & (tok_ends <= ends[np.minimum(hi, n - 1)])
    tokens += np.bincount(lo[inside], minlength=n)
    for t in np.flatnonzero(~inside):
        a, b, s, e = lo[t], hi[t], tok_starts[t], tok_ends[t]
        crossing[a : b + 1] += 1
        parts = {int(k): float(min(e, ends[k]) - max(s, starts[k])) for k in range(a, b + 1)}
        rest = float(e - s) - sum(parts.values())
        if rule == "share":
            for k, v in parts.items():
                tokens[k] += v / float(e - s)
            outside += rest / float(e - s)
            continue
        at = s if rule == "first" else e - 1
        if rule == "most":
            k = max(parts, key=lambda k: (parts[k], -k)) if parts else None
            k = k if parts and parts[k] >= rest else None
        else:
            k = next((k for k in parts if starts[k] <= at < ends[k]), None)
        if k is None:
            outside += 1
        else:
            tokens[k] += 1
    return tokens, crossing, outside


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None,
                   rule: str = "first", path: str | None = None) -> DataFrame:
    """``(id_col, section, start_char, end_char, n_tokens, n_crossing, doc_tokens)``, one row per section of a row.

    ``sections_col`` is an array of structs with ``start`` and ``end`` in code points, sorted and without overlap;
    without it the sections are the lines. ``n_tokens`` is a double, whole except under ``share``; over the sections and
    the row ``section = -1`` (what lies outside all sections, given only where tokens do) it sums to ``doc_tokens``.
    A null or empty text has no sections and gives one row with section -1 and no tokens. Null ids and repeated rows
    stay rows of their own; empty sections have no tokens; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    place = path or vocabulary_path()
    key = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if sections_col:
        cols += [F.col(sections_col)["start"].alias("starts"), F.col(sections_col)["end"].alias("ends")]

    def run(batches):
        enc = encoder(place)
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            given = zip(part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True) if sections_col else None
            take, rows = [], [[] for _ in range(6)]
            for i, (text, ids) in enumerate(zip(texts, enc.encode(texts), strict=True)):
                s, e = map(lambda x: np.array(x or [], np.int64), next(given)) if sections_col else line_sections(text)
                tokens, crossing, outside = allocate(s, e, *enc.offsets(text, ids), rule)
                index = np.arange(len(s))
                if outside or not len(s):
                    index, s, e = np.append(index, -1), np.append(s, 0), np.append(e, len(text))
                    tokens, crossing = np.append(tokens, outside), np.append(crossing, 0)
                take.append(np.full(len(index), i))
                for r, v in zip(rows, (index, s, e, tokens, crossing, np.full(len(index), len(ids) // 4)), strict=True):
                    r.append(v)
            made = [np.concatenate(r) for r in rows]
            made = [pa.array(v.astype(np.float64 if k == 3 else np.int64)) for k, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(np.concatenate(take))), *made],
                                             names=["id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    schema = f"id {key}, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"
    return map_arrow(docs.select(*cols), run, schema).withColumnRenamed("id", id_col)
