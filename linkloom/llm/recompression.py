"""Removal of long repeated passages of words, found by recompression.

A document is a sequence of words, each named by a 128-bit hash. A round of recompression first names every run of one
symbol, then every pair of neighbours of which the left one falls on one side and the right one on the other; the side
is a bit of the symbol's own name. Names are hashes of what they stand for, hence global: every task gives the same
run or pair the same name without a dictionary that would have to travel. Equal passages thus get equal symbols inside,
whatever stands around them; the words on which a symbol depends are kept with it, so it is known exactly which symbols
are interior to a passage.

Spark's rounds then work on symbols, from many words to few:

1. Every window of ``window`` words has an anchor, the interior symbol of smallest hash (where runs leave no interior
   symbol, a word), known by the words it depends on. Neighbouring windows share anchors; the words of all windows of one
   anchor are a block. Equal windows have equal anchors. Blocks, about one for 15 words, are counted by anchor and by
   128-bit digest of the block.
2. A block that an earlier document holds whole is a verified repeat: all its windows go. This settles copies and the
   inside of common passages, with one grouped minimum that is combined before it travels.
3. Where one anchor has several different blocks, at the ends of passages and around edits, windows of one document for
   each such block are compared by their own digests.

Every window is settled in round 2 or 3, so the result is that of comparing all windows; no group is ever listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow, slices
from linkloom.llm.prefilter import may_be_in
from linkloom.session import cut

WINDOW = 50
ROUNDS = 3
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_names(texts) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the words of an Arrow column, a row of two numbers each, and where each text's begin (one more at the end)."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    different = coded.dictionary.to_pylist()
    names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in different), np.uint64).reshape(-1, 2)
    real = np.fromiter((w != "" for w in different), dtype=bool, count=len(different))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(count)), count)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    held = np.bincount(owner[keep], minlength=len(count)) if len(codes) else np.zeros(len(count), np.int64)
    return (names[codes[keep]] if len(codes) else np.zeros((0, 2), np.uint64)), np.concatenate([[0], np.cumsum(held)]).astype(np.int64)


class Symbols:
    """Symbols of several documents in a row: name, document, first word, and the stretch of words each depends on."""

    def __init__(self, names: np.ndarray, at: np.ndarray):
        n = len(names)
        self.name, self.doc = names, np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.start = np.arange(n)
        self.left, self.right = np.arange(n), np.arange(1, n + 1)
        self.bounds = at

    def _outside(self):
        """What a symbol depends on through its left and right neighbour; a document's ends count as words outside."""
        new = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        last = np.concatenate([new[1:], [True]])
        left = np.where(new, self.bounds[self.doc] - 1, np.concatenate([[0], self.left[:-1]]))
        right = np.where(last, self.bounds[self.doc + 1] + 1, np.concatenate([self.right[1:], [0]]))
        return new, left, right

    def runs(self, step: int):
        """Name runs of one symbol; a run depends on both its neighbours, which end it."""
        if not len(self.name):
            return
        new, left, right = self._outside()
        head = new | np.concatenate([[True], self.name[1:] != self.name[:-1]])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(head)))
        last = first + size - 1
        named = np.where(size > 1, _mix(self.name[first] * _A + size.astype(np.uint64) * _B + np.uint64(step)), self.name[first])
        self.name, self.doc, self.start, self.left, self.right = named, self.doc[first], self.start[first], left[first], right[last]

    def pairs(self, step: int):
        """Name neighbours of which the left one is on the first side and the right one on the second."""
        if not len(self.name):
            return
        new, left, right = self._outside()
        second = (_mix(self.name + np.uint64(step) * _C) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(second), bool)  # with its left neighbour
        joins[1:] = ~second[:-1] & second[1:] & ~new[1:]
        first = np.flatnonzero(~joins)
        size = np.diff(np.append(first, len(joins)))
        last = first + size - 1
        pair = size > 1
        named = np.where(pair, _mix((self.name[first] * _A) ^ (self.name[last] * _B + np.uint64(step) + _C)), self.name[first])
        # one that stays alone depends on the neighbour it could have been paired with
        alone_second = ~pair & second[first]
        self.left = np.where(alone_second, left[first], self.left[first])
        self.right = np.where(pair | alone_second, self.right[last], right[first])
        self.name, self.doc, self.start = named, self.doc[first], self.start[first]


def _least(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest of ``keys[first..last]`` for each pair, by tables of minima over powers of two."""
    out = np.zeros(len(first), keys.dtype)
    level = np.frompyfunc(int.bit_length, 1, 1)(last - first + 1).astype(np.int64) - 1 if len(first) else np.zeros(0, np.int64)
    table = keys
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        now = np.flatnonzero(level == k)
        out[now] = np.minimum(table[first[now]], table[last[now] - (1 << k) + 1])
    return out


def anchors(names: np.ndarray, at: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """``(doc, anchor, lo, hi)``: stretches of window starts, by word number in the batch, that share an anchor."""
    words = Symbols(names[:, 0], at)
    high = Symbols(names[:, 0], at)
    for step in range(rounds):
        high.runs(2 * step + 1)
        high.pairs(2 * step + 2)
    size = np.maximum(np.diff(at) - window + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    starts = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
    picked, begin, end = (np.zeros(len(starts), np.int64) for _ in range(3))
    todo = np.ones(len(starts), bool)
    for sym, salt in ((high, _A), (words, _B)):
        first = np.searchsorted(sym.left, starts[todo], "left")
        last = np.searchsorted(sym.right, starts[todo] + window, "right") - 1
        inner = first <= last
        keys = (_mix(sym.name ^ salt) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(sym.name), dtype=np.uint64)
        which = (_least(keys, first[inner], last[inner]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        here = np.flatnonzero(todo)[inner]
        picked[here], begin[here], end[here] = sym.start[which] * 2 + (sym is words), sym.left[which], sym.right[which]
        todo[here] = False
        if not todo.any():
            break
    if not len(starts):
        return doc, starts, starts, starts
    head = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])]))
    tail = np.append(head[1:], len(starts)) - 1
    return doc[head], _digests(names, begin[head], end[head])[:, 0], starts[head], starts[tail]


def _digests(names: np.ndarray, first, stop) -> np.ndarray:
    """Digests of stretches of words, a row of two numbers each."""
    import xxhash

    raw, digest = memoryview(names.tobytes()), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(raw[16 * a : 16 * b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.int64).reshape(-1, 2)


def _blocks(texts: DataFrame, key: str, window: int, rounds: int) -> DataFrame:
    """``(id, th, x, b1, b2, lo, n)``: anchor, digest, first window and number of windows of every block."""
    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            names, at = word_names(part.column("text"))
            with np.errstate(over="ignore"):
                doc, x, lo, hi = anchors(names, at, window, rounds)
            body = _digests(names, lo, hi + window)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(rows), part.column("th").take(rows), pa.array(x), pa.array(body[:, 0]), pa.array(body[:, 1]),
                 pa.array((lo - at[doc]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32))], names=["id", "th", "x", "b1", "b2", "lo", "n"])

    return map_arrow(texts, run, f"id {key}, th long, x long, b1 long, b2 long, lo int, n int")


def _windows(work: DataFrame, key: str, window: int) -> DataFrame:
    """``(id, th, w1, w2, lo)``: the digests of the windows of the stretches ``todo`` of each text."""
    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            names, at = word_names(part.column("text"))
            ids, starts, rows = part.column("todo").to_pylist(), [], []
            for i, spans in enumerate(ids):
                for s in spans:
                    starts.append(np.arange(s["lo"], s["lo"] + s["n"]) + at[i])
                    rows.append(np.full(s["n"], i))
            if not starts:
                continue
            starts, rows = np.concatenate(starts), np.concatenate(rows)
            body = _digests(names, starts, starts + window)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows)), part.column("th").take(pa.array(rows)), pa.array(body[:, 0]), pa.array(body[:, 1]),
                 pa.array((starts - at[rows]).astype(np.int32))], names=["id", "th", "w1", "w2", "lo"])

    return map_arrow(work, run, f"id {key}, th long, w1 long, w2 long, lo int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``(id, th, spans)``: for each text with repeated windows the stretches ``lo, n`` of their starts, counted in words.

    ``th`` is the hash of the text; rows that agree in id and text are one document.
    """
    key = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    blocks = cut(_blocks(texts, key, window, rounds))
    counted = blocks.groupBy("x", "b1", "b2").agg(F.min("id").alias("first"), F.count("*").alias("k"))
    counted = cut(counted)
    various = counted.groupBy("x").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("x").alias("vx"))
    told = counted.join(various, F.col("x") == F.col("vx"), "left").filter("k > 1 or vx is not null")
    told = cut(told.select("x", "b1", "b2", "first", F.col("vx").isNotNull().alias("open")))
    seen = blocks.join(told, ["x", "b1", "b2"])
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    seen = cut(seen.select("id", "th", "lo", "n", "open", later.alias("later")).filter("later or open"))
    span = F.struct("lo", "n")
    # windows of the first holder of each block that other blocks of its anchor may share
    own = seen.filter("open and not later").groupBy("id", "th").agg(F.collect_set(span).alias("todo"))
    own = cut(own.withColumnsRenamed({"id": "o_id", "th": "o_th"}))
    same = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th"))
    holders = texts.filter(may_be_in(own, ["o_id", "o_th"], ["id", "th"])).dropDuplicates(["id", "th"])
    single = cut(_windows(holders.join(own, same).select("id", "th", "text", "todo"), key, window))
    least = single.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1 and first is not null").select("w1", "w2", "first")
    again = single.join(least, ["w1", "w2"]).filter(later).select("id", "th", "lo", F.lit(1).alias("n"))
    spans = seen.filter("later").select("id", "th", "lo", "n").unionByName(again)
    return spans.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``(id_col, n_words, n_removed, kept, kept_sha256)`` for every row: words of repeated windows are gone from ``kept``.

    Words are runs without ASCII white space. A window of ``window`` words is repeated where the same words also stand in
    a row with a smaller id; a null id is larger than any other, and rows of one id never repeat each other. Windows are
    judged on the input. ``kept`` joins the remaining words by one blank. Null, empty and blank texts have no words and
    the digest of nothing; repeated rows are treated alike; an empty table gives no rows; other columns are left behind.
    Memory follows the longest text.
    """
    key = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    gone = cut(repeated_spans(docs, id_col, text_col, window, rounds).withColumnsRenamed({"id": "g_id", "th": "g_th"}))
    hit = may_be_in(gone, ["g_id", "g_th"], ["id", "th"])
    same = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th"))
    kind = "array<struct<lo:int,n:int>>"
    found = texts.filter(hit).join(gone, same, "left").select("id", "text", "spans")
    every = texts.filter(~hit).select("id", "text", F.lit(None).cast(kind).alias("spans")).unionByName(found)

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            out = {"n_words": [], "n_removed": [], "kept": [], "kept_sha256": []}
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    for s in spans:
                        edge[s["lo"]] += 1
                        edge[s["lo"] + s["n"] - 1 + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                for name, value in (("n_words", n), ("n_removed", n - len(words)), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(v, types[k]) if k != "kept" else pa.array(v, pa.binary()).cast(pa.string()) for k, v in out.items()]],
                                             names=["id", *out])

    made = map_arrow(every, run, f"id {key}, n_words long, n_removed long, kept string, kept_sha256 string")
    return made.withColumnRenamed("id", id_col)


def remove_substrings_sql(table: str = "documents", window: int = WINDOW) -> str:
    """The same as SQL for unique ids, comparing the digests of all windows."""
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM t)),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM v),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
y AS (SELECT x.doc_id, x.word, x.i, max(r.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS UNBOUNDED PRECEDING) AS last
      FROM x LEFT JOIN (SELECT doc_id, i FROM r WHERE again) r ON r.doc_id = x.doc_id AND r.i = x.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (last > i - {window}) AS n_removed,
      sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - {window}), '')) AS kept_sha256 FROM y GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)"""
