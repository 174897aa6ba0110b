"""Resampling of documents towards a target collection, by hashed features of words and word pairs.

The text is lower-cased in ASCII and split by an untrained ``Split`` of the ``tokenizers`` library, which returns each
word with its offsets. Windows over one or two neighbouring offsets are the features; the CRC-32 of a feature, modulo
the number of buckets, is its bucket. Each text is split once: its buckets are stored, two bytes each.

Two histograms (documents and target) give every bucket a gain, the logarithm of how much likelier it is in the target.
They have a fixed number of buckets, so they alone pass through the driver. A document's weight is the mean gain of its
features; a Gumbel term drawn from a digest of its id makes the highest scores a sample without replacement.

Ranks come without a global sort: scores are whole numbers of a bounded range, so the number of documents above each
score is a small table; inside a score, ids are counted by stretches of 2^20, and rows are numbered inside a stretch.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow, slices
from linkloom.session import cut

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BUCKETS = 10_000
STRETCH_BITS = 20  # ids of one score are numbered in stretches of so many values
PIECE = 1 << 14  # characters that go through the library at once; a piece ends where a word ends
_BREAK = re.compile("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_splitter = None


def splitter():
    """The pre-tokenizer, made once for each worker."""
    global _splitter
    if _splitter is None:
        from tokenizers import Regex, pre_tokenizers

        _splitter = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    return _splitter


def word_offsets(text: str):
    """``(word, (start, end))`` of the words of a lower-cased text, in order; long texts go through the library in pieces."""
    at, split = 0, splitter().pre_tokenize_str
    while at < len(text):
        stop = _BREAK.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        for word, (a, b) in split(text[at:end] if at or stop else text):
            yield word, (at + a, at + b)
        at = end


def feature_buckets(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every word and every pair of neighbouring words."""
    crc, out, before = zlib.crc32, [], None
    n = 0
    for n, (word, _) in enumerate(word_offsets(text.translate(_LOWER) if not text.islower() else text), 1):
        raw = word.encode()
        one = crc(raw)
        out.append(one % buckets)
        if before is not None:
            out.append(crc(raw, before) % buckets)
        before = crc(b" ", one)
    return n, np.array(out, dtype=np.uint16 if buckets <= 65536 else np.uint32)


def noise(doc_id, seed: int = 7) -> int:
    """The Gumbel term of an id in thousandths, from its digest; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _cells(texts: DataFrame, key: str, buckets: int) -> DataFrame:
    """``(id, n_words, n_features, cells)``: the buckets of each text, little-endian."""
    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            made = [feature_buckets(t or "", buckets) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array([len(b) for _, b in made], pa.int64()),
                 pa.array([b.tobytes() for _, b in made], pa.binary())], names=["id", "n_words", "n_features", "cells"])

    return map_arrow(texts, run, f"id {key}, n_words long, n_features long, cells binary")


def _kind(buckets: int):
    return np.uint16 if buckets <= 65536 else np.uint32


def histogram(cells: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds: one row per bucket and task, summed, ``buckets`` numbers on the driver."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("cells"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), _kind(buckets)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    found = map_arrow(cells.select("cells"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down; one feature is added to every bucket on both sides."""
    n, s, t = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(docs.tolist(), target.tolist(), strict=True)],
                    dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """``(id_col, n_words, n_features, weight, score, rank)`` for every row of ``docs``.

    Of the N rows with ``least_words`` words or more the ``percent * N // 100`` with the highest scores get ranks 1, 2, ...;
    ties go to the smaller id (null first), then to the row with fewer features, then to the smaller weight. All other
    rows have a null rank. Null and empty texts have no words, no features and weight 0. Repeated rows are rows of
    their own. An empty target gives every bucket the gain against nothing; an empty table gives no rows. Other
    columns, whatever their names, are left behind. Memory follows the longest text.
    """
    key = docs.schema[id_col].dataType.simpleString()
    cells = cut(_cells(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), key, buckets))
    aims = _cells(target.select(F.lit(0).cast("long").alias("id"), F.col(target_col).cast("string").alias("text")), "long", buckets)
    gain = gains(histogram(cells, buckets), histogram(aims, buckets))  # ``buckets`` numbers, whatever the input

    def weigh(batches):
        for part in slices(batches, "cells"):
            sizes = part.column("n_features").to_numpy()
            flat = np.frombuffer(b"".join(part.column("cells").to_pylist()), _kind(buckets))
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            extra = np.array([noise(i, seed) for i in part.column("id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "n_words", "n_features")], pa.array(weight), pa.array(weight + extra)],
                                             names=["id", "n_words", "n_features", "weight", "score"])

    scored = cut(map_arrow(cells, weigh, f"id {key}, n_words long, n_features long, weight long, score long"))
    out = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    able = scored.filter(F.col("n_words") >= least_words)
    per_score = cut(able.groupBy("score").agg(F.count("*").alias("n")))
    wanted = (per_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    if not wanted:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    # scores lie in a range that the numbers of buckets and hash values bound: a small table however many rows there are
    above = per_score.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).filter(F.col("above") < wanted)
    least = above.agg(F.min("score")).first()[0]
    top = able.filter(F.col("score") >= least).withColumn("stretch", F.floor(F.col("id").try_cast("long") / (1 << STRETCH_BITS)))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_first("stretch"))
    stretches = top.groupBy("score", "stretch").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(order) - F.col("n"))
    starts = stretches.join(above.select("score", "above"), "score").select(
        F.col("score").alias("s"), F.col("stretch").alias("t"), (F.col("above") + F.col("before")).alias("before"))
    inside = Window.partitionBy("score", "stretch").orderBy(F.asc_nulls_first("id"), "n_features", "weight", "n_words")
    ranked = top.withColumn("place", F.row_number().over(inside)).join(
        starts, (F.col("score") == F.col("s")) & F.col("stretch").eqNullSafe(F.col("t")))
    place = F.col("before") + F.col("place")
    ranked = ranked.select(*out, F.when(place <= wanted, place).cast("long").alias("rank"))
    rest = scored.filter((F.col("n_words") < least_words) | (F.col("score") < least))
    return ranked.unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes as a SQL expression; it needs the table ``crc(t)`` of ``crc_table_sql``."""
    digit = lambda k: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + {k}, 1)) - 1)"
    raw = f"list_transform(range(0, octet_length(encode({text}))), lambda i: {digit(1)} * 16 + {digit(2)})"
    step = "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {raw}), {step}), 4294967295::BIGINT)"


def crc_table_sql() -> str:
    """The byte table of CRC-32, from its rule."""
    shift = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    return f"SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: {shift}) ORDER BY b) AS t FROM range(256) AS r(b)"


def resample_sql(percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> str:
    """The same as SQL for unique ids, over ``documents`` and ``benchmark``."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH crc AS ({crc_table_sql()}),
d AS (SELECT doc_id, {words} AS w FROM documents), q AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS k FROM (SELECT doc_id, unnest(list_concat(w, {pairs})) AS f FROM d) GROUP BY ALL),
qf AS (SELECT f, count(*) AS k FROM (SELECT unnest(list_concat(w, {pairs})) AS f FROM q) GROUP BY ALL),
b AS (SELECT f, {crc32_sql('f')} % {buckets} AS b FROM (SELECT DISTINCT f FROM df UNION SELECT f FROM qf) x, crc),
s AS (SELECT b, sum(k)::BIGINT AS s FROM df JOIN b USING (f) GROUP BY b), t AS (SELECT b, sum(k)::BIGINT AS t FROM qf JOIN b USING (f) GROUP BY b),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t),
g AS (SELECT b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (z.s + {buckets}) / ((coalesce(s.s, 0) + 1)::DOUBLE * (z.t + {buckets}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (b), z),
m AS (SELECT doc_id, sum(k)::BIGINT AS n, sum(k * gain)::BIGINT AS total FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n)::BIGINT, 0) AS weight,
  ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_words >= {least_words}),
k AS (SELECT count(*) * {percent} // 100 AS k FROM r)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id), k"""
