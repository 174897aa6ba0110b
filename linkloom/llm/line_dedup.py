"""Repeated passages by content-defined chunks of lines.

A text is split into lines, a digest of each pair of neighbouring lines decides whether a chunk ends after it, and so
boundaries depend on the lines around them only: an insertion moves the chunks next to it and no others. Chunks of two
lines or more with words that occur elsewhere too are removed, but for the first occurrence by document id, text and
position, after the bytes have been compared with that first occurrence.

All of it is DataFrame functions. Chunk hashes are counted with a map-side combine; the texts of chunks are read again
only where a bitmap of the repeated hashes allows it, and only documents that lose something are shuffled.

Chunks miss what stands before the first and after the last boundary inside a passage, and most short passages.
``remove_passages`` has no boundaries: every run of lines with words is held against all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.arrays import let, spread
from linkloom.llm.prefilter import may_be_in
from linkloom.session import cut

ENDS_BELOW = "5"  # a chunk ends where the first hex digit of the pair's digest is below: 5 of 16
WORD = r"[^\x20\x09-\x0D]"


def _ends(lines: Column) -> Column:
    """Positions of the last lines of chunks."""
    digest = F.transform(lines, lambda x: F.md5(x.cast("binary")))

    def body(h):
        last = F.size(h) - 1
        pair = lambda i: F.md5(F.concat(F.get(h, i - 1), F.get(h, i)).cast("binary"))
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 0) & (F.substring(pair(i), 1, 1) < ENDS_BELOW)))

    return let(digest, body)


def _span(ends: Column, k: Column) -> tuple[Column, Column]:
    """First line of chunk ``k``, from 0, and its number of lines."""
    start = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
    return start, F.get(ends, k) - start + 1


def _chunks(text: Column, with_text: bool, min_lines: int, keep=None) -> Column:
    """Array of structs ``pos, lines, hash[, body]`` of the chunks with ``min_lines`` lines that hold a word."""

    def of(lines):
        def one(ends):
            def make(k):
                start, n = _span(ends, k)
                part = F.slice(lines, start + 1, n)
                body = F.array_join(part, "\n")
                cols = [k.alias("pos"), n.alias("lines"), F.size(F.filter(part, lambda x: x.rlike(WORD))).alias("full")]
                return F.struct(*cols, F.xxhash64(body).alias("hash"), *([body.alias("body")] if with_text else []))

            made = F.transform(F.sequence(F.lit(0), F.size(ends) - 1), make)
            good = lambda c: (c["full"] >= min_lines) & (keep(c["hash"]) if keep else F.lit(True))
            return F.filter(made, good)

        return let(_ends(lines), one)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), of)


def _without(text: Column, gone: Column) -> Column:
    """The text without the chunks at the positions ``gone``."""

    def of(lines):
        def one(ends):
            kept = F.array_except(F.sequence(F.lit(0), F.size(ends) - 1), gone)
            return F.array_join(F.flatten(F.transform(kept, lambda k: F.slice(lines, _span(ends, k)[0] + 1, _span(ends, k)[1]))), "\n")

        return let(_ends(lines), one)

    return let(F.split(text, "\n", -1), of)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text_col``, and the columns ``chunks_removed`` and ``lines_removed`` (long).

    The first occurrence stays: smallest id (null ids last), then digest of the text, then position. Rows that agree in id
    and text are one document: they lose the same chunks. A null text stays null, an empty one empty; a text may end up
    empty, its row stays. A chunk whose hash is shared but whose bytes differ from the first occurrence stays. Other columns
    are kept; ``chunks_removed`` and ``lines_removed`` of the input give way. An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("chunks_removed", "lines_removed")]
    keyed = docs.select(*names, F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    cells = cut(spread(keyed, _chunks(F.col(text_col), False, min_lines), "c", "_id", "_th").select("_id", "_th", "c.pos", "c.hash"))
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("pos").alias("pos"))
    firsts = cells.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("hash", "first")
    firsts = cut(firsts)
    known = firsts.select("hash")

    # texts of possibly repeated chunks, held against the first occurrence
    seen = spread(keyed, _chunks(F.col(text_col), True, min_lines), "c", "_id", "_th").select("_id", "_th", "c.pos", "c.lines", "c.hash", "c.body")
    seen = seen.filter(may_be_in(known, ["hash"], ["hash"])).withColumn("place", place)
    seen = cut(seen.join(firsts, "hash"))
    originals = seen.filter(F.col("place") == F.col("first")).groupBy("hash").agg(F.min("body").alias("original"))
    gone = (
        seen.filter(F.col("place") != F.col("first")).join(originals, "hash").filter(F.col("body") == F.col("original"))
        .groupBy("_id", "_th", "pos").agg(F.max("lines").alias("lines"))
        .groupBy("_id", "_th").agg(F.collect_list("pos").alias("gone"), F.sum("lines").cast("long").alias("lines_removed"))
    )
    gone = cut(gone.withColumnsRenamed({"_id": "_g_id", "_th": "_g_th", "gone": "_g_pos", "lines_removed": "_g_lines"}))
    hit = may_be_in(gone, ["_g_id", "_g_th"], ["_id", "_th"])
    same = F.col("_id").eqNullSafe(F.col("_g_id")) & (F.col("_th") == F.col("_g_th"))
    changed = keyed.filter(hit).join(gone, same, "left")
    new = F.when(F.col("_g_pos").isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col("_g_pos")))
    changed = changed.select(*[new.alias(c) if c == text_col else F.col(c) for c in names],
                             F.coalesce(F.size("_g_pos"), F.lit(0)).cast("long").alias("chunks_removed"),
                             F.coalesce("_g_lines", F.lit(0)).alias("lines_removed"))
    still = keyed.filter(~hit).select(*names, F.lit(0).cast("long").alias("chunks_removed"), F.lit(0).cast("long").alias("lines_removed"))
    return still.unionByName(changed)


def _windows(text: Column, min_lines: int) -> Column:
    """Array of structs ``start, last, hash, digest`` of the runs of ``min_lines`` lines with words and the lines between them."""

    def of(lines):
        def one(full):
            def make(start, k):
                last = F.get(full, k + (min_lines - 1))
                body = lambda x: F.struct(start.alias("start"), last.alias("last"), F.xxhash64(x).alias("hash"), F.unhex(F.sha2(x, 256)).alias("digest"))
                return let(F.array_join(F.slice(lines, start + 1, last - start + 1), "\n"), body)

            return F.transform(F.slice(full, 1, F.greatest(F.size(full) - (min_lines - 1), F.lit(0))), make)

        return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD)), one)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), of)


def _without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions ``gone``."""

    def of(lines):
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n", -1), of)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """``docs`` without the repeated passages of ``min_lines`` lines with words or more, and the column ``lines_removed`` (long).

    A run of ``min_lines`` such lines, with the wordless lines between them, is repeated where the same bytes (SHA-256) stand at
    an earlier place: smallest id (null ids last), then digest of the text, then line. A line goes where it lies in a repeated run
    and in no run whose first occurrence a later one refers to, so what has been removed stands whole at its first place.
    Repeated passages of any length lose all lines, whatever stands around them, but for lines that are such a first
    occurrence together with their neighbours. Odd rows fare as in ``remove_repeated``.
    """
    names = [c for c in docs.columns if c != "lines_removed"]
    keyed = docs.select(*names, F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    runs = spread(keyed, _windows(F.col(text_col), min_lines), "c", "_id", "_th").select("_id", "_th", "c.start", "c.last", "c.hash", "c.digest")
    often = cut(runs.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("start").alias("start"))
    seen = runs.filter(may_be_in(often, ["hash"], ["hash"])).join(often, "hash", "left_semi")
    seen = cut(seen.select("_id", "_th", "digest", place.alias("place"), F.sequence("start", "last").alias("span")))
    firsts = seen.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("final")).filter("first <> final")
    marked = seen.join(firsts.select("digest", "first"), "digest")
    spans = lambda c: F.flatten(F.collect_list(F.when(c, F.col("span"))))
    gone = marked.groupBy("_id", "_th").agg(
        F.array_except(spans(F.col("place") != F.col("first")), spans(F.col("place") == F.col("first"))).alias("gone")).filter(F.size("gone") > 0)
    gone = cut(gone.withColumnsRenamed({"_id": "_g_id", "_th": "_g_th", "gone": "_g_lines"}))
    hit = may_be_in(gone, ["_g_id", "_g_th"], ["_id", "_th"])
    same = F.col("_id").eqNullSafe(F.col("_g_id")) & (F.col("_th") == F.col("_g_th"))
    new = F.when(F.col("_g_lines").isNull(), F.col(text_col)).otherwise(_without_lines(F.col(text_col), F.col("_g_lines")))
    changed = keyed.filter(hit).join(gone, same, "left").select(
        *[new.alias(c) if c == text_col else F.col(c) for c in names], F.coalesce(F.size("_g_lines"), F.lit(0)).cast("long").alias("lines_removed"))
    return keyed.filter(~hit).select(*names, F.lit(0).cast("long").alias("lines_removed")).unionByName(changed)


def remove_passages_sql(table: str = "documents", min_lines: int = 2) -> str:
    """The same as SQL for unique ids, comparing whole runs."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM {table}),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT x.doc_id, x.i AS a, y.i AS b FROM f x JOIN f y ON y.doc_id = x.doc_id AND y.k = x.k + {min_lines - 1}),
s AS (SELECT w.doc_id, a, b, string_agg(line, chr(10) ORDER BY i) AS body FROM w JOIN l ON l.doc_id = w.doc_id AND i BETWEEN a AND b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) > 1 AS again, count(*) OVER (PARTITION BY body) > 1 AS often FROM s),
g AS (SELECT l.doc_id, i FROM l JOIN r ON r.doc_id = l.doc_id AND i BETWEEN a AND b WHERE often GROUP BY ALL HAVING bool_and(again))
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, x.lines_removed
FROM {table} t JOIN (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS lines_removed
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id) x ON x.doc_id = t.doc_id"""


def remove_repeated_sql(table: str = "documents", min_lines: int = 2) -> str:
    """The same as SQL for unique ids, comparing whole chunks."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM {table}),
e AS (SELECT *, CASE WHEN i > 0 AND substr(md5(lag(md5(line)) OVER w || md5(line)), 1, 1) < '{ENDS_BELOW}' THEN 1 ELSE 0 END AS stop FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
c AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines, count(*) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS full_lines
      FROM k GROUP BY doc_id, pos),
r AS (SELECT *, full_lines >= {min_lines} AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS gone FROM c)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, x.chunks_removed, x.lines_removed
FROM {table} t JOIN (SELECT doc_id, string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS chunks_removed,
  coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS lines_removed FROM r GROUP BY doc_id) x ON x.doc_id = t.doc_id"""
