"""Documents joined by the Jaccard similarity of their word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each distinct n-gram set and a column for each n-gram. A pair's overlap is an entry
of the matrix times its transpose; only entries that reach the threshold are wanted, so the product is cut short:

1. Documents with equal sets are folded into one class (a grouped minimum over digests), so exact copies never pair.
2. Columns are ordered by how many documents hold them, rare ones first, and then by hash. A pair of similarity ``t``
   must meet within the first ``n - ceil(t * n) + 1`` columns of both its sets, so only that block of each row is
   multiplied. How often a column is held matters for speed alone, so counts go into a table of fixed size: hashes are
   counted exactly in hash ranges, and only the logarithm of frequent ones is kept, for 2^20 buckets.
3. Within a column block every row is first held against the first row of its column and part (a star, linear in the
   column); pairs that reach the threshold join classes. What then still shares a column but not a class is paired.
   Both times a pair is discarded where the column they meet in and all that may follow it stay below the overlap that
   their sizes demand: in the first column that two sets share, no pair of the threshold is discarded.
   Where more than ``WIDE`` rows are left in a column, they are first held against one reference set, and only what they lack of
   it and have beside it is joined, rare differences first: near copies just below the threshold share few of these.
4. For what is left, overlaps of the whole sets are accumulated and held against the bound.

Every pair of similarity ``t`` or more is either inside one class already or reaches step 4, so no link between
different texts is lost; links inside a class need no listing. Columns that very many rows hold are dealt over several
parts for the star, each part with a first row of its own, and these first rows are compared among themselves.

n-grams are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow, slices
from linkloom.llm.prefilter import drop_keys
from linkloom.operators.components import connected_components
from linkloom.session import cut

LEVEL_BITS = 20  # buckets of the table of frequent n-grams: one byte each
FREQUENT = 8  # an n-gram is frequent from so many documents on
KEY_BITS = 40  # of the hash, to count by; more only order columns better
SLICE_BYTES = 512 << 10  # of text whose words and n-grams are held at once
PACK = 1_000_000  # n-grams that a task holds before it counts and sends them
WIDE = 64  # a column where more rows than these are left after the star is settled by differences
SKETCH = 4  # longs of a row's sketch of differences
PART_LEVEL = 11  # columns held by more than 2^11 documents are dealt over parts of about so many rows
_M = np.uint64(0x9E3779B97F4A7C15)


def _fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_sets(texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts of an Arrow column, and where each text's begin (one more at the end).

    A-Z are lower-cased, words are runs without ASCII white space. A text with fewer than ``n`` words has its whole
    sequence as its only n-gram; one without words, or null, has none.
    """
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    real = np.fromiter((w != "" for w in names), dtype=bool, count=len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(count)), count)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    h, rows = hashes[codes[keep]] if len(codes) else np.zeros(0, np.uint64), rows[keep]
    count = np.bincount(rows, minlength=len(count))
    with np.errstate(over="ignore"):
        total = max(len(h) - n + 1, 0)
        grams = np.full(total, n, dtype=np.uint64)
        for k in range(n):
            grams = grams * _M + h[k : k + total]
        inside = rows[:total] == rows[n - 1 :] if total else np.zeros(0, bool)
        grams, owner = _fmix(grams[inside]), rows[:total][inside]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            begin = np.cumsum(count) - count
            extra = np.empty(len(short), dtype=np.uint64)
            for i, r in enumerate(short):
                v = np.uint64(count[r])
                for w in h[begin[r] : begin[r] + count[r]]:
                    v = v * _M + w
                extra[i] = v
            grams, owner = np.concatenate([grams, _fmix(extra)]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    grams = grams[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(count)))]).astype(np.int64)
    parts, sizes = [], np.zeros(len(count), np.int64)
    for r in np.flatnonzero(np.diff(bounds)):
        parts.append(np.unique(grams[bounds[r] : bounds[r + 1]]))
        sizes[r] = len(parts[-1])
    return (np.concatenate(parts) if parts else grams), np.concatenate([[0], np.cumsum(sizes)])


def _digests(texts_df: DataFrame, key: str, n: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            grams, at = ngram_sets(part.column("text"), n)
            zero = np.zeros(1, np.uint64)  # a list would turn the sums into doubles, and equal sets would differ by their place in the slice
            with np.errstate(over="ignore"):
                one, two = np.concatenate([zero, np.cumsum(grams)]), np.concatenate([zero, np.cumsum(_fmix(grams ^ _M))])
                f1, f2 = one[at[1:]] - one[at[:-1]], two[at[1:]] - two[at[:-1]]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))],
                                             names=["id", "n", "f1", "f2"])

    return map_arrow(texts_df, run, f"id {key}, n long, f1 long, f2 long")


def _levels(texts_df: DataFrame, total: int, n: int) -> bytes:
    """For each bucket of n-gram hashes the logarithm of the largest count of a frequent n-gram in it, else 0.

    Keys travel sorted, as differences split into byte planes, so each costs two to three bytes; a key that a task
    meets often is sent once with its count. Hash ranges hold about a million keys each.
    """
    ranges = max(8, -(-total // 1_000_000))
    shift = np.uint64(64 - KEY_BITS)
    step = np.uint64(-(-(1 << KEY_BITS) // ranges))

    def pack(held):
        keys = np.concatenate(held)  # the one copy: shifted and sorted in place
        held.clear()
        keys >>= shift
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.minimum(np.diff(first, append=len(keys)), 65535).astype("<u2")
        keys = keys[first]
        cuts = np.searchsorted(keys, step * np.arange(ranges + 1, dtype=np.uint64))
        out = {"part": [], "keys": [], "counts": []}
        for p in range(ranges):
            k = keys[cuts[p] : cuts[p + 1]]
            if len(k):
                deltas = np.diff(k, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
                out["part"].append(p)
                out["keys"].append(np.ascontiguousarray(deltas[:, :5].T).tobytes())
                out["counts"].append(np.ascontiguousarray(counts[cuts[p] : cuts[p + 1]].view(np.uint8).reshape(-1, 2).T).tobytes())
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def run(batches):
        held, size = [], 0
        for part in slices(batches, "text", SLICE_BYTES):
            held.append(ngram_sets(part.column("text"), n)[0])
            size += len(held[-1])
            if size > PACK:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    def merge(_, table):
        keys, counts = [], []
        for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            planes = np.zeros((len(k) // 5, 8), np.uint8)
            planes[:, :5] = np.frombuffer(k, np.uint8).reshape(5, -1).T
            keys.append(np.cumsum(planes.view("<u8").ravel()))
            counts.append(np.frombuffer(c, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel().astype(np.int64))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, first)
        hot = sums >= FREQUENT
        bucket = (keys[first][hot] & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.int32)
        level = np.log2(sums[hot]).astype(np.int32)
        best = np.zeros(1 << LEVEL_BITS, np.int32)
        np.maximum.at(best, bucket, level)
        used = np.flatnonzero(best)
        return pa.table({"bucket": pa.array(used.astype(np.int32)), "level": pa.array(best[used])})

    packed = map_arrow(texts_df, run, "part int, keys binary, counts binary")
    merged = packed.groupBy("part").applyInArrow(merge, "bucket int, level int")
    found = merged.groupBy("bucket").agg(F.max("level").alias("level")).toArrow()  # at most 2^20 rows, whatever the input
    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    table[found.column("bucket").to_numpy()] = np.minimum(found.column("level").to_numpy(), 63)
    return table.tobytes()


def _blocks(texts_df: DataFrame, key: str, levels, n: int, percent: int) -> DataFrame:
    """``(id, n, grams, level)``: the first columns of each set in the global order."""
    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        for part in slices(batches, "text", SLICE_BYTES):
            grams, at = ngram_sets(part.column("text"), n)
            level = table[((grams >> np.uint64(64 - KEY_BITS)) & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.int64)]
            rank = (level.astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))
            keep, cut_at = [], [0]
            for a, b in zip(at[:-1], at[1:], strict=True):
                size = b - a
                p = size - (percent * size + 99) // 100 + 1 if size else 0
                if p:
                    first = np.argpartition(rank[a:b], p - 1)[:p] if p < size else np.arange(size)
                    keep.append(a + first[np.argsort(rank[a:b][first])])
                cut_at.append(cut_at[-1] + p)
            keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            place = np.arange(len(keep)) - np.repeat(cut_at[:-1], np.diff(cut_at))
            items = pa.StructArray.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(level[keep].astype(np.int8)), pa.array(place.astype(np.int32))], names=["g", "l", "pos"])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), items)],
                                             names=["id", "n", "grams"])

    return map_arrow(texts_df, run, f"id {key}, n long, grams array<struct<g: long, l: tinyint, pos: int>>")


def _wanted_sets(texts_df: DataFrame, key: str, ids: DataFrame, n: int, bits: int = 23) -> DataFrame:
    """``(id, grams)``, whole sets, of all rows whose id is in ``ids`` and of a few more.

    The ids travel as a bitmap of fixed size, so texts are not shuffled to find them.
    """
    slot = F.xxhash64("id").bitwiseAND((1 << bits) - 1)
    words = (
        ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toArrow()
    )
    bitmap = np.zeros(1 << (bits - 5), "<u4")  # at most 2^18 rows
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype("<u4")
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        has = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        for batch in batches:
            hit = np.flatnonzero(has[batch.column("slot").to_numpy()])
            if len(hit):
                for part in slices([batch.take(pa.array(hit))], "text", SLICE_BYTES):
                    grams, at = ngram_sets(part.column("text"), n)
                    sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("id"), sets], names=["id", "grams"])

    return map_arrow(texts_df.select("id", "text", slot.alias("slot")), run, f"id {key}, grams array<long>")


def _verified(texts_df: DataFrame, key: str, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _wanted_sets(texts_df, key, ids, n)
    sets = cut(sets)
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    joined = joined.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")

    both = F.size(F.array_intersect("ga", "gb"))
    enough = (both > 0) & (both * 100 >= (F.size("ga") + F.size("gb") - both) * percent)
    return joined.filter(enough).select("a", "b")


def _may_link(a: str, b: str, percent: int):
    """Whether rows that meet in a column can still reach the threshold if it is the first column they share.

    Then the rest of the shorter remainder is the most they have in common; their sizes say how much they need. The columns
    ``n`` and ``pos`` carry the suffixes ``a`` and ``b``.
    """
    most = F.least(F.col("n" + a) - F.col("pos" + a), F.col("n" + b) - F.col("pos" + b))
    return most * (100 + percent) >= (F.col("n" + a) + F.col("n" + b)) * percent


def _size_windows(left: DataFrame, percent: int) -> DataFrame:
    """``left`` with ``win``: every row twice, so that sizes of which the smaller is ``percent`` of the larger or more share a window."""
    band = F.floor(F.log(F.col("n")) / (math.log(100 / min(percent, 99)) * 1.000001))  # the slack is for rounding
    return left.withColumn("band", band).withColumn("win", F.explode(F.array(F.col("band"), F.col("band") + 1))).drop("band")


def _by_differences(texts_df: DataFrame, key: str, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` among ``rows (ref, id, cls)`` of one ``ref``: with links between all classes that links of their rows tie.

    Each row is told by what its set lacks of its reference's set and what it has beside it. Two rows have ``size of ref - lacks
    of one - lacks of the other + what their differences share`` in common, so ``need`` is how much these must share. Where it
    is nothing, both link with the row ``low`` of the least weight. Else they share one of their rarest differences; those that
    no other row has are left out. A heavy row needs more: each looks for lighter rows by as many of its differences as it takes to
    find ``low``, and is found by the fewer that a row no lighter than itself asks of it. Pairs that meet are held against sketches
    of fixed size: bits in which two of them differ stand for differences that are not shared.
    """
    rows = cut(rows)
    sets = cut(_wanted_sets(texts_df, key, rows.select(F.explode(F.array("ref", "id")).alias("id")).distinct(), n))
    told = rows.join(sets, "id").join(sets.select(F.col("id").alias("ref"), F.col("grams").alias("of")), "ref")
    told = told.withColumns({"ref": F.struct("ref", F.xxhash64("of")), "id": F.struct("id", F.xxhash64("grams"))})  # ids may repeat with other texts
    lacks, has = F.array_except("of", "grams"), F.array_except("grams", "of")
    told = told.select("ref", "id", "cls", F.size("grams").alias("n"), F.size("of").alias("n_ref"), lacks.alias("lacks"), has.alias("has"))
    # in units of 1 / (100 + percent); rows whose weights reach no more than the reference's whole size need share nothing
    weight = F.size("lacks") * (100 + percent) + F.col("n") * percent
    told = cut(told.withColumn("w", weight).withColumn("whole", F.col("n_ref") * (100 + percent)))
    low = told.groupBy("ref").agg(F.min(F.struct("w", "id")).alias("low")).select("ref", F.col("low.id").alias("low"), F.col("low.w").alias("w_low"))
    told = told.join(low, "ref")
    star = told.filter("w + w_low <= whole and id.id <> low.id").select(F.least("id.id", "low.id").alias("a"), F.greatest("id.id", "low.id").alias("b"))

    # of ref's columns and of others alike: a set holds a hash or lacks it, never both
    cells = told.select("ref", "id", F.explode(F.concat("lacks", "has")).alias("d"))
    often = cells.groupBy("ref", "d").agg(F.count("*").alias("often")).filter("often > 1")
    bits = [F.bit_xor(F.expr(f"if(pmod(shiftright(d, 6), {SKETCH}) = {i}, shiftleft(1L, cast(pmod(d, 64) as int)), 0L)")).alias(f"bits{i}") for i in range(SKETCH)]
    shared = cells.join(often, ["ref", "d"]).groupBy("ref", "id").agg(F.array_sort(F.collect_list(F.struct("often", "d"))).alias("ds"), F.array(*bits).alias("bits"))
    told = told.join(shared, ["ref", "id"]).withColumn("k", F.size("ds")).withColumn("ds", F.col("ds.d"))
    told = cut(told.select("ref", "id", "cls", "w", "w_low", "whole", "k", "ds", "bits"))
    # links are few once rows near the reference, and then those near the lightest that holds a difference, are of one class
    links = cut(star.distinct())
    for stars in (True, False):
        told = _tied(told, links)
        links = cut(links.unionByName(_meeting(told, percent, stars)).distinct())
    return links


def _tied(told: DataFrame, links: DataFrame) -> DataFrame:
    """``told`` with its classes joined by ``links (a, b)``."""
    held = told.select(F.col("id.id").alias("a"), F.col("cls").alias("b")).distinct()
    nodes = cut(connected_components(links.unionByName(held), "a", "b"))
    return cut(told.drop("cls").join(nodes.select(F.col("node").alias("own"), F.col("component").alias("cls")), F.col("id.id") == F.col("own")).drop("own"))


def _meeting(told: DataFrame, percent: int, stars: bool) -> DataFrame:
    """Links ``(a, b)`` between the classes of ``told``; with ``stars`` a difference is found only at the lightest row that offers it."""

    def heads(s: str, lightest: str) -> DataFrame:
        """The differences by which a row meets others, where the lighter row of the pair weighs ``lightest`` or more."""
        least = F.greatest(F.ceil((F.col("w") + F.col(lightest) - F.col("whole")) / (100 + percent)), F.lit(1)).cast("int")
        taken = told.withColumn("take", F.col("k") - least + 1).filter("take > 0")
        return taken.select("ref", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "cls", "w", "k", "bits")], *(["whole"] if s == "a" else []),
                            F.posexplode(F.slice("ds", F.lit(1), F.col("take"))).alias(f"at_{s}", "d"))

    offered = heads("b", "w")
    if stars:
        first = F.row_number().over(Window.partitionBy("ref", "d").orderBy("w_b", "id_b"))
        offered = offered.withColumn("first", first).filter("first = 1").drop("first")
    need = F.col("w_a") + F.col("w_b") - F.col("whole")
    apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(SKETCH)), F.lit(0))
    most = F.least(F.col("k_a") - F.col("at_a"), F.col("k_b") - F.col("at_b"), (F.col("k_a") + F.col("k_b") - apart) / 2)
    met = heads("a", "w_low").join(offered, ["ref", "d"]).filter((F.col("w_a") >= F.col("w_b")) & (F.col("cls_a") != F.col("cls_b")))
    met = met.filter(most * (100 + percent) >= need).select("ref", "id_a", "id_b", need.alias("need")).distinct()
    # what is left is held against all differences
    side = lambda s: told.select("ref", F.col("id").alias(f"id_{s}"), F.col("ds").alias(f"ds_{s}"))
    met = met.join(side("a"), ["ref", "id_a"]).join(side("b"), ["ref", "id_b"])
    met = met.filter(F.size(F.array_intersect("ds_a", "ds_b")) * (100 + percent) >= F.col("need"))
    return met.select(F.least("id_a.id", "id_b.id").alias("a"), F.greatest("id_a.id", "id_b.id").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(id_col, n_shingles, component_id, class_id)`` for every row of ``docs``.

    Documents link when ``100 * intersection >= percent * union`` of their sets of ``n`` words; ``component_id`` is the
    smallest id reachable by links and ``class_id`` the smallest id with the very same set. Null or wordless texts have an
    empty set, link with nothing and are components of their own. Rows that share an id are one node: each keeps its
    own ``n_shingles``, and a link of any of them counts for all. A null id links with nothing and its component and
    class are null. Repeated rows are kept, other columns are left behind, an empty table gives no rows.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_digests(texts, key, n))
    live = rows.filter("n > 0 and id is not null")
    classes = cut(live.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    total = classes.agg(F.sum("n"), F.sum(F.col("n") * F.col("copies"))).first()
    if not total[0]:
        return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("id").alias("class_id"))
    # one text for each set: rows whose id names no class go, and only they are shuffled for it
    here = texts.filter("id is not null")
    named = classes.select("rep").distinct()
    gone = cut(live.select("id").distinct().join(named, F.col("id") == F.col("rep"), "left_anti"))
    single = drop_keys(here, gone, ["id"])
    levels = spark.sparkContext.broadcast(_levels(single, total[1], n))

    # one row per (class, column of its block), dealt by column
    blocks = _blocks(single, key, levels, n, percent)
    cells = blocks.select("id", "n", F.explode("grams").alias("x")).select("id", "n", F.col("x.g").alias("g"), F.col("x.l").alias("l"), F.col("x.pos").alias("pos"))
    parts = F.expr(f"shiftleft(1, greatest(cast(l as int) - {PART_LEVEL}, 0))")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    # the first row is the one with the fewest rare columns, the plainest of a group of near copies
    w = Window.partitionBy("g", "part").orderBy("pos", "id")
    head = F.first(F.struct("id", "n", "pos"))
    told = cells.withColumns({"head": head.over(w), "next": F.lead("id").over(w)})
    told = told.filter(f"head.id <> id or next is not null or l > {PART_LEVEL}")
    cells = cut(told.select("g", "id", "n", "pos", F.col("head.id").alias("first"), F.col("head.n").alias("n_first"), F.col("head.pos").alias("pos_first"), F.col("l").cast("int").alias("l")))
    pair = [F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")]
    star = cells.filter(F.col("first") != F.col("id")).filter(_may_link("", "_first", percent)).select(*pair)
    heads = cells.filter(f"l > {PART_LEVEL} and first = id").select("g", "id", "n", "pos").withColumn("head", head.over(Window.partitionBy("g").orderBy("pos", "id")))
    heads = heads.select("id", "n", "pos", F.col("head.id").alias("first"), F.col("head.n").alias("n_first"), F.col("head.pos").alias("pos_first"))
    heads = heads.filter(F.col("first") != F.col("id")).filter(_may_link("", "_first", percent)).select(*pair)
    tried = cut(star.unionByName(heads).distinct())
    links = cut(_verified(here, key, tried, n, percent))
    members = links.select("a", "b")

    # rows that still share a column with another class: the product of what is left
    nodes = cut(connected_components(members, "a", "b"))
    held = cells.select("g", "id", "n", "pos").join(nodes.withColumnRenamed("node", "id"), "id", "left")
    held = held.select("g", "id", "n", "pos", F.coalesce("component", "id").alias("cls"))
    mixed = held.groupBy("g").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("g")
    left = cut(held.join(mixed, "g", "left_semi"))
    wide = cut(left.groupBy("g").agg(F.count("*").alias("k")).filter(F.col("k") > WIDE).select("g"))
    narrow = left.join(wide, "g", "left_anti")
    side = lambda s: narrow.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "cls")])
    met = side("a").join(side("b"), "g").filter((F.col("cls_a") < F.col("cls_b")) & _may_link("_a", "_b", percent))
    met = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    if not wide.isEmpty():
        # a reference for rows of like size: the rest of a passage tells little of a whole text
        of = Window.partitionBy("g", "win")
        near = _size_windows(left.join(wide, "g"), percent).withColumns({"ref": F.min(F.struct("pos", "id")).over(of).getField("id"), "lo": F.min("cls").over(of), "hi": F.max("cls").over(of)})
        met = met.unionByName(_by_differences(here, key, near.filter("lo <> hi").select("ref", "id", "cls").distinct(), n, percent))
    pairs = met.distinct().join(tried, ["a", "b"], "left_anti")
    more = cut(_verified(here, key, cut(pairs), n, percent))

    # rows of a repeated id are one node: tie their classes together
    repeated = live.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
    same_id = live.join(repeated, "id", "left_semi").join(classes, ["n", "f1", "f2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    graph = members.unionByName(more).unionByName(same_id)
    found = connected_components(graph, "a", "b").withColumnsRenamed({"node": "rep", "component": "found"})
    out = rows.join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"], "left").join(cut(found), "rep", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("found", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id. Rows with a null id stay.

    Rows that repeat the kept id all stay: they are one node. Only rows that may go are shuffled.
    """
    comp = jaccard_components(docs, id_col, text_col, n, percent)
    gone = cut(comp.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct())
    return drop_keys(docs, gone, [id_col])


def jaccard_sql(table: str = "documents", n: int = 5, percent: int = 80) -> str:
    """The same components as SQL, by joining on every n-gram."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {table}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: {shingle}) END) AS g FROM t),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * k >= {percent} * (za.n + zb.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM t UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT t.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id FROM t LEFT JOIN z USING (doc_id) JOIN c ON c.node = t.doc_id"""
