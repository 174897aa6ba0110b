"""Training-order materialisation: every sequence of tokens gets a global slot, and slots are stored in shards.

Documents are one stream in stored order (file, then row), each closed by an end mark; the stream is cut into sequences
of ``length`` tokens. A keyed Feistel network over the smallest even number of bits that holds all sequence numbers, with
cycle-walking for values beyond them, is a permutation of ``0 .. n-1``: it gives each sequence its slot without any sort,
table or shuffle, and can be inverted. Shards hold ``per_shard`` slots of fixed width, so the sequence of a slot is read
by a seek, and training resumes at any slot.

Where a document starts in the stream follows from one cheap pass that sums lengths per contiguous run of rows (one
row per input split); only these sums reach the driver. The second pass sends pieces of sequences straight to their
shard's partition. Slots are spread evenly by construction, so no source, however large, makes a partition large.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import deal, map_arrow, put_file, shared_folder, slices, storage
from linkloom.session import cut

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(key: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]


def permute(index: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """The slot of each sequence number below ``n``, or with ``inverse`` the sequence number of each slot."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(k) for k in round_keys(key)]

    def once(x):
        left, right = x >> half, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << half) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def _runs(files: list, rows: np.ndarray):
    """``(first, stop)`` of the stretches in which file stays and row numbers count up."""
    same = np.array([a == b for a, b in zip(files[1:], files[:-1], strict=True)], dtype=bool)
    breaks = np.flatnonzero(~(same & (np.diff(rows) == 1))) + 1
    edges = [0, *breaks.tolist(), len(rows)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _starts(stream: DataFrame, width: int) -> tuple[dict[tuple[str, int], int], int]:
    """The stream position at which each contiguous run of rows begins, and the stream's length, in tokens."""

    def run(batches):
        now = None  # file, first row, next row, tokens
        for batch in batches:
            files, rows = batch.column("file").to_pylist(), batch.column("row").to_numpy()
            sizes = batch.column("size").to_numpy()
            for a, b in _runs(files, rows):
                tokens = int(sizes[a:b].sum()) // width + (b - a)
                if now and now[0] == files[a] and now[2] == rows[a]:
                    now = (now[0], now[1], int(rows[b - 1]) + 1, now[3] + tokens)
                    continue
                if now:
                    yield pa.RecordBatch.from_pydict({"file": [now[0]], "row": [now[1]], "tokens": [now[3]]})
                now = (files[a], int(rows[a]), int(rows[b - 1]) + 1, tokens)
        if now:
            yield pa.RecordBatch.from_pydict({"file": [now[0]], "row": [now[1]], "tokens": [now[3]]})

    sums = map_arrow(stream.select("file", "row", F.octet_length("ids").cast("long").alias("size")), run, "file string, row long, tokens long")
    at, begin = 0, {}
    for r in sorted(sums.collect()):
        begin[r.file, r.row] = at
        at += r.tokens
    return begin, at


def materialise(docs: DataFrame, ids: Column, end_mark: bytes, folder: str | None = None, length: int = 2048,
                per_shard: int = 4096, key: str = "order") -> DataFrame:
    """Write the shards of ``docs`` and return the committed list ``(shard, path, first_slot, n_slots, n_bytes, sha256, length, width, n_sequences, key)``.

    ``docs`` is a frame read from files that number their rows (Parquet) and not shuffled since; ``ids`` are its tokens
    as binary of ``len(end_mark)`` bytes each. Null or empty ids give the end mark alone; repeated rows, null and equal
    document ids are rows like others, because position in storage orders them. The last sequence is filled up with end
    marks. An empty table writes nothing and gives an empty list. A repeated task writes the same bytes again.
    """
    spark = docs.sparkSession
    width, place = len(end_mark), folder or shared_folder(spark, "shards")
    stream = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
                         F.coalesce(ids, F.lit(b"")).alias("ids"))
    begin, tokens = _starts(stream, width)
    n = -(-tokens // length)
    known = spark.sparkContext.broadcast(begin)
    stride = length * width

    def pieces(batches):
        here = None  # file, next row, stream position
        for part in slices(batches, "ids"):
            files, rows, values = part.column("file").to_pylist(), part.column("row").to_numpy(), part.column("ids").to_pylist()
            for a, b in _runs(files, rows):
                if here and here[0] == files[a] and here[1] == rows[a]:
                    at = here[2]
                else:
                    at = known.value[files[a], int(rows[a])]
                data = b"".join([x for v in values[a:b] for x in (v, end_mark)])
                here = (files[a], int(rows[b - 1]) + 1, at + len(data) // width)
                first, last = at // length, (here[2] - 1) // length
                slots = permute(np.arange(first, last + 1), n, key)
                edges = [max(0, (first + i) * length - at) * width for i in range(len(slots))] + [len(data)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(slots // per_shard), pa.array(slots),
                    pa.array([max(0, at - (first + i) * length) for i in range(len(slots))], pa.int64()),
                    pa.array([data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
                    names=["shard", "slot", "at", "data"])

    def write(batches):
        fs, path = storage(place)

        def flush(shard, slots, chunks):
            data = b"".join(chunks)
            if len(data) != slots * stride or slots != min(per_shard, n - shard * per_shard):
                raise ValueError(f"shard {shard} has {len(data)} bytes for {slots} slots")
            name = f"shard-{shard:08d}.bin"
            put_file(fs, path, name, [data])
            return pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{place}/{name}"], "first_slot": [shard * per_shard], "n_slots": [slots],
                                               "n_bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()]})

        shard, slot, held, slots, chunks = None, None, 0, 0, []
        for batch in batches:
            for s, t, at, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "slot", "at", "data")], strict=True):
                if t != slot and held and held < stride:  # the stream's last sequence
                    chunks.append(end_mark * ((stride - held) // width))
                if s != shard and chunks:
                    yield flush(shard, slots, chunks)
                    slots, chunks = 0, []
                if t != slot:
                    shard, slot, held, slots = s, t, 0, slots + 1
                if held != at * width:
                    raise ValueError(f"slot {t} has {held} bytes where a piece begins at {at * width}")
                chunks.append(data)
                held += len(data)
        if chunks:
            if held < stride:
                chunks.append(end_mark * ((stride - held) // width))
            yield flush(shard, slots, chunks)

    n_shards = -(-n // per_shard)
    parts = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = map_arrow(stream, pieces, "shard long, slot long, at long, data binary")
    dealt = dealt.repartitionById(parts, (F.col("shard") * parts / max(n_shards, 1)).cast("int")).sortWithinPartitions("shard", "slot", "at")
    made = map_arrow(dealt, write, "shard long, path string, first_slot long, n_slots long, n_bytes long, sha256 string")
    return cut(made.withColumns({"length": F.lit(length), "width": F.lit(width), "n_sequences": F.lit(n), "key": F.lit(key)}))


def read_slots(shards: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """``(slot, sequence, shard, byte_offset, ids)`` of the slots from ``start`` up to ``stop``, read in order within a shard.

    Reading may begin at any slot: only the shards that hold wanted slots are opened, at the wanted place.
    """
    last = F.lit(stop) if stop is not None else F.col("n_sequences")
    wanted = shards.withColumns({"from": F.greatest(F.col("first_slot"), F.lit(start)), "to": F.least(F.col("first_slot") + F.col("n_slots"), last)})
    wanted = deal(wanted.filter(F.col("from") < F.col("to")))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = storage(r["path"])
                stride = r["length"] * r["width"]
                step = max(1, (4 << 20) // stride)
                with fs.open_input_file(path) as f:
                    f.seek((r["from"] - r["first_slot"]) * stride)
                    for a in range(r["from"], r["to"], step):
                        slots = np.arange(a, min(a + step, r["to"]))
                        data = f.read(len(slots) * stride)
                        if len(data) != len(slots) * stride:
                            raise ValueError(f"{r['path']} ends before slot {slots[-1]}")
                        yield pa.RecordBatch.from_arrays([
                            pa.array(slots), pa.array(permute(slots, r["n_sequences"], r["key"], inverse=True)), pa.array(np.full(len(slots), r["shard"])),
                            pa.array((slots - r["first_slot"]) * stride), pa.array([data[i * stride : (i + 1) * stride] for i in range(len(slots))], pa.binary())],
                            names=["slot", "sequence", "shard", "byte_offset", "ids"])

    return map_arrow(wanted, run, "slot long, sequence long, shard long, byte_offset long, ids binary")
