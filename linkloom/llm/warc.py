"""WARC archives in Zstandard frames with a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or itself compressed;
then comes one Zstandard frame per record. The reader loads the dictionary, decodes frame by frame from a stream (so an
archive of any size needs the memory of one record), and checks version line, required headers, lengths and digests.

Writing: equal payloads are found by digest and length in one grouped maximum; the response among them is the one with
the largest page id, the others become revisit records that name it and carry only HTTP headers. Each task rolls
archives of bounded size and trains a dictionary on the first records of each, at most ``SAMPLE_BYTES``. Archives get
names of their own per attempt, and the list of archives is a table that Spark commits, so a lost or repeated task
leaves at most files that nothing lists.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.arrow import deal, map_arrow, shared_folder, slices, storage
from linkloom.session import cut

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SAMPLE_BYTES = 1 << 20  # records of at most so many bytes train an archive's dictionary
DICTIONARY_BYTES = 32 << 10
ARCHIVE_BYTES = 64 << 20  # of records before compression
DATE = "2000-01-01T00:00:00Z"
ID = "urn:linkloom:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, kind: str, refers_to) -> bytes:
    """A response or revisit record; control characters and blanks of the URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "" if page_id is None else page_id
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ID}{name}>"), ("WARC-Date", DATE),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
               ("WARC-Block-Digest", "sha1:" + base32_sha1(block))]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return _record(headers, block)


def dictionary(samples: list[bytes]):
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(samples) or b"WARC/1.1\r\n")[-DICTIONARY_BYTES:], zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], compress_dictionary: bool = True) -> bytes:
    """The bytes of one archive; its dictionary comes from the first records."""
    import zstandard

    samples, held = [], 0
    for r in records:
        if held >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES - held])
        held += len(samples[-1])
    trained = dictionary(samples)
    raw = trained.as_bytes()
    stored = zstandard.ZstdCompressor(level=3).compress(raw) if compress_dictionary else raw
    if not compress_dictionary and stored[:4] == FRAME_MAGIC:
        stored = zstandard.ZstdCompressor(level=3).compress(raw)  # else a reader would take it for a compressed one
    c = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(stored)), stored, *map(c.compress, records)])


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row and return the committed list ``(archive, n_records, n_bytes)``.

    A null payload counts as empty. Rows with a null id revisit the largest id of their payload; where all ids are
    null, and where the largest id occurs several times, all of these are responses. A null URL is left out of the
    record. An empty table writes no archive. Other columns are left behind.
    """
    spark = pages.sparkSession
    place = folder or shared_folder(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    firsts = (
        rows.filter(F.col("size") >= least_revisit_bytes).groupBy("digest", "size")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
        .select(F.col("digest").alias("d"), F.col("size").alias("s"), "first_id")
    )
    typed = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def run(batches):
        fs, path = storage(place)

        def flush(records):
            data = archive(records)
            name = f"{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"archive": [f"{place}/{name}"], "n_records": [len(records)], "n_bytes": [len(data)]})

        records, held = [], 0
        for part in slices(batches, "payload"):
            for p, u, b, r in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")], strict=True):
                records.append(page_record(p, u, b, "response" if r is None else "revisit", r))
                held += len(records[-1])
            if held >= ARCHIVE_BYTES:
                yield flush(records)
                records, held = [], 0
        if records:
            yield flush(records)

    return cut(map_arrow(typed, run, "archive string, n_records long, n_bytes long"))


def frames(stream, chunk: int = 64 << 10):
    """``(offset, bytes, error)`` of each frame after the dictionary; an error ends the archive."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        yield 0, b"", "no dictionary frame at the start"
        return
    raw = stream.read(size)
    if len(raw) != size:
        yield 0, b"", "the dictionary frame is cut off"
        return
    try:
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    except zstandard.ZstdError as e:
        yield 0, b"", f"dictionary: {e}"
        return
    offset, rest = 8 + size, stream.read(chunk)
    while rest:
        frame, parts, used = decompressor.decompressobj(), [], 0
        try:
            while True:
                parts.append(frame.decompress(rest))
                used += len(rest)
                if frame.eof:
                    break
                rest = stream.read(chunk)
                if not rest:
                    yield offset, b"", "the last frame is cut off"
                    return
        except zstandard.ZstdError as e:
            yield offset, b"", f"frame: {e}"
            return
        rest = frame.unused_data
        yield offset, b"".join(parts), None
        offset += used - len(rest)
        rest = rest or stream.read(chunk)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``error`` says what is wrong with it."""
    out = dict.fromkeys(("record_type", "record_id", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "error"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return out | {"error": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return out | {"error": f"header line without a colon: {line[:40]}"}
        fields[k.strip().lower()] = v.strip()
    out |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>") or None,
            "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    lacking = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(k)]
    if lacking:
        return out | {"error": f"missing {', '.join(lacking)}"}
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "the record's length is not the one stated"}
    block = rest[:-4]
    stated = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if stated and stated != base32_sha1(block):
        return out | {"error": "block digest"}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
        size = int(said[1]) if said else len(payload)
        if not gap or not http.startswith(b"HTTP/"):
            return out | {"error": "no HTTP header"}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": size, "payload_digest": digest}
    if size != len(payload):
        return out | {"error": "the payload's length is not the one stated"}
    own = base32_sha1(payload)
    if digest and digest != own:
        return out | {"error": "payload digest"}
    return out | {"payload": payload, "payload_bytes": size, "payload_digest": own}


def read_archives(archives: DataFrame, payloads: bool = True, archive_col: str = "archive") -> DataFrame:
    """One row per record of every archive named in ``archive_col``, faulty ones with ``error``.

    Columns: ``archive, offset, record_type, record_id, target_uri, refers_to, payload, payload_bytes, payload_digest,
    error``; ``payload`` is null for revisits, faulty records and with ``payloads=False``. An archive whose frames break
    off gives its good records and then one row with the error. An empty list gives no rows.
    """
    names = ("record_type", "record_id", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "error")

    def run(batches):
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *[
            (n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in names]])
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = storage(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, raw, error in frames(stream):
                        row = dict.fromkeys(names) | {"error": error} if error else parse_record(raw)
                        row |= {"archive": uri, "offset": offset}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if n == 'payload_bytes' else 'string'}" for n in names)
    dealt = deal(archives.select(F.col(archive_col).alias("archive")))
    return map_arrow(dealt, run, f"archive string, offset long, {kinds}")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives in a folder or under a glob, as Spark lists them; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))
