"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are split by the pattern of the vocabulary, and the distinct matches of a batch go through the ``tokenizers``
library: a byte-level pre-tokenizer maps bytes to printable characters and a BPE model merges them. A dictionary of
bounded size keeps the ids of frequent matches for the life of a Python worker. Token offsets come from the byte
lengths of the tokens, so a token that ends inside a character is given that whole character.

The vocabulary is a rank file: a pair may merge when its bytes are a token, lowest rank first, leftmost first. All
splits of a token into two tokens are therefore given to the model as merges in the order of the token's rank. That
leaves one freedom: two different splits of the same token that overlap, three tokens in a row of which the first two
and the last two are that token. The vocabulary says which byte strings these are, a few hundred; one automaton pass
finds them, and matches that hold one take ``tiktoken``'s answer. So do texts with code points that are unassigned in
this Python's Unicode tables, because libraries may disagree about their class.

Work is linear in the text also where a match has no blanks (unspaced scripts, encoded data).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_BYTES = 32 << 20  # of frequent matches kept by a worker, counted with CACHE_ENTRY for each
CACHE_ENTRY = 200
CACHE_CHARS = 40  # longer matches are not kept
SLICE_BYTES = 256 << 10  # of texts that are split into Python strings at once
# the splitting pattern for texts of ASCII characters only; what it finds there is what the vocabulary's own pattern finds
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


def overlapping(tokens) -> set[bytes]:
    """Three tokens in a row whose first two and last two give the same token by different splits."""
    found = set()
    for token in tokens:
        for i in range(1, len(token)):
            one, two = token[:i], token[i:]
            if one != two and one in tokens and two in tokens and token.startswith(two) and token[len(two):] in tokens:
                found.add(one + two + token[len(two):])
    return found


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes and decodes with one rank file; made once for each Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import ahocorasick
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = public_tokenizers.PATTERN
        self.find = regex.compile(self.pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN, re.A).findall
        shown = byte_characters()
        show = lambda raw: "".join(shown[b] for b in raw)
        merges = [(show(t[:i]), show(t[i:])) for t in sorted(self.ranks, key=self.ranks.get) for i in range(1, len(t))
                  if t[:i] in self.ranks and t[i:] in self.ranks]
        self.model = Tokenizer(models.BPE(vocab={show(t): r for t, r in self.ranks.items()}, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.token_bytes = np.empty(max(self.ranks.values()) + 1, dtype=object)
        back = {c: b for b, c in enumerate(shown)}
        for token, rank in self.model.get_vocab().items():
            self.token_bytes[rank] = bytes(back[c] for c in token)  # the byte table, read backwards
        self.token_size = np.array([len(t or b"") for t in self.token_bytes], dtype=np.int64)
        self.doubtful = ahocorasick.Automaton()
        for raw in overlapping(self.ranks):
            self.doubtful.add_word(raw.decode("latin-1"), True)
        self.doubtful.make_automaton()
        self.cache: dict[str, bytes] = {}  # two generations: what is met again moves from the older to the newer
        self.older: dict[str, bytes] = {}
        self.cached = 0
        self._known: set[str] = set()
        self._tiktoken = None

    @property
    def tiktoken(self):
        if self._tiktoken is None:
            import tiktoken

            self._tiktoken = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._tiktoken

    def _unsure(self, text: str) -> bool:
        new = set(text) - self._known
        bad = any(unicodedata.category(c) == "Cn" for c in new)
        if not bad:
            self._known |= new
        return bad

    def _by_tiktoken(self, text: str) -> bytes | None:
        """The ids that ``tiktoken`` gives; none where its pattern engine gives up, as it does on a million blanks."""
        try:
            return np.array(self.tiktoken.encode_ordinary(text), dtype="<u4").tobytes()
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return None

    def _doubted(self, raw: bytes) -> bool:
        return len(self.doubtful) > 0 and next(self.doubtful.iter(raw.decode("latin-1")), None) is not None

    def _suspects(self, pieces: list[bytes]) -> set[int]:
        """The pieces that may hold a doubtful byte string, by one pass over all; 0xFF is no byte of UTF-8."""
        if not len(self.doubtful):
            return set()
        starts = np.cumsum([0, *[len(p) + 1 for p in pieces]])
        ends = [end for end, _ in self.doubtful.iter(b"\xff".join(pieces).decode("latin-1"))]
        return set((np.searchsorted(starts, ends, side="right") - 1).tolist())

    def _ids(self, pieces: list[str]):
        """The ids of each piece as little-endian 32-bit integers."""
        found = [out.ids for out in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        raw = [p.encode() for p in pieces]
        for i in self._suspects(raw):
            if len(found[i]) > 1 and self._doubted(raw[i]):
                found[i] = self.tiktoken._encode_single_piece(raw[i])
        flat = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
        ends = np.cumsum([4 * len(ids) for ids in found]).tolist()
        return zip(pieces, map(flat.__getitem__, map(slice, [0, *ends], ends)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if 2 * self.cached > CACHE_BYTES:
            self.cache, self.older, self.cached = {}, self.cache, 0
        whole = {i: ids for i, t in enumerate(texts) if not t.isascii() and self._unsure(t) and (ids := self._by_tiktoken(t)) is not None}
        split = [None if i in whole else self.find_ascii(t) if t.isascii() else self.find(t) for i, t in enumerate(texts)]
        here, older = self.cache, self.older
        missing = [p for p in set().union(*[p for p in split if p]) if p not in here]
        if missing:
            again = {p: older[p] for p in missing if p in older}
            new = dict(self._ids([p for p in missing if p not in again]))
            kept = again | {k: v for k, v in new.items() if len(k) <= CACHE_CHARS}
            self.cached += sum(2 * len(k) + len(v) for k, v in kept.items()) + CACHE_ENTRY * len(kept)
            self.cache.update(kept)
            if any(len(k) > CACHE_CHARS for k in new):
                here = {**self.cache, **new}
        get = here.__getitem__
        return [whole[i] if p is None else b"".join(map(get, p)) for i, p in enumerate(split)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; whole again where tokens split a character."""
        return b"".join(self.token_bytes[np.frombuffer(ids, dtype="<u4")])

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First code point and end of each token; tokens that share a character both cover it."""
        ends = np.cumsum(self.token_size[np.frombuffer(ids, dtype="<u4")])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if text.isascii() or not len(ends):
            return starts, ends
        first = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80  # bytes that begin a character
        index = np.cumsum(first)
        return index[starts] - 1, index[ends - 1]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a rank file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


KINDS = {"n_tokens": "long", "ids": "binary", "starts": "array<long>", "ends": "array<long>", "ids_sha256": "string",
         "decoded_sha256": "string", "decoded": "binary"}


def encode_texts(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """``(id_col, *columns)`` for every row; columns are any of ``KINDS``, and only those asked for leave the task.

    ``ids`` are little-endian unsigned 32-bit integers; ``starts`` and ``ends`` count code points. A null text counts
    as empty: no tokens, and the digest of no bytes. Null and repeated ids, repeated rows and ties are kept row by
    row; an empty table gives no rows; other columns, whatever their names, are left behind.
    """
    place = path or vocabulary_path()
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(place)
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = enc.encode(texts)
            out = {"n_tokens": lambda: [len(x) // 4 for x in ids], "ids": lambda: ids,
                   "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in ids]}
            spans = [enc.offsets(t, x) for t, x in zip(texts, ids, strict=True)] if {"starts", "ends"} & {*columns} else []
            back = [enc.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & {*columns} else []
            out |= {"starts": lambda: [s for s, _ in spans], "ends": lambda: [e for _, e in spans], "decoded": lambda: back,
                    "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in back]}
            types = {"n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.binary(), "starts": pa.list_(pa.int64()),
                     "ends": pa.list_(pa.int64())}
            arrays = [pa.array(out[c](), type=types.get(c, pa.string())) for c in columns]
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], names=["id", *columns])

    schema = f"id {key}, " + ", ".join(f"{c} {KINDS[c]}" for c in columns)
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the column ``decoded``, the bytes of ``ids_col``; null ids give null."""
    place = path or vocabulary_path()
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches):
        enc = encoder(place)
        for batch in batches:
            back = [None if x is None else enc.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(back, type=pa.binary())], names=[*kept, "decoded"])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept], "decoded binary"])
    return map_arrow(df.select(*kept), run, schema)
