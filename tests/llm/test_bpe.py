import hashlib
import random
import time

import numpy as np
import pytest

from linkloom.llm import bpe, token_counts
from tests.llm.helpers import awkward_docs, clashing, table

COLUMNS = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "starts", "ends"]


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary_path())


def plain(enc, text):
    return np.array(enc.tiktoken.encode_ordinary(text or ""), dtype="<u4").tobytes()


def hold(enc, texts, got):
    for text, r in zip(texts, got, strict=True):
        want, raw = plain(enc, text), (text or "").encode()
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest() and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        chars = [k for k, c in enumerate(text or "") for _ in c.encode()]  # the character of each byte
        ends = np.cumsum(enc.token_size[np.frombuffer(want, "<u4")]).tolist()
        assert list(r.starts) == [chars[a] for a in [0, *ends[:-1]][: len(ends)]]
        assert list(r.ends) == [chars[b - 1] + 1 for b in ends]


def test_whole_table_is_what_tiktoken_gives(spark, enc):
    docs = table(spark, "documents")
    hold(enc, [r.text for r in docs.select("text").collect()], bpe.encode_texts(docs, COLUMNS).collect())


def test_awkward_rows_and_clashing_columns(spark, enc):
    docs = clashing(awkward_docs(spark))
    got = bpe.encode_texts(docs, COLUMNS)
    assert got.columns == ["doc_id", *COLUMNS]
    hold(enc, [r.text for r in docs.select("text").collect()], got.collect())
    assert bpe.encode_texts(docs.limit(0), COLUMNS).count() == 0


def test_overlapping_merges_and_unassigned_characters(enc):
    rng, parts = random.Random(1), ["a", "aa", "ab", "-", "--", " ", "\n", "é", "1", "​", "日", "𝔘", "\x1c", "՘", "͸", "er", "ere"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        assert enc.encode([text])[0] == plain(enc, text)
        assert enc.decode(plain(enc, text)) == text.encode()


def test_every_doubtful_token_row(enc):
    rows = bpe.overlapping(enc.ranks)
    assert rows and all(enc._doubted(raw) for raw in rows)
    for raw in rows:
        text = raw.decode("utf-8", "ignore")
        for t in (text, text * 2, "x" + text + text[:1], text * 7):
            assert enc.encode([t])[0] == plain(enc, t)


def test_one_match_of_a_million_characters(spark, enc):
    rng = random.Random(2)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000))
    coded = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    for text in (han, coded, "a" * 1_000_000, "=" * 1_000_000, "日本" * 500_000, "ab" * 500_000, " " * 1_000_000):
        begun = time.perf_counter()
        got = enc.encode([text])[0]
        assert time.perf_counter() - begun < 5, text[:10]
        # the whole text is one match; tiktoken's own pattern gives up on a million blanks
        assert got == np.array(enc.tiktoken._encode_single_piece(text.encode()), dtype="<u4").tobytes()
    assert enc.decode(enc.encode(["\u0378" + " " * 1_000_000])[0]) == ("\u0378" + " " * 1_000_000).encode()
    df = spark.createDataFrame([(1, han), (2, coded)], "doc_id long, text string")
    assert [r.n_tokens for r in bpe.encode_texts(df, ["doc_id", "n_tokens"][1:]).orderBy("doc_id").collect()] == [len(plain(enc, t)) // 4 for t in (han, coded)]


def test_decode_joins_split_characters(spark, enc):
    ids = enc.encode(["𝔘𝔫𝔦 日本"])[0]
    df = spark.createDataFrame([(1, bytearray(ids), "x"), (2, None, "y"), (3, bytearray(), "z")], "k long, ids binary, decoded string")
    got = {r.k: r.decoded for r in bpe.decode_ids(df).collect()}
    assert bytes(got[1]).decode() == "𝔘𝔫𝔦 日本" and got[2] is None and bytes(got[3]) == b""


def test_cache_stays_bounded(enc, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 10 * bpe.CACHE_ENTRY)
    for i in range(30):
        enc.encode([f"word{i} and{i} more{i}"])
    assert len(enc.cache) < 40


def by_hand(text, ids, enc, rule, spans):
    starts, ends = enc.offsets(text, ids)
    out, outside = [0.0] * len(spans), 0.0
    for s, e in zip(starts, ends, strict=True):
        part = [max(0, min(e, b) - max(s, a)) for a, b in spans]
        if rule == "share":
            for k, p in enumerate(part):
                out[k] += p / (e - s)
            outside += 1 - sum(part) / (e - s)
            continue
        at = s if rule == "first" else e - 1
        hit = [k for k, (a, b) in enumerate(spans) if a <= at < b]
        if rule == "most":
            best = max(range(len(spans)), key=lambda k: (part[k], -k)) if spans else None
            hit = [best] if spans and part[best] and part[best] >= (e - s) - sum(part) else []
        if hit:
            out[hit[0]] += 1
        else:
            outside += 1
    return out, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, enc, rule):
    texts = ["one two\nthree\n\n\n four five", "no break", "", None, "\n\n\n", "日本語\n🙂 é\nword word", "tail\n"]
    docs = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id\nhere"), (1, "no break")], "doc_id long, text string"))
    got = token_counts.section_tokens(docs, rule=rule)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        if i == 1:
            assert len(seen[1]) == 2 and seen[1][0].n_tokens == seen[1][1].n_tokens
            continue
        want = [] if not t else [(sum(len(x) for x in t.splitlines(True)[:k]), sum(len(x) for x in t.splitlines(True)[: k + 1])) for k in range(len(t.splitlines(True)))]
        mine = sorted((r for r in seen[i] if r.section >= 0), key=lambda r: r.section)
        assert [(r.start_char, r.end_char) for r in mine] == want
        counts, outside = by_hand(t or "", plain(enc, t), enc, rule, want)
        assert [r.n_tokens for r in mine] == pytest.approx(counts) and outside == pytest.approx(0)
        assert sum(r.n_tokens for r in seen[i]) == pytest.approx(len(plain(enc, t)) // 4)
    assert token_counts.section_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_given_sections_with_gaps(spark, enc, rule):
    text = "alpha beta gamma-delta 日本 epsilon"
    spans = [(0, 3), (3, 3), (8, 14), (20, 25)]
    docs = spark.createDataFrame([(1, text, [{"start": a, "end": b} for a, b in spans]), (2, text, []), (3, text, None)],
                                 "doc_id long, text string, s array<struct<start: long, end: long>>")
    got = token_counts.section_tokens(docs, sections_col="s", rule=rule).collect()
    counts, outside = by_hand(text, plain(enc, text), enc, rule, spans)
    mine = {r.section: r.n_tokens for r in got if r.doc_id == 1}
    assert [mine.get(k, 0) for k in range(4)] == pytest.approx(counts) and mine.get(-1, 0) == pytest.approx(outside)
    assert all(r.section == -1 and r.n_tokens == r.doc_tokens for r in got if r.doc_id in (2, 3))


def test_frequent_matches_outlive_a_full_cache(enc, monkeypatch):
    """What is met again moves on to the newer generation and is not encoded anew."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 40 * bpe.CACHE_ENTRY)
    asked, old = [], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda pieces: asked.extend(pieces) or old(pieces))
    for i in range(60):
        enc.encode([f"frequent once{chr(97 + i % 26)}{chr(97 + i // 26)} only"])
    assert asked.count("frequent") <= 1 and asked.count(" only") <= 1
    assert len(enc.cache) + len(enc.older) < 60
