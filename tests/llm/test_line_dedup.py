import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import line_dedup
from tests.llm.helpers import WORD, awkward_docs, clashing, table

DOC = "doc_id long, text string"


def chunks(text):
    lines = text.split("\n")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        if i + 1 == len(lines) or (i and md5(md5(lines[i - 1]) + md5(line))[0] < "5"):
            out.append(now)
            now = []
    return out


def by_hand(docs, min_lines=2):
    """``[(id, text)]`` to ``[(id, text, chunks, lines)]``; ids are unique and not null."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        kept, gone, lines = [], 0, 0
        for c in chunks(text or ""):
            body = "\n".join(c)
            if sum(bool(WORD.search(x)) for x in c) >= min_lines and body in seen:
                gone, lines = gone + 1, lines + len(c)
            else:
                kept.append(body)
                seen.add(body)
        out[i] = (None if text is None else "\n".join(kept), gone, lines)
    return out


def result(df):
    return {r.doc_id: (r.text, r.chunks_removed, r.lines_removed) for r in df.collect()}


def test_whole_table(spark):
    docs = table(spark, "documents")
    got = result(line_dedup.remove_repeated(docs))
    want = by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got == want and sum(g for _, g, _ in got.values()) > 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a b", "c", "", " ", "d e f", "g", "h", "i j"]), max_size=12), max_size=6))
def test_small_tables(spark, texts):
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    assert result(line_dedup.remove_repeated(spark.createDataFrame(docs, DOC))) == by_hand(docs)


def test_passage_is_found_at_any_shift(spark):
    passage = "\n".join(f"shared line {k} with some words" for k in range(30))
    docs = [(i, "\n".join(f"own {i} {k}" for k in range(i % 7)) + "\n" + passage + f"\nend {i}") for i in range(12)]
    got = result(line_dedup.remove_repeated(spark.createDataFrame(docs, DOC)))
    assert got[0][1] == 0
    for i in range(1, 12):
        assert got[i][2] >= 20 and f"end {i}" in got[i][0] and all(f"own {i} {k}" in got[i][0] for k in range(i % 7))


def test_awkward_rows(spark):
    two = "first shared line\nsecond shared line"
    docs = clashing(awkward_docs(spark)).unionByName(clashing(spark.createDataFrame(
        [(20, two, "en", "a", 1), (21, two, "en", "a", 1), (21, two, "en", "a", 1), (None, two, "en", "a", 1), (20, two, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")))
    out = line_dedup.remove_repeated(docs)
    assert out.columns == [*docs.columns, "chunks_removed", "lines_removed"] and out.count() == docs.count()
    got = sorted((r.doc_id or 0, r.text, r.lines_removed) for r in out.filter("doc_id >= 20 or (doc_id is null and text is not null)").collect())
    lost = [(i, t) for i, t, n in got if n]
    whole = len(chunks(two)) == 1
    if whole:
        assert [i for i, _ in lost] == [0, 21, 21] and {t for _, t in lost} == {""}
    same = docs.filter("doc_id < 20").select("doc_id", "text").exceptAll(out.filter("doc_id < 20").select("doc_id", "text"))
    assert same.count() == 0
    assert line_dedup.remove_repeated(docs.limit(0)).count() == 0


def test_equal_hashes_with_other_bytes_stay(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else F.lit(8).cast("long"))
    docs = [(1, "a a\nb b"), (2, "c c\nd d"), (3, "a a\nb b")]
    if all(len(chunks(t)) == 1 for _, t in docs):
        got = result(line_dedup.remove_repeated(spark.createDataFrame(docs, DOC)))
        assert got[1][0] == "a a\nb b" and got[2][0] == "c c\nd d"
