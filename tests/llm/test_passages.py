from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import line_dedup
from tests.llm.helpers import WORD, awkward_docs, clashing, table

DOC = "doc_id long, text string"


def by_hand(docs, min_lines=2):
    """``[(id, text)]`` to ``{id: (text, lines)}``; ids are unique and not null."""
    runs, first = [], {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        for a, b in zip(full, full[min_lines - 1 :]):
            body = "\n".join(lines[a : b + 1])
            first.setdefault(body, (i, a))
            runs.append((i, a, b, body))
    often, gone, held = Counter(r[3] for r in runs), set(), set()
    for i, a, b, body in runs:
        if often[body] > 1:
            (held if first[body] == (i, a) else gone).update((i, k) for k in range(a, b + 1))
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone - held]
        out[i] = (None if text is None else "\n".join(kept), len(lines) - len(kept))
    return out


def result(df):
    return {r.doc_id: (r.text, r.lines_removed) for r in df.collect()}


def test_short_passages_in_foreign_surroundings(spark):
    docs, n = [], 0
    for size in (2, 3, 4, 5, 6):
        for k in range(8):
            passage = [f"passage {size} {k} line {j}" for j in range(size)]
            for _ in range(2):
                docs.append((n, "\n".join([f"before {n}", *passage, f"after {n}"]), passage))
                n += 1
    got = result(line_dedup.remove_passages(spark.createDataFrame([d[:2] for d in docs], DOC)))
    for i, text, passage in docs:
        assert got[i] == ((text, 0) if i % 2 == 0 else (f"before {i}\nafter {i}", len(passage)))


def test_whole_table(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    want = by_hand([tuple(r) for r in docs.collect()])
    assert result(line_dedup.remove_passages(docs)) == want
    chunks = line_dedup.remove_repeated(docs).agg(F.sum("lines_removed")).first()[0]
    assert sum(n for _, n in want.values()) > chunks > 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a b", "c", "", " ", "d e f", "g"]), max_size=12), max_size=6), st.sampled_from([1, 2, 3]))
def test_small_tables(spark, texts, min_lines):
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    assert result(line_dedup.remove_passages(spark.createDataFrame(docs, DOC), min_lines=min_lines)) == by_hand(docs, min_lines)


def test_awkward_rows(spark):
    two = "first shared line\n\nsecond shared line"
    more = [(20, two, "en", "a", 1), (21, two, "en", "a", 1), (21, two, "en", "a", 1), (None, two, "en", "a", 1), (20, two, "en", "a", 1)]
    docs = clashing(awkward_docs(spark)).unionByName(clashing(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")))
    out = line_dedup.remove_passages(docs)
    assert out.columns == [*docs.columns, "lines_removed"] and out.count() == docs.count()
    got = sorted(((r.doc_id or 0), r.text, r.lines_removed) for r in out.filter("doc_id >= 20 or (doc_id is null and text like '%shared%') or (doc_id is null and text = '')").collect())
    assert got == [(0, "", 3), (20, two, 0), (20, two, 0), (21, "", 3), (21, "", 3)]
    same = docs.filter("doc_id < 20").select("doc_id", "text").exceptAll(out.filter("doc_id < 20").select("doc_id", "text"))
    assert same.count() == 0 and line_dedup.remove_passages(docs.limit(0)).count() == 0
