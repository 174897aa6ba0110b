import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import pii
from tests.llm.helpers import awkward_docs, clashing, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
        return 13 <= len(digits) <= 19 and (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_pattern(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}


def base(spans):
    return {k: spans[k] for k in pii.BASE}


def test_whole_table_against_patterns(spark):
    docs = table(spark, "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = by_pattern(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(pii.listed(want, pii.BASE).encode()).hexdigest()
        assert r.spans.startswith(pii.listed(want, pii.BASE))
    assert sum(r.n_email for r in got) and sum(r.n_phone for r in got)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(list("0123456789") + ["@", ".", "-", "+", " ", "(", ")", "a", "Z", "%", "_", "é", "🙂", "1.2.3.4", "256.1.1.1", "@a.b", "4111 1111 1111 1111",
                                                      "+1 (555) 010-9999", "://", "iban", "account no: "]), max_size=24))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert base(pii.find_spans(text)) == by_pattern(text)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("pay IBAN: DE89 3704 0044 0532 0130 00 now", "account", "DE89 3704 0044 0532 0130 00"),
    ("Account no: 0123-4567-89.", "account", "0123-4567-89"),
    ("see https://me:pw@host.example.com/a, then", "address", "https://me:pw@host.example.com/a"),
    ("at http://192.168.0.1:80/x.", "address", "http://192.168.0.1:80/x"),
    ("mailto:jo@example.org?subject=x", "address", "mailto:jo@example.org?subject=x"),
    ("call tel:+1-555-010-9999;", "address", "tel:+1-555-010-9999"),
])
def test_added_kinds(text, kind, span):
    assert [text[a:b] for a, b in pii.find_spans(text)[kind]] == [span]


@pytest.mark.parametrize("text", ["IBAN: DE89 3704 0044 0532 0130 01", "accountant 123456789", "account of 12", "http://example.com/a", "myiban DE89370400440532013000",
                                  "hotel:1234567", "Account 123456a"])
def test_clean_text_has_no_added_spans(text):
    found = pii.find_spans(text)
    assert not found["address"] and not found["account"]


def test_awkward_rows(spark):
    docs = clashing(awkward_docs(spark))
    got = pii.personal_data(docs)
    assert got.count() == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got.filter("doc_id = 4").collect()} == {empty}
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_long_runs_stay_linear():
    for text in ("x://" * 250_000, "mailto:" * 150_000, "mailto:a@b.co," * 80_000, "x://y@" * 150_000, ".mailto:" * 150_000, "x://1.2.3.4/" * 80_000, "1" * 200_000, "a" * 200_000 + "@", "+" * 100_000, "a@" * 100_000, "1." * 100_000, "iban " * 50_000, "1 " * 100_000):
        begun = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - begun < 5, text[:20]


@pytest.mark.parametrize("text, spans", [
    ("see http://jo@h.org/?u=http://x, ok", ["http://jo@h.org/?u=http://x"]), ("mailto:a@b.co,mailto:c@d.co.", ["mailto:a@b.co", "mailto:c@d.co"]),
    ("mailto:a@b.co?body=http://x/ y", ["mailto:a@b.co?body=http://x/"]), ("http://x/,sip:a@b.co;", ["sip:a@b.co"]),
])
def test_several_schemes_in_a_run(text, spans):
    assert [text[a:b] for a, b in pii.find_spans(text)["address"]] == spans


def test_mask(spark):
    df = spark.createDataFrame([(1, "a@b.co and +1 555 010 9999", "x"), (2, None, "y"), (3, "mailto:a@b.co", "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.mask(df).collect()}
    assert got == {1: ("[email] and [phone]", "x"), 2: (None, "y"), 3: ("[address]", "z")}
