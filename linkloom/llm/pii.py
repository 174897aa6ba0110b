"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a deterministic local parser expands to the span's boundaries and validates it. Text without anchors is never
parsed, and every parser moves forward only, so the work is linear in the text.

Base kinds, leftmost and without overlap inside a kind; a match that fails its check is dropped and not retried:

* ``email``: a local part around an at-sign and a host of two labels or more;
* ``ip``: four dotted numbers, each at most 255;
* ``card``: 13 to 19 digits with single blanks or hyphens between, passing Luhn;
* ``phone``: a plus sign, digits and the usual separators, 9 to 15 digits.

Added kinds:

* ``address``: a URL that names a person or machine (with user information, or a numeric host), and mail, telephone
  and chat addresses given by their scheme;
* ``account``: the identifier after a cue such as IBAN or account; an IBAN must pass its checksum, others need 6 to 17
  digits, and must end where the token ends.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SCHEMES = ("://", "mailto:", "tel:", "sip:", "xmpp:")
NEXT_SCHEME = re.compile(rf"(?<![^\W_])(?:{'|'.join(SCHEMES[1:])})", re.I)
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_RIGHT = re.compile(r"[^\s<>\"'`]+")
AUTHORITY = re.compile(r"(?:([^\s/?#@]+)@)?(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._-]+)(?::[0-9]+)?")
TELEPHONE = re.compile(r"\+?[0-9](?:[().-]?[0-9]){5,17}")
GAP = re.compile(r"(?:[ \t]*(?:no|nr|number|num|id)\b\.?)?[ \t:#=.-]{1,4}", re.I)
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){5,16}(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_end(text: str, at: int) -> int:
    """End of a valid IBAN at ``at``, 0 if none: blanks may divide it, so shorter ends are tried group by group."""
    found = IBAN.match(text, at)
    end = found.end() if found else 0
    while end:
        code = text[at:end].replace(" ", "").upper()
        if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
        end = text.rfind(" ", at, end) if len(code) > 15 else 0
        end = max(end, 0)
    return 0


_machine = None


def anchors():
    """The automaton of all anchors, made once for each worker; values are (what, length)."""
    global _machine
    if _machine is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
            for w in words:
                for form in {w, w.upper(), w.capitalize()}:
                    a.add_word(form, (kind, len(w)))
        a.make_automaton()
        _machine = a
    return _machine


class Runs:
    """Runs of URL characters of one text; each run's end is found once, whatever number of schemes it holds."""

    def __init__(self, text: str):
        self.text, self.begin, self.stop, self.trimmed = text, 0, 0, 0

    def end(self, at: int) -> tuple[int, int]:
        """End of the run around ``at``, with closing punctuation and without."""
        if not self.begin <= at < self.stop:
            found = URL_RIGHT.match(self.text, at)
            self.begin, self.stop = at, found.end() if found else at
            self.trimmed = _trim(self.text, at, self.stop)
        return self.stop, self.trimmed


def _trim(text: str, start: int, end: int) -> int:
    while end > start and text[end - 1] in ".,;:!?)]}":
        end -= 1
    return end


def _address(text: str, start: int, word: str, runs: Runs) -> tuple[int, int] | None:
    """The span of an address by its scheme; no part of a run is parsed twice: an authority ends at a slash, the others at the next scheme."""
    at = start + len(word)
    if word == "://":
        _, end = runs.end(at)
        left = start
        while left and text[left - 1] in SCHEME_LEFT:
            left -= 1
        while left < start and not text[left].isalpha():
            left += 1
        host = AUTHORITY.match(text, at, end)
        if left == start or not host or not (host[1] or host[2].startswith("[") or IP.fullmatch(host[2])):
            return None
        return left, end
    if start and text[start - 1].isalnum():
        return None
    stop, _ = runs.end(at)
    following = NEXT_SCHEME.search(text, at, stop)
    cut = following.start() if following else stop
    end = _trim(text, at, cut)
    rest = text[at:end].split("?")[0]
    good = TELEPHONE.fullmatch(rest) if word == "tel:" else "@" in rest and HOST.fullmatch(rest.rpartition("@")[2].split(";")[0])
    return (start, end) if good else None


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    if start and text[start - 1].isalnum():
        return None
    gap = GAP.match(text, end)
    at = gap.end() if gap else -1
    if at < 0 or at >= len(text):
        return None
    stop = iban_end(text, at)
    if not stop and text[start:end].lower() != "iban":
        found = ACCOUNT.match(text, at)
        stop = found.end() if found else 0
    return (at, stop) if stop else None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, in order; positions are code points, ends exclusive."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    last_digit = -2
    runs = Runs(text)
    for at, (what, size) in anchors().iter(text):
        if what == "digit":
            begins, last_digit = at != last_digit + 1, at
            if not begins:
                continue
            if at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    spans["ip"].append(m.span())
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif what == "at":
            left = at
            while left > done["email"] and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := HOST.match(text, at + 1)):
                done["email"] = m.end()
                spans["email"].append((left, m.end()))
        elif what == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        else:
            start = at - size + 1
            kind = "address" if what == "scheme" else "account"
            if start >= done[kind]:
                span = _address(text, start, text[start : at + 1].lower(), runs) if what == "scheme" else _account(text, start, at + 1)
                if span and span[0] >= done[kind]:
                    done[kind] = span[1]
                    spans[kind].append(span)
    return spans


def listed(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_address, n_account)`` for every row.

    ``spans`` lists ``kind:start:end`` by kind in the order of ``KINDS``, then by start; ``base_sha256`` is the digest of
    the same list for base kinds only. A null or empty text has no spans and the digest of an empty list. Null ids and
    repeated rows are kept row by row, an empty table gives no rows, other columns are left behind.
    """
    key = docs.schema[id_col].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for part in slices(batches, "text"):
            found = [find_spans(t or "") for t in part.column("text").to_pylist()]
            cols = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], pa.string()))
            cols.append(pa.array([listed(f, KINDS) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("id"), *cols], names=["id", *counts, "base_sha256", "spans"])

    schema = f"id {key}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)
    return out.withColumnRenamed("id", id_col)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; overlapping spans become one, named by the first.

    A null text stays null; all other columns and rows stay as they are.
    """
    names = docs.columns

    def run(batches):
        for part in slices(batches, text_col):
            out = []
            for t in part.column(text_col).to_pylist():
                spans = sorted((s, -e, k) for k, v in find_spans(t or "").items() for s, e in v)
                parts, upto = [], 0
                for s, e, k in spans:
                    if s >= upto:
                        parts += [t[upto:s], f"[{k}]"]
                    upto = max(upto, -e)
                out.append(t if not spans else "".join([*parts, t[upto:]]))
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(docs, run, schema)
