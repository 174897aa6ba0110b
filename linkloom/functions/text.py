"""Column functions on text and id values. All of them stay inside the JVM: no Python UDF."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.arrays import let

# Qualifier tags removed from names.
QUALIFIERS = ["(non-preferred name)", "(brand name)", "(ambiguous)"]

# Shape of an enzyme number at the start of an id, and inside free text.
EC_START = r"^\d+\.\d+\.\d+(\.(-|\d+|([a-zA-Z]\d+)|[a-zA-Z]))?"
EC_TEXT = r"\d(?:\.(?:-|\d{1,3}|[a-zA-Z]\d{1,3})){2,3}"

MISSING = "N_A"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(col) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def decode_entities(col) -> Column:
    """Decode all character references that end in ``;``: decimal, hexadecimal, and every name that HTML defines.

    The text is split at ``&`` and each piece is decoded once, so what a reference decodes to is never decoded again.
    Unknown names and numbers beyond Unicode stay as they are. The text itself is computed once.
    """
    table = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}
    named = F.from_json(F.lit(json.dumps(table)), "map<string,string>")  # a constant, made once per plan

    def piece(p: Column) -> Column:
        body = F.substring_index(p, ";", 1)
        dec = F.regexp_extract(body, r"^#([0-9]{1,7})$", 1)
        hexa = F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]{1,6})$", 1)
        code = F.when(dec != "", F.hex(F.when(dec != "", dec).cast("bigint"))).when(hexa != "", hexa)
        good = F.length(body) < F.length(p)
        number = F.conv(code, 16, 10).cast("bigint")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        name = F.when(body.rlike("^[A-Za-z][A-Za-z0-9]*$"), F.try_element_at(named, body))
        found = F.when(good & F.startswith(body, F.lit("#")), char).when(good, name)
        rest = F.substring(p, F.length(body) + 2, F.length(p))
        return F.when(found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), p))

    def decoded(c: Column) -> Column:
        joined = F.array_join(F.transform(F.split(c, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")
        return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)

    return let(_c(col), decoded)


def strip_tags(col) -> Column:
    """Remove comments and markup, keep the text between tags, decode character references."""
    def bare(c: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"(?s)</?[a-zA-Z!?][^>]*>", "")
        return F.when(F.contains(c, F.lit("<")), plain).otherwise(c)

    return decode_entities(let(_c(col), bare))


def strip_prefix(col) -> Column:
    """Drop everything up to the first ``=`` (InChI and InChI key prefixes)."""
    return F.regexp_replace(_c(col), r"(?s)^[^=]*=", "")


def has_few_digits(col) -> Column:
    """A name is usable when less than a third of it is digits."""
    c = _c(col)
    return F.length(F.regexp_replace(c, r"[^0-9]", "")) * 3 < F.length(c)


def normalize_synonym(col, entity_type) -> Column:
    """Lower case, no line breaks, no qualifier tags; compound names lose an article and need few digits.

    ``entity_type`` is a plain string or a column. A rejected name becomes null.
    """
    raw = _c(col)
    kind = entity_type if isinstance(entity_type, Column) else F.lit(entity_type)
    name = squeeze(F.replace(F.lower(raw), F.lit("\n"), F.lit("")))
    for tag in QUALIFIERS:
        name = F.replace(name, F.lit(tag), F.lit(""))
    name = squeeze(name)
    bare = F.when(raw.rlike(r"^an?\s"), F.regexp_replace(name, r"^an?\s", "")).otherwise(name)
    compound = F.when(has_few_digits(bare), bare)
    return F.when(name == "", F.lit(None)).when(kind == "compound", compound).otherwise(name)


def _specified_levels(number: Column) -> Column:
    """How many levels of an enzyme number are given, that is, do not begin with a dash."""
    return F.size(F.filter(F.split(number, r"\."), lambda x: ~x.startswith("-")))


def is_ec(col, level: int = 3) -> Column:
    """True when the value starts like an enzyme number and has at least ``level`` specified levels."""
    return F.coalesce(_c(col).rlike(EC_START) & (_specified_levels(_c(col)) >= level), F.lit(False))


def find_ecs(col, level: int = 3) -> Column:
    """Distinct enzyme numbers in free text.

    A hit counts only if no ``.`` stands before it and no ``.``, letter, digit or ``-`` after it. The second
    branch of the pattern consumes a hit that fails the guard, so its tail is never read as another number.
    """
    greedy = EC_TEXT + "+"
    pattern = rf"(?:(?<!\.)({greedy})(?![.a-zA-Z0-9-])|{greedy})"
    hits = F.filter(F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(1)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.filter(hits, lambda x: _specified_levels(x) >= level)))


def hmdb_variants(col) -> Column:
    """The id itself and, for a zero padded HMDB id, its form without the zeros."""
    c = _c(col)
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"^HMDB0+", "HMDB")))


def clean_formula(col) -> Column:
    """Concatenate formula tokens without brackets and blanks; takes an array or a string."""
    return F.translate(F.array_join(_c(col), ""), "() ", "")


def is_available(col) -> Column:
    """False for null, empty and 'not available' values."""
    c = _c(col)
    return F.coalesce((c != "") & ~F.contains(F.lower(c), F.lit("not available")), F.lit(False))


def join_values(col, sep: str = " ; ") -> Column:
    """Distinct values joined in their order; an empty or missing list gives ``N_A``."""
    kept = F.filter(F.array_distinct(_c(col)), lambda x: x.isNotNull() & (x != "Not Available"))
    return F.coalesce(F.when(F.size(kept) > 0, F.array_join(kept, sep)), F.lit(MISSING))


def list_text(col) -> Column:
    """Values joined with ``' , '``; an empty or missing list gives an empty text."""
    return F.coalesce(F.array_join(_c(col), " , "), F.lit(""))


def plural_key(col) -> Column:
    """Join key under which a name and its plural meet; confirm hits with :func:`synonym_equal`."""
    return F.regexp_replace(F.lower(_c(col)), r"s+$", "")


def synonym_equal(a, b, mode: str = "plural") -> Column:
    """Name equality without case: ``exact``, ``plural`` (one side may have an extra ``s``) or ``contains`` (a in b)."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    if mode == "exact":
        return x == y
    if mode == "plural":
        return (x == y) | (x == F.concat(y, F.lit("s"))) | (F.concat(x, F.lit("s")) == y)
    if mode == "contains":
        return F.contains(y, x)
    raise ValueError(f"unknown mode {mode!r}")


def n_missing(*cols) -> Column:
    """How many of the fields are null or empty."""
    total = F.lit(0)
    for c in cols:
        v = _c(c)
        total = total + F.when(v.isNull() | (v.cast("string") == ""), 1).otherwise(0)
    return total


def any_missing(*cols) -> Column:
    return n_missing(*cols) > 0


def ids_overlap(a, b, ignore_case: bool = False) -> Column:
    """Do two id lists share a value."""
    x, y = _c(a), _c(b)
    if ignore_case:
        x, y = F.transform(x, F.lower), F.transform(y, F.lower)
    return F.coalesce(F.arrays_overlap(x, y), F.lit(False))
