"""Column functions on reaction style equations such as ``2 A + B <=> C``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.arrays import let
from linkloom.functions.text import MISSING, _c, squeeze

# Signs that stand between blanks, and the direction they mean.
SIGNS = {
    "=": "<=>", "<=>": "<=>", "↔": "<=>", "⇄": "<=>", "<->": "<=>", "<-->": "<=>", "&lt;=&gt;": "<=>",
    "=>": "=>", "→": "=>", "->": "=>", "&gt;": "=>", "=&gt;": "=>", "-&gt;": "=>",
    "<=": "<=", "←": "<=", "<-": "<=", "&lt;": "<=", "&lt;=": "<=", "&lt;-": "<=",
}
# Escaped arrows that need no blanks, in the order in which they are replaced.
ESCAPED = {"&lt;=&gt;": "<=>", "[=-]?&gt;": "=>", "&lt;[=-]?": "<="}
DIRECTIONS = ("<=>", "=>", "<=")  # the first one an id equation holds is its sign

# Leading multipliers. "a"/"an" mean one; n-like tokens mean an undefined amount.
MULTIPLIER = r"^((?:\d+n)|(?:\d+ )|(?:a )|(?:an )|(?:[b-z]\s)|(?:\(\d?n[+\-]?\d?\)))"
ONE = r"^an?$"
NUMBER = r"^\d+$"
UNDEFINED = -1


def find_sign(col) -> Column:
    """The direction sign with its blanks; a ``?`` when nothing else is found; null when there is none."""
    c = _c(col)
    any_sign = "( (?:" + "|".join(SIGNS) + ") )"  # none of the signs holds a character with a meaning in patterns
    return let(F.regexp_extract(c, any_sign, 1), lambda sign: F.when(sign != "", sign).when(F.contains(c, F.lit("?")), F.lit("?")))


def uniform_sign(sign) -> Column:
    """The usual sign of the same direction, with its blanks; anything else stays."""
    ways = F.create_map(*[F.lit(f" {x} ") for pair in SIGNS.items() for x in pair])
    return F.coalesce(F.try_element_at(ways, _c(sign)), _c(sign))


def fix_html_sign(col) -> Column:
    """Turn escaped arrows without blanks around them into plain ones."""
    return reduce(lambda c, arrow: F.regexp_replace(c, *arrow), ESCAPED.items(), _c(col))


def standardize_equation(col) -> Column:
    """One spelling per direction: ``' <=> '``, ``' => '`` or ``' <= '``; doubled blanks collapsed.

    A side may be empty: the sign at the edge keeps both its blanks, other blanks at the edges go.
    """
    def unify(x: Column) -> Column:
        text, sign = x["text"], x["sign"]
        return F.when(sign.isNotNull() & (sign != "?"), F.replace(text, sign, uniform_sign(sign))).otherwise(text)

    clean = squeeze(F.replace(_c(col), F.lit("  "), F.lit(" ")))
    signed = let(F.concat(F.lit(" "), clean, F.lit(" ")), lambda t: F.struct(t.alias("text"), find_sign(t).alias("sign")))
    out = fix_html_sign(let(signed, unify))
    return F.regexp_replace(F.regexp_replace(out, r"^ +(?!(?:<=>|=>|<=) )", ""), r"(?<! (?:<=>|=>|<=)) +$", "")


def direction(col) -> Column:
    """``<=>``, ``=>`` or ``<=`` of an equation whatever its spelling."""
    return let(find_sign(col), lambda sign: F.trim(uniform_sign(F.when(sign != "?", sign))))


def _terms(tokens: Column) -> Column:
    """Raw terms to ``array<struct<stoich, stoich_raw, name>>``; one pass per step, so nothing is computed twice."""
    clean = F.transform(tokens, lambda t: F.trim(t))
    marked = F.transform(clean, lambda t: F.struct(t.alias("t"), F.regexp_extract(F.lower(t), MULTIPLIER, 1).alias("mark")))

    def term(x: Column) -> Column:
        bare = F.trim(x["mark"])
        stoich = (
            F.when(bare == "", F.lit(1))
            .when(bare.rlike(ONE), F.lit(1))
            .when(bare.rlike(NUMBER), bare.try_cast("int"))
            .otherwise(F.lit(UNDEFINED))
        )
        name = F.trim(F.substring(x["t"], F.length(x["mark"]) + 1, F.length(x["t"])))
        return F.struct(stoich.alias("stoich"), bare.alias("stoich_raw"), name.alias("name"))

    return F.transform(marked, term)


def parse_equation(col, plus: str = " + ") -> Column:
    """Equation to ``array<struct<side, pos, stoich, stoich_raw, name>>`` in reading order; null without a sign.

    An empty side gives no parts, also where the blank next to the sign has been trimmed.
    """
    quoted = "\\Q" + plus + "\\E"

    def side(name: str, text: Column) -> Column:
        terms = F.filter(F.split(text, quoted), lambda t: F.trim(text) != "")
        return F.transform(_terms(terms), lambda t, i: F.struct(
            F.lit(name).alias("side"), i.alias("pos"), t["stoich"].alias("stoich"), t["stoich_raw"].alias("stoich_raw"),
            t["name"].alias("name")))

    def parts(x: Column) -> Column:
        text, sign = x["text"], x["sign"]
        at = F.instr(text, sign)
        return F.when(sign.isNotNull(), F.concat(
            side("left", F.substring(text, F.lit(1), at - 1)),
            side("right", F.substring(text, at + F.length(sign), F.length(text)))))

    return let(F.concat(F.lit(" "), _c(col), F.lit(" ")), lambda c: let(F.struct(c.alias("text"), find_sign(c).alias("sign")), parts))


def align_equation(name_eq, id_eq) -> Column:
    """Parts of the id equation with the stoichiometry of the name equation, matched by position."""
    both = F.struct(parse_equation(name_eq).alias("names"), parse_equation(id_eq).alias("ids"))
    return let(both, lambda x: F.transform(
        x["ids"],
        lambda p, i: p.withField("stoich", F.coalesce(F.try_element_at(x["names"], i + 1)["stoich"], p["stoich"]))))


def align_ids(name_eq, ids) -> Column:
    """Parts of the name equation with ids taken from a flat list.

    When the lengths differ, looser ``+`` splits of the name equation are tried, then runs of the same id
    are merged, keeping a repeat across the sign if one is needed. Null when nothing fits.
    """
    given = _c(ids)

    def zipped(parts: Column, values: Column) -> Column:
        return F.when(
            F.size(parts) == F.size(values),
            F.transform(parts, lambda p, i: p.withField("name", F.element_at(values, i + 1))),
        )

    def loose(plus: str) -> Column:
        return let(parse_equation(name_eq, plus), lambda parts: zipped(parts, given))

    def merged_runs(x: Column) -> Column:
        n, once = x["n_left"], x["once"]
        across = F.concat(F.slice(once, F.lit(1), n), F.slice(once, n, F.greatest(F.size(once) - n + 1, F.lit(0))))
        return F.coalesce(
            zipped(x["parts"], once),
            F.when((n > 0) & (F.size(once) >= n), let(across, lambda ids_: zipped(x["parts"], ids_))),
        )

    def fit(parts: Column) -> Column:
        once = F.filter(given, lambda v, i: (i == 0) | ~v.eqNullSafe(F.try_element_at(given, i)))
        n_left = F.size(F.filter(parts, lambda p: p["side"] == "left"))
        runs = F.struct(parts.alias("parts"), once.alias("once"), n_left.alias("n_left"))
        return F.coalesce(zipped(parts, given), loose(" +"), loose("+ "), let(runs, merged_runs))

    return let(parse_equation(name_eq), fit)


def format_equation(parts, sign, with_stoich: bool = True) -> Column:
    """Parts back to text; a missing name is written ``N_A``, a missing stoichiometry ``1``."""
    p = _c(parts)

    def side_text(side: str) -> Column:
        def one(x: Column) -> Column:
            name = F.coalesce(F.when(x["name"] != "", x["name"]), F.lit(MISSING))
            if not with_stoich:
                return name
            amount = F.when(x["stoich"] == UNDEFINED, F.coalesce(F.when(x["stoich_raw"] != "", x["stoich_raw"]), F.lit("n")))
            amount = F.coalesce(amount, x["stoich"].cast("string"), F.lit("1"))
            return F.concat_ws(" ", amount, name)

        chosen = F.array_sort(
            F.transform(
                F.filter(p, lambda x: x["side"] == side),
                lambda x: F.struct(x["pos"].alias("pos"), one(x).alias("t")),
            )
        )
        return F.array_join(F.transform(chosen, lambda x: x["t"]), " + ")

    arrow = F.trim(_c(sign))
    return F.concat(side_text("left"), F.lit(" "), arrow, F.lit(" "), side_text("right"))


def equation_sides(col) -> Column:
    """``struct<sign, reversible, left, right>`` of an id equation, both sides split on ``+``; an empty side is an empty list.

    The equation is computed once, however costly the expression that makes it.
    """
    def ids(t: Column) -> Column:
        return F.transform(F.filter(F.split(t, r"\+"), lambda x: F.trim(t) != ""), lambda x: F.trim(x))

    def read(x: Column) -> Column:
        c, sign = x["text"], x["sign"]
        at = F.instr(c, sign)
        return F.struct(
            sign.alias("sign"),
            F.contains(c, F.lit("<=>")).alias("reversible"),
            ids(F.substring(c, F.lit(1), at - 1)).alias("left"),
            ids(F.substring(c, at + F.length(sign), F.length(c))).alias("right"),
        )

    def signed(c: Column) -> Column:
        sign = F.coalesce(*[F.when(F.contains(c, F.lit(way)), F.lit(way)) for way in DIRECTIONS])
        return let(F.struct(c.alias("text"), sign.alias("sign")), read)

    return let(_c(col), signed)


def equation_ids(col) -> Column:
    """All whole numbers in an equation, in order."""
    return F.regexp_extract_all(_c(col), F.lit(r"(\d+)"), F.lit(1))
