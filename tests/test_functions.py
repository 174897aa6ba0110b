"""Column functions against small hand-made cases, and the rules chosen where behaviour was open."""

from pyspark.sql import functions as F

from linkloom.functions import equations as E
from linkloom.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_strip_tags(spark):
    assert one(spark, "<i>a</i>&alpha;&#946;&#x3b3; &lt;b&gt;&amp;", T.strip_tags) == "aαβγ <b>&"
    assert one(spark, "x <!-- <b> --> y", T.strip_tags) == "x  y"
    assert one(spark, "1 < 2", T.strip_tags) == "1 < 2"
    assert one(spark, "&Omega;-3 a&ndash;b &zeta; &amp;lt; &nosuch; &#x110000; &#55296; R&D; &", T.strip_tags) == "Ω-3 a–b ζ &lt; &nosuch; &#x110000; &#55296; R&D; &"


def test_synonyms(spark):
    norm = lambda v, k="compound": one(spark, v, lambda c: T.normalize_synonym(c, k))
    assert norm("an Alcohol (ambiguous)") == "alcohol"
    assert norm("Foo (non-preferred name)", "gene") == "foo"  # every qualifier goes
    assert norm("A Big One", "compound") == "a big one"  # only a lower case article counts
    assert norm("C1234567") is None and norm("C1234567", "protein") == "c1234567"


def test_ec(spark):
    assert one(spark, "1.2.3.-", lambda c: T.is_ec(c, 3)) and not one(spark, "1.2.3.-", lambda c: T.is_ec(c, 4))
    find = lambda v, n=3: one(spark, v, lambda c: T.find_ecs(c, n))
    assert find("see 1.2.3.4 and 2.3.4.n1;") == ["1.2.3.4", "2.3.4.n1"]
    assert find("1.2.3.4.5 x1.2.3.4y .1.2.3.4") == []
    assert find("1.234.5.6.7") == []  # the tail of a rejected hit is no hit
    assert [one(spark, v, lambda c: T.is_ec(c, 4)) for v in ("1.2.3.4", "1.2.3.n1", "1.2.3.-x", "1.2.3", None)] == [True, True, False, False, False]
    assert find("1.2.3.-", 3) == ["1.2.3.-"] and find("1.2.3.-", 4) == []


def test_small_helpers(spark):
    assert one(spark, "InChIKey=AB=C", T.strip_prefix) == "AB=C"
    assert one(spark, "HMDB0000122", T.hmdb_variants) == ["HMDB0000122", "HMDB122"]
    row = spark.range(1).select(
        T.join_values(F.array(F.lit("a"), F.lit("a"), F.lit("b"))).alias("j"), T.join_values(F.array().cast("array<string>")).alias("e"),
        T.n_missing(F.lit(None), F.lit(""), F.lit(1)).alias("n"), T.synonym_equal(F.lit("Cat"), F.lit("cats")).alias("p"),
    ).first()
    assert (row.j, row.e, row.n, row.p) == ("a ; b", "N_A", 2, True)


def test_signs(spark):
    for raw, want in {"A = B": "A <=> B", "A → B": "A => B", "A &lt;- B": "A <= B", "A &lt;=&gt; B": "A <=> B", "A  <--> B": "A <=> B"}.items():
        assert one(spark, raw, E.standardize_equation) == want
    for sign, way in E.SIGNS.items():
        assert one(spark, f"A {sign} B", E.find_sign) == f" {sign} " and one(spark, f" {sign} ", E.uniform_sign) == f" {way} "
    assert one(spark, " ? ", E.uniform_sign) == " ? " and one(spark, "A B", E.find_sign) is None
    assert one(spark, "A ? B", E.find_sign) == "?"
    assert one(spark, "x&lt;=y", E.fix_html_sign) == "x<=y"  # a left arrow stays a left arrow


def test_parse(spark):
    got = one(spark, "2 A + a compound + 2n B <=> (n+1) C + n D + E", E.parse_equation)
    assert [(p.side, p.pos, p.stoich, p.name) for p in got] == [
        ("left", 0, 2, "A"), ("left", 1, 1, "compound"), ("left", 2, -1, "B"), ("right", 0, -1, "C"), ("right", 1, -1, "D"), ("right", 2, 1, "E")]
    text = spark.createDataFrame([("2 A + 2n B => 1 C",)], "v string")
    assert text.select(E.format_equation(E.parse_equation("v"), E.direction("v")).alias("r")).first()["r"] == "2 A + 2n B => 1 C"


def test_align(spark):
    df = spark.createDataFrame([("2 x + y = z", "C1 + C2 = C3", ["C1", "C1", "C2", "C3"], ["C1", "C2", "C2", "C3"])], "n string, i string, l array<string>, m array<string>")
    r = df.select(E.align_equation("n", "i").alias("a"), E.align_ids("n", "l").alias("b"), E.align_ids("n", "m").alias("c")).first()
    assert [(p.stoich, p.name) for p in r.a] == [(2, "C1"), (1, "C2"), (1, "C3")]
    assert [p.name for p in r.b] == ["C1", "C2", "C3"] and [p.name for p in r.c] == ["C1", "C2", "C3"]
    same = spark.createDataFrame([("x = y", ["C1", "C1"])], "n string, l array<string>").select(E.align_ids("n", "l").alias("r")).first()["r"]
    assert [p.name for p in same] == ["C1", "C1"]
