"""Small tables with the awkward rows that every operator must take."""

import re

import duckdb

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))


def awkward():
    """Nulls in every column, empty, blank and long texts, repeated rows, equal texts, ids that occur twice."""
    p = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, p, "en", "a", 60), (2, p, "en", "a", 60), (2, p, "en", "a", 60), (3, p.upper(), "en", None, None), (4, None, None, None, None),
        (None, p, "en", "a", 60), (None, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n\x0b\f\r ", "en", "b", 7), (7, "word", "de", "b", 4),
        (8, "word", "de", "b", 4), (9, LONG, "en", "c", len(LONG)), (10, "ä ö ü 日本語 🙂 é", None, "c", 10), (11, p + " thirteen", "en", "c", 70),
        (5, "a different text under a used id with words enough to count as more", "en", "b", 60),
    ]


def awkward_docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def clashing(df):
    """Extra columns whose names an operator may want for itself."""
    from pyspark.sql import functions as F

    for i, c in enumerate(["n_words", "size", "taken", "hash", "gone", "pos", "n", "id", "grp", "component_id", "ids", "slot", "w", "part", "_id_", "lines", "d", "x0"]):
        df = df.withColumn(c, F.lit(f"extra{i}"))
    return df


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def duck(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()


def rows(df, *cols):
    """Rows as sorted tuples, nulls first."""
    got = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(got, key=lambda r: [(v is not None, v) for v in r])
