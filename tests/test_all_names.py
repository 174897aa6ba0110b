"""The sample queries over all part names, and the report in long form."""

import pytest

from linkloom.catalog import QUERIES, SQL
from linkloom.operators import samples as S
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_report_long(spark):
    counts = spark.createDataFrame([("S1", "A", 2), ("S1", "B", 1), ("S2", "C", 5)], "sample string, metabolite string, n long")
    assert sorted(map(tuple, S.report_long(counts).collect())) == [("S1", "A", 2), ("S1", "B", 1), ("S2", "C", 5)]
    want = [("S1", "A", 2), ("S1", "B", 1), ("S1", "C", 0), ("S2", "A", 0), ("S2", "B", 0), ("S2", "C", 5)]
    assert sorted(map(tuple, S.report_long(counts, ["A", "B", "C"]).collect())) == want
    assert S.report_long(counts.limit(0), ["A"]).count() == 0
    assert sorted(map(tuple, S.report_long(counts, ["A", "Z"]).collect())) == sorted(set(want[:2] + want[3:4] + want[5:] + [("S1", "Z", 0), ("S2", "Z", 0)]))


def test_report_matrix_names_every_metabolite(spark):
    counts = spark.createDataFrame([("S1", "A", 2), ("S1", "B", 1), ("S2", "C", 5)], "sample string, metabolite string, n long")
    assert sorted(map(tuple, S.report_matrix(counts, ["A", "B", "C", "Z"]).collect())) == [("S1", 2, 1, 0, 0), ("S2", 0, 0, 5, 0)]
    with pytest.raises(Exception, match="metabolite without a column: C"):
        S.report_matrix(counts, ["A", "B"]).collect()


def test_samples_with_equal_annotations(spark):
    """Samples that share all, some or none of their annotations, with repeated rows, against a plain count."""
    ann = [("S1", "ec", "1"), ("S1", "ec", "2"), ("S2", "ec", "2"), ("S2", "ec", "1"), ("S2", "ec", "1"), ("S3", "ec", "1"), ("S4", "kegg", "1"), ("S5", "ec", "9")]
    pa = [("P1", "ec", "1"), ("P2", "ec", "2"), ("P3", "kegg", "1")]
    rp = [("R1", "P1"), ("R2", "P1"), ("R2", "P2"), ("R3", "P3")]
    linked = [("R1", "C1"), ("R2", "C1"), ("R2", "C2"), ("R3", "C2")]
    mapping = [("M1", "C1"), ("M2", "C2"), ("M1", "C2")]
    make = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    got = S.organism_metabolites(make(pa, "protein_key id_type id_value"), make(ann, "sample id_type id_value"), make(rp, "reaction_key protein_key"),
                                 make(linked, "reaction_key compound_key"), make(mapping, "metabolite compound_key"))
    want = {}
    for s in {a[0] for a in ann}:
        proteins = {p for p, *a in pa if (s, *a) in ann}
        reactions = {r for r, p in rp if p in proteins}
        for r, c in linked:
            for m, c2 in mapping:
                if r in reactions and c == c2:
                    want.setdefault((s, m), set()).add((r, c))
    assert {(r.sample, r.metabolite): r.n for r in got.collect()} == {k: len(v) for k, v in want.items()}


def test_pairs_of_organisms_and_proteins(spark):
    """Pairs come out once whatever they share; nulls share nothing; keys with equal sets are all there; empty tables give none."""
    make = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    ann = make([("S1", "ec", "1"), ("S1", "ec", "2"), ("S2", "ec", "2"), ("S2", "ec", "1"), ("S3", "ec", None), ("S4", None, "1"), ("S5", "kegg", "1"), ("S6", "ec", "7")], "sample id_type id_value")
    pa = make([("P1", "ec", "1"), ("P1", "ec", "2"), ("P2", "ec", "2"), ("P3", "ec", None), ("P4", "ec", "2"), ("P4", "ec", "2"), ("P5", "kegg", "1")], "protein_key id_type id_value")
    got = sorted(map(tuple, S.organism_proteins(pa, ann).collect()))
    assert got == sorted((s, p) for s in ("S1", "S2") for p in ("P1", "P2", "P4")) + [("S5", "P5")]
    assert S.organism_proteins(pa.limit(0), ann).count() == S.organism_proteins(pa, ann.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["map_metabolites_all_names", "linked_reactions_all_names", "organism_proteins_all_names", "report_long_all_names"])
def test_against_sql(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_every_named_part_is_mapped(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").filter("p_name is not null").count()
    assert QUERIES["map_metabolites_all_names"](spark, SF).select("compound_key").distinct().count() == parts
