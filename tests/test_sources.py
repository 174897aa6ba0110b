"""Micro files in each source format, with invented values."""

from linkloom.plans.annotate import annotate
from linkloom.sinks import export as B
from linkloom.sources import annotations as A
from linkloom.sources import models as MD
from linkloom.sources import pages as P
from linkloom.sources import records as R
from linkloom.sources import seeds as S
from linkloom.sources import tables as T
from linkloom.sinks.export import log_batch, read_ledger
from linkloom.streaming.ledger import follow_seeds


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_text(text, encoding=encoding)
    return str(p)


def test_record_file_is_latin1(spark, tmp_path):
    path = put(tmp_path, "c.dat", "# head\nUNIQUE-ID - CPD-1\nCOMMON-NAME - café <i>x</i>\nCHEMICAL-FORMULA - (C 6)\nCHEMICAL-FORMULA - (H 12)\n"
               "DBLINKS - (CHEBI \"17\" NIL |a| 1)\n//\nUNIQUE-ID - CPD-2\nINCHI - InChI=1S/x\n//\n", "iso-8859-1")
    got = {(r.entity_key, r.id_type, r.id_value) for r in R.records_to_xref(R.read_records(spark, path), "compound").collect()}
    assert got == {("CPD-1", "metacyc", "CPD-1"), ("CPD-1", "synonyms", "café x"), ("CPD-1", "chemical_formula", "C6H12"), ("CPD-1", "chebi", "17"),
                   ("CPD-2", "metacyc", "CPD-2"), ("CPD-2", "inchi", "1S/x")}


def test_records_begin_at_line_starts(spark, tmp_path):
    """The mark inside a comment, heads without ``#``, files without a head, Windows line ends, and splits at any byte."""
    (tmp_path / "r").mkdir()
    put(tmp_path / "r", "a.dat", "Compounds of some database\nVersion - 7\n\nUNIQUE-ID - C1\nCOMMENT - see UNIQUE-ID - C9 and\n/UNIQUE-ID - C8\nCOMMON-NAME - one\n//\nUNIQUE-ID - C2\nCOMMON-NAME - two\n//\n")
    put(tmp_path / "r", "b.dat", "UNIQUE-ID - C3\r\nCOMMON-NAME - three\r\n//\r\nUNIQUE-ID - C4\r\nCOMMON-NAME - four\r\n//\r\n")
    put(tmp_path / "r", "c.dat", "# only a head\n# no records\n")
    put(tmp_path / "r", "d.dat", "")
    put(tmp_path / "r", "e.dat", "# head\n" + "".join(f"UNIQUE-ID - D{i}\nCOMMENT - {'x' * (i % 37)} UNIQUE-ID - no\nCOMMON-NAME - name {i}\n//\n" for i in range(200)))
    want = {("C1", "one"), ("C2", "two"), ("C3", "three"), ("C4", "four")} | {(f"D{i}", f"name {i}") for i in range(200)}
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        for n in (before, "1009", "173", "64"):
            spark.conf.set(size, n)
            x = R.records_to_xref(R.read_records(spark, str(tmp_path / "r")), "compound").filter("id_type = 'synonyms'").collect()
            assert len(x) == len(want) and {(r.entity_key, r.id_value) for r in x} == want, n
    finally:
        spark.conf.set(size, before)


def test_reaction_file(spark, tmp_path):
    path = put(tmp_path, "r.dat", "UNIQUE-ID - RXN-1\nEC-NUMBER - EC-1.1.1.1\nLEFT - A\n^COEFFICIENT - 2\nLEFT - B\nRIGHT - C\n^COEFFICIENT - n\n"
               "REACTION-DIRECTION - PHYSIOL-RIGHT-TO-LEFT\n//\nUNIQUE-ID - RXN-2\n//\n")
    xref, part, reaction = R.read_reactions(spark, path)
    assert [(r.side, r.pos, r.stoich, r.compound_key) for r in part.orderBy("side", "pos").collect()] == [("left", 0, 2, "A"), ("left", 1, 1, "B"), ("right", 0, -1, "C")]
    assert reaction.first()["equation"] == "2 A + 1 B <= n C"
    assert ("RXN-1", "1.1.1.1") in {(r.entity_key, r.id_value) for r in xref.collect()}


def test_tables(spark, tmp_path):
    x = put(tmp_path, "x.tsv", "RHEA_ID\tDIRECTION\tMASTER_ID\tID\tDB\n1\tUN\t1\tR1\tKEGG_REACTION\n2\tLR\t1\tZ\tGO\n2\tLR\t1\tE\tECOCYC\n")
    assert {tuple(r) for r in T.read_rhea_xrefs(spark, x).collect()} == {("1", "kegg", "R1"), ("1", "metacyc", "E")}
    d = put(tmp_path, "d.tsv", "M\tL\tR\tB\n1\t2\t3\t4\n")
    assert {tuple(r) for r in T.read_alt_ids(spark, d).collect()} == {("2", "1"), ("3", "1"), ("4", "1")}
    t = put(tmp_path, "t.txt", "ENTRY       RHEA:10\nDEFINITION  a + b = c\nEQUATION    CHEBI:1,CHEBI:2 = CHEBI:3\n///\n")
    assert T.read_rhea_reactions(spark, t).first()["equation"] == "1 + 2 <=> 3"
    o = put(tmp_path, "o.obo", 'x\n[Term]\nid: CHEBI:7\nalt_id: CHEBI:8\nproperty_value: u/smiles "CC" xsd:string\n[Term]\nid: CHEBI:9\n')
    assert {tuple(r) for r in T.read_obo(spark, o).collect()} == {("7", "chebi", "8"), ("7", "smiles", "CC")}


def test_model_file(spark, tmp_path):
    path = put(tmp_path, "m.xml", '<sbml xmlns:rdf="r" xmlns:bqbiol="b"><model><listOfReactions><reaction metaid="R_1"><annotation><rdf:RDF><rdf:Description><bqbiol:is><rdf:Bag>'
               '<rdf:li rdf:resource="https://identifiers.org/rhea/12#1"/></rdf:Bag></bqbiol:is></rdf:Description></rdf:RDF></annotation><listOfReactants>'
               '<speciesReference species="M_a_c" stoichiometry="2"/></listOfReactants><listOfProducts><speciesReference species="M_b_c" stoichiometry="1"/>'
               "</listOfProducts></reaction></listOfReactions></model></sbml>")
    rows = MD.read_model_rows(spark, path, "reaction")
    assert {(r.side, r.stoich, r.compound_key) for r in MD.model_participant(rows).collect()} == {("left", 2, "M_a_c"), ("right", 1, "M_b_c")}
    assert [(r.id_type, r.id_value) for r in MD.model_reaction_ids(rows).collect()] == [("rhea", "12")]


def test_annotations_and_hierarchy(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    put(tmp_path / "s1", "a.tsv", "h\n1\t2\t3\t4\t5\t6\tenzyme_ec:1.1.1.1\tdescription:a:b\n")
    assert [tuple(r) for r in A.read_annotations(spark, str(tmp_path / "s1")).collect()] == [("s1", "enzyme_ec", "1.1.1.1")]
    j = put(tmp_path, "h.json", '{"name":"r","children":[{"name":"a","children":[{"name":"b","children":[{"name":"c","children":[{"name":"1.1.1.1 x"},{"name":"1.1.1.- y"}]}]}]}]}')
    assert [r.code for r in A.read_hierarchy(spark, j).collect()] == ["1.1.1.1"]


def test_seed_stream_uses_ledger(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.tsv", "1\tkegg\tprotein\tprc\n1\tkegg\tprotein\tprc\n2\tkegg\tprotein\n")
    seen = []
    run = lambda: follow_seeds(spark, str(src), str(tmp_path / "ledger"), str(tmp_path / "ck"), lambda df: seen.extend(r.id for r in df.collect())).awaitTermination()
    run()
    put(src, "b.tsv", "2\tkegg\tprotein\n3\tkegg\tgene\n")
    run()
    assert sorted(seen) == ["1", "2", "3"]


def test_seed_stream_survives_a_failure(spark, tmp_path):
    """A batch that fails after its work or before it comes again; lines of an older ledger and lines met before never do."""
    src, state = tmp_path / "in", {"fail": True}
    src.mkdir()
    old = spark.createDataFrame([("0\tkegg\tgene",)], "line string")
    batches = []

    def process(df):
        batches.append(sorted(r.line for r in df.collect()))
        if state["fail"]:
            raise RuntimeError("lost")

    def run():
        q = follow_seeds(spark, str(src), str(tmp_path / "ledger"), str(tmp_path / "ck"), process, old, 1)
        try:
            q.awaitTermination()
        except Exception:  # noqa: BLE001  the stream's own failure
            assert state["fail"]

    put(src, "a.tsv", "0\tkegg\tgene\n1\tkegg\tgene\n\n1\tkegg\tgene\n")
    run()
    state["fail"] = False
    run()
    put(src, "b.tsv", "1\tkegg\tgene\n2\tkegg\tgene\n")
    put(src, "c.tsv", "0\tkegg\tgene\n2\tkegg\tgene\n3\tkegg\tgene\n")
    run()
    assert batches[0] == batches[1] == ["1\tkegg\tgene"] and sorted(x for b in batches[2:] for x in b) == ["2\tkegg\tgene", "3\tkegg\tgene"]
    assert sorted(r.line for r in read_ledger(spark, str(tmp_path / "ledger")).collect()) == [f"{i}\tkegg\tgene" for i in (1, 2, 3)]
    log_batch(spark.createDataFrame([("3\tkegg\tgene",)], "line string"), str(tmp_path / "ledger"), 2)  # logged again: replaced
    assert read_ledger(spark, str(tmp_path / "ledger")).filter("line like '3%'").count() == 1


def test_annotate_end_to_end(spark, tmp_path):
    x = "entity_type string, entity_key string, source_db string, id_type string, id_value string, n long"
    xref = spark.createDataFrame([
        ("protein", "p1", "kegg", "kegg", "K1", 1), ("protein", "p2", "hmdb", "kegg", "K1", 1), ("reaction", "r1", "kegg", "kegg", "R1", 1),
        ("compound", "c1", "kegg", "kegg", "C1", 1), ("compound", "c2", "kegg", "kegg", "C2", 1), ("gene", "g1", "kegg", "kegg", "G1", 1)], x)
    edge = spark.createDataFrame([("pr", "p2", "r1", "hmdb"), ("rc", "r1", "c1", "kegg"), ("rc", "r1", "c2", "kegg"), ("pg", "p1", "g1", "kegg")],
                                 "edge_type string, src_key string, dst_key string, source_db string")
    part = spark.createDataFrame([("r1", "left", 0, 1, "", "c1"), ("r1", "right", 0, 1, "", "c2")],
                                 "reaction_key string, side string, pos int, stoich int, stoich_raw string, compound_key string")
    reaction = spark.createDataFrame([("r1", "=>")], "reaction_key string, direction string")
    seeds = S.parse_seeds(spark.createDataFrame([("K1\tkegg\tProtein\tprc",)], "value string"))
    got = annotate(seeds, xref, edge, part, reaction)
    assert {tuple(r) for r in got["sif"].collect()} == {("p1", "pr", "r1"), ("c1", "cr", "r1"), ("r1", "rc", "c2")}
    assert "reaction_compounds:c1 => c2" in "\n".join(r.value for r in B.entity_lines(got["kv"]).collect())


def test_labels_in_pieces_and_repeated(spark):
    html = "<table><tr><th>I<sub>n</sub>C<sub>h</sub>I:</th><td>a</td></tr><tr><th><nobr>Name</nobr></th><td>x</td></tr><tr><th>Name</th><td>y</td></tr></table>"
    got = P.extract_boxes(spark.createDataFrame([(1, html)], "page_id long, html string"), ["InChI", "Name"]).collect()
    assert [(r.label, r.pos, r.value) for r in got] == [("InChI", 0, "a"), ("Name", 0, "x"), ("Name", 1, "y")]


def test_a_line_of_over_a_million_fields(spark):
    from pyspark.sql import functions as F

    n = 1_000_005
    line = spark.range(1).select(F.lit("compound").alias("entity_type"), F.concat(F.lit("internal_id:7\t"), F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("k:"), i.cast("string"))), "\t")).alias("value"))
    assert A.parse_entity_lines(line).count() == n


def test_hub_lines_come_in_pieces(spark):
    kv = spark.createDataFrame([("compound", "7", "reactions_connected", f"r{i}") for i in range(500)] + [("compound", "8", "kegg", "C8")], "entity_type string, internal_id string, k string, v string")
    lines = B.entity_lines(kv, per_line=100)
    assert lines.count() > 5 and max(r.value.count("\t") for r in lines.collect()) < 200
    assert sorted(map(tuple, A.parse_entity_lines(lines).collect())) == sorted(map(tuple, kv.collect()))
