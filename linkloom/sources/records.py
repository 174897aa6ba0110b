"""Record files: ``UNIQUE-ID - X`` followed by ``ATTRIBUTE - value`` lines.

One record is one row, so all lines of a record are read with array functions and no shuffle is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.arrays import let, spread
from linkloom.functions.text import squeeze, strip_prefix, strip_tags

MARK = "UNIQUE-ID - "

# Record attributes and the id type they fill.
COMPOUND_ATTRS = {
    "COMMON-NAME": "synonyms",
    "ABBREV-NAME": "synonyms",
    "SYSTEMATIC-NAME": "synonyms",
    "SYNONYMS": "synonyms",
    "CHEMICAL-FORMULA": "chemical_formula",
    "INCHI": "inchi",
    "INCHI-KEY": "inchi_key",
    "SMILES": "smiles",
}
GENE_ATTRS = {
    "ACCESSION-1": "metacyc",
    "ACCESSION-2": "metacyc",
    "COMMON-NAME": "synonyms",
    "SYNONYMS": "synonyms",
    "PRODUCT": "protein_ids",
}
PROTEIN_ATTRS = {
    "ACCESSION-1": "metacyc",
    "COMMON-NAME": "synonyms",
    "ABBREV-NAME": "synonyms",
    "COMPONENT-OF": "complex_ids",
    "COMPONENTS": "subunit_ids",
    "GENE": "gene_ids",
    "CATALYZES": "intermediate_reaction_ids",
    "TYPES": "protein_class",
}
REACTION_ATTRS = {
    "TYPES": "reaction_class",
    "EC-NUMBER": "enzyme_ec",
    "ENZYMATIC-REACTION": "intermediate_reaction_ids",
}
# Names of linked databases and the id type they fill.
COMPOUND_DBS = {
    "LIGAND-CPD": "kegg",
    "KEGG-GLYCAN": "kegg",
    "SEED": "seed",
    "BRENDA-COMPOUND": "brenda",
    "ECOCYC": "metacyc",
    "BIGG": "bigg",
    "PUBCHEM": "pubchem_cid",
    "PUBCHEM-SID": "pubchem_sid",
    "HMDB": "hmdb",
    "CHEMSPIDER": "chemspider",
    "CHEBI": "chebi",
    "REACTOME-CPD": "reactome",
    "METANETX": "metanetx",
    "DRUGBANK": "drugbank",
    "CAS": "cas",
    "METABOLIGHTS": "metabolights",
    "REFMET": "synonyms",
    "KNAPSACK": "knapsack",
    "LIPID_MAPS": "lipid_maps",
}
GENE_DBS = {
    "REGULONDB": "regulondb",
    "STRING": "string",
    "NCBI-GENE": "ncbi_genbank_gene",
    "REFSEQ": "refseq",
    "KEGG": "kegg",
    "UNIPROT": "uniprot",
    "INTERPRO": "interpro",
    "GENECARDS": "genecard",
    "ENSEMBL": "ensembl",
    "ENTREZ": "entrez",
}
PROTEIN_DBS = {
    "METANETX": "metanetx",
    "PANTHER": "panther",
    "ECOCYC": "metacyc",
    "BIOCYC": "metacyc",
    "TRANSPORTER_CLASSIFICATION_DATABASE": "tcdb",
    "INTERPRO": "interpro",
    "CAZY": "cazy",
    "REFSEQ": "refseq",
    "SEED": "seed",
    "STRING": "string",
    "PROSITE": "prosite",
    "PFAM": "pfam",
    "UNIPROT": "uniprot",
}
REACTION_DBS = {"METANETX-RXN": "metanetx", "LIGAND-RXN": "kegg", "RHEA": "rhea"}
FORMATS = {
    "compound": (COMPOUND_ATTRS, COMPOUND_DBS),
    "gene": (GENE_ATTRS, GENE_DBS),
    "protein": (PROTEIN_ATTRS, PROTEIN_DBS),
    "reaction": (REACTION_ATTRS, REACTION_DBS),
}


def read_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """One row ``(record)`` per record, decoded and without its mark.

    A record begins where a line begins with the mark; the mark inside a line, as in a comment, is text. The scan cuts at
    the attribute's name only, so a record shows the rest of its mark and what stands before a file's first record, with
    or without ``#``, does not: it is dropped. Files are split at any byte, and no record is read twice or cut.
    """
    name, rest = MARK[: MARK.index(" ")], MARK[MARK.index(" "):]
    raw = spark.read.option("lineSep", "\n" + name).text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("x"))
    record = F.when(F.col("x").startswith(rest), F.substr("x", F.lit(len(rest) + 1))).when(
        F.col("x").startswith(MARK), F.substr("x", F.lit(len(MARK) + 1)))  # the latter where a file begins with a record
    return raw.select(record.alias("record")).filter(F.col("record").isNotNull() & (squeeze("record") != ""))


def _mapping(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


_BLANKS = " \t\n\x0b\f\r"
_ENDS = ("\x85", "\u2028", "\u2029")  # further ends of a line to ``$``: a text that holds one is trimmed by patterns


def _lines(records: DataFrame) -> DataFrame:
    """``(entity_key, lines array<struct<attr, text>>)`` per record; a record is split once, and plain lines are trimmed without patterns."""
    odd = reduce(lambda a, b: a | b, [F.contains("record", F.lit(x)) for x in _ENDS])

    def value(x: Column, attr: Column, odd: Column) -> Column:
        by_pattern = squeeze(F.regexp_replace(squeeze(F.regexp_replace(x, r"^\S+", "")), r"^-+|-+$", ""))
        rest = F.substring(x, F.length(attr) + 1, F.length(x))
        plain = F.trim(F.trim(F.trim(rest, F.lit(_BLANKS)), F.lit("-")), F.lit(_BLANKS))
        return strip_tags(F.when(odd, by_pattern).otherwise(plain))

    def read(r: Column) -> Column:
        raw, odd = r["raw"], r["odd"]
        body = F.filter(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), lambda x: x.rlike(r"^[\^A-Z][A-Z0-9-]*( |$)"))
        named = F.transform(body, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("attr"), x.alias("line")))
        return F.struct(
            strip_tags(squeeze(F.element_at(raw, 1))).alias("entity_key"),
            F.transform(named, lambda x: F.struct(x["attr"].alias("attr"), value(x["line"], x["attr"], odd).alias("text"))).alias("lines"))

    whole = let(F.struct(F.split("record", "\r?\n").alias("raw"), odd.alias("odd")), read)
    return records.select(whole.alias("r")).select("r.entity_key", "r.lines")


def records_to_xref(records: DataFrame, entity_type: str, source_db: str = "metacyc") -> DataFrame:
    """Xref rows of record files of one entity type."""
    attrs, dbs = FORMATS[entity_type]
    rows = _lines(records)
    token = lambda text, i: F.coalesce(F.try_element_at(F.split(text, r"\s+"), F.lit(i)), F.lit(""))
    unwrap = lambda v: F.regexp_replace(F.regexp_replace(v, r"^[()\s]+|[()\s]+$", ""), r'^"+|"+$', "")

    def one(x: Column) -> Column:
        plain = F.try_element_at(_mapping(attrs), x["attr"])
        linked = F.try_element_at(_mapping(dbs), F.regexp_replace(token(x["text"], 1), r"^\(", ""))
        is_link = x["attr"] == "DBLINKS"
        return F.struct(
            F.when(is_link, linked).otherwise(plain).alias("id_type"),
            F.when(is_link, unwrap(token(x["text"], 2)))
            .when(x["attr"].isin("INCHI", "INCHI-KEY"), strip_prefix(x["text"]))
            .when(x["attr"] == "EC-NUMBER", F.replace(x["text"], F.lit("EC-"), F.lit("")))
            .otherwise(x["text"]).alias("id_value"),
        )

    found = F.filter(F.transform("lines", one), lambda y: y["id_type"].isNotNull() & (y["id_type"] != "chemical_formula"))
    atoms = F.transform(F.filter("lines", lambda x: x["attr"] == "CHEMICAL-FORMULA"), lambda x: F.translate(x["text"], "() ", ""))
    formula = F.struct(F.lit("chemical_formula").alias("id_type"), F.array_join(atoms, "").alias("id_value"))
    own = F.struct(F.lit(source_db).alias("id_type"), F.col("entity_key").alias("id_value"))
    return (
        spread(rows, F.array_distinct(F.concat(F.array(own, formula), found)), "x", "entity_key")
        .filter(F.col("x.id_value").isNotNull() & (F.col("x.id_value") != ""))
        .select(F.lit(entity_type).alias("entity_type"), "entity_key", F.lit(source_db).alias("source_db"),
                "x.id_type", "x.id_value", F.lit(1).cast("bigint").alias("n"))
    )


def records_to_reactions(records: DataFrame) -> DataFrame:
    """``(reaction_key, equation, direction, reversible, parts)`` of reaction records.

    A ``^COEFFICIENT`` line sets the stoichiometry of the participant right before it.
    """
    # records without participants are left out on their text: a filter on ``parts`` would be pushed down and
    # compute the parts twice
    rows = _lines(records.filter(F.col("record").rlike(r"(?m)^(LEFT|RIGHT)( |$)")))
    way = F.element_at(F.concat(F.array(F.lit("")), F.transform(
        F.filter("lines", lambda x: x["attr"] == "REACTION-DIRECTION"), lambda x: x["text"])), -1)
    sign = let(way, lambda w: F.when(F.contains(w, F.lit("RIGHT-TO-LEFT")), "<=").when(F.contains(w, F.lit("LEFT-TO-RIGHT")), "=>").otherwise("<=>"))

    def read_parts(kept: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            after = F.try_element_at(kept, i + 2)
            raw = F.coalesce(F.when(after["attr"] == "^COEFFICIENT", after["text"]), F.lit(""))
            return F.struct(
                F.when(x["attr"] == "LEFT", "left").when(x["attr"] == "RIGHT", "right").alias("side"),
                F.when(raw == "", F.lit(1)).otherwise(F.coalesce(raw.try_cast("int"), F.lit(-1))).alias("stoich"),
                raw.alias("stoich_raw"), x["text"].alias("name"),
            )

        return F.filter(F.transform(kept, part), lambda p: p["side"].isNotNull())

    def side(parts: Column, which: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p["side"] == which), lambda p, i: F.struct(
            p["side"].alias("side"), i.alias("pos"), p["stoich"].alias("stoich"), p["stoich_raw"].alias("stoich_raw"), p["name"].alias("name")))

    def text(parts: Column, which: str) -> Column:
        return F.array_join(F.transform(F.filter(parts, lambda p: p["side"] == which), lambda p: F.concat_ws(
            " ", F.coalesce(F.when(p["stoich_raw"] != "", p["stoich_raw"]), F.lit("1")), p["name"])), " + ")

    def whole(x: Column) -> Column:
        parts, arrow = x["parts"], x["arrow"]
        return F.struct(
            F.concat(text(parts, "left"), F.lit(" "), arrow, F.lit(" "), text(parts, "right")).alias("equation"),
            arrow.alias("direction"), (arrow == "<=>").alias("reversible"),
            F.concat(side(parts, "left"), side(parts, "right")).alias("parts"))

    kept = F.filter("lines", lambda x: x["attr"].isin("LEFT", "RIGHT", "^COEFFICIENT"))
    body = let(F.struct(let(kept, read_parts).alias("parts"), sign.alias("arrow")), whole)
    return rows.select(F.col("entity_key").alias("reaction_key"), body.alias("r")).select("reaction_key", "r.*")


def reactions_to_participant(reactions: DataFrame) -> DataFrame:
    """``parts`` as participant rows; the name of the part is taken as the compound key."""
    return spread(reactions, "parts", "p", "reaction_key").select(
        "reaction_key", "p.side", "p.pos", "p.stoich", "p.stoich_raw", F.col("p.name").alias("compound_key"))


def read_reactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reaction record file as ``(xref, participant, reaction)``."""
    rec = read_records(spark, path)
    reactions = records_to_reactions(rec)
    return records_to_xref(rec, "reaction"), reactions_to_participant(reactions), reactions.drop("parts")
