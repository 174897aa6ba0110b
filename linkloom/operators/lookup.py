"""Set-at-a-time lookups: every seed at once, by joins on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.arrays import let, spread
from linkloom.functions.equations import equation_ids
from linkloom.functions.text import find_ecs
from linkloom.operators.samples import pairs_sharing
from linkloom.operators.xref import index_by
from linkloom.session import cut

GRAM = 8  # gram size of the sampled name index
SAMPLE = 16  # one gram in SAMPLE is indexed
RUN, RUN_SAMPLE = 3, 4  # words in a run, and one run in RUN_SAMPLE is indexed


def lookup(seeds: DataFrame, xref: DataFrame, misses: bool = False) -> DataFrame:
    """All details of the entities that hold a seed id ``(id_type, id_value)``.

    With ``misses`` unknown seeds stay as rows without an entity.
    """
    s = seeds.select(F.col("id_type").alias("seed_type"), F.col("id_value").alias("seed_value")).distinct()
    holder = xref.select(
        F.col("id_type").alias("seed_type"), F.col("id_value").alias("seed_value"), "entity_type", "entity_key"
    ).distinct()
    hit = s.join(holder, ["seed_type", "seed_value"], "left" if misses else "inner")
    return hit.join(
        xref.select("entity_type", "entity_key", "source_db", "id_type", "id_value", "n"),
        ["entity_type", "entity_key"], "left" if misses else "inner",
    ).select("seed_type", "seed_value", "entity_type", "entity_key", "source_db", "id_type", "id_value", "n")


def index_compound_reaction(participant: DataFrame) -> DataFrame:
    """Compound to its sorted distinct reactions."""
    return index_by(participant, "compound_key", "reaction_key")


def index_ec_reaction(xref: DataFrame) -> DataFrame:
    """Enzyme number to reactions."""
    rows = xref.filter((F.col("entity_type") == "reaction") & (F.col("id_type") == "enzyme_ec"))
    return index_by(rows.select(F.col("id_value").alias("enzyme_ec"), F.col("entity_key").alias("reaction_key")),
                    "enzyme_ec", "reaction_key")


def index_uniprot_protein(xref: DataFrame) -> DataFrame:
    """UniProt id to proteins."""
    rows = xref.filter((F.col("entity_type") == "protein") & (F.col("id_type") == "uniprot"))
    return index_by(rows.select(F.col("id_value").alias("uniprot"), F.col("entity_key").alias("protein_key")),
                    "uniprot", "protein_key")


def bridge(protein_ids: DataFrame, reaction_ids: DataFrame) -> DataFrame:
    """Proteins and reactions that meet on an intermediate id; a missing side stays null.

    Inputs: ``(bridge_id, protein_key)`` and ``(bridge_id, reaction_key)``.
    """
    return index_by(protein_ids, "bridge_id", "protein_key").join(
        index_by(reaction_ids, "bridge_id", "reaction_key"), "bridge_id", "full"
    )


def resolve_alt(ids: DataFrame, alt: DataFrame) -> DataFrame:
    """``(id)`` to ``(id, master_id)``: the master of an alternate id, else the id itself."""
    one = alt.groupBy(F.col("alt_id").alias("id")).agg(F.min("master_id").alias("m"))
    return ids.join(one, "id", "left").withColumn("master_id", F.coalesce("m", "id")).drop("m")


def reactions_by_id(ids: DataFrame, xref: DataFrame) -> DataFrame:
    """``(id_type, id_value)`` to the reactions that hold the id."""
    r = xref.filter(F.col("entity_type") == "reaction").select("id_type", "id_value", F.col("entity_key").alias("reaction_key"))
    return ids.select("id_type", "id_value").distinct().join(r, ["id_type", "id_value"]).distinct()


def reactions_by_participant(ids: DataFrame, reactions: DataFrame) -> DataFrame:
    """Whole compound numbers ``(id)`` to the reactions whose id equation holds them."""
    inside = spread(reactions, equation_ids("equation"), "id", "reaction_key").distinct()
    return ids.select("id").distinct().join(inside, "id")


def chebi_xref(ids: DataFrame, chebi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross-references of ontology ids, through the main id when the given one is secondary.

    ``chebi(chebi, id_type, id_value)`` holds secondary ids as ``id_type = 'chebi'``. Returns
    ``(asked, chebi, id_type, id_value)`` and the secondary ids that have more than one main id. Unknown ids
    stay with null cross-references.
    """
    asked = ids.select(F.col("id").alias("asked")).distinct()
    known = chebi.select(F.col("chebi").alias("asked")).distinct()
    direct = asked.join(known, "asked", "left_semi").withColumn("chebi", F.col("asked"))
    rest = asked.join(known, "asked", "left_anti")
    mains = (
        chebi.filter(F.col("id_type") == "chebi").groupBy(F.col("id_value").alias("asked"))
        .agg(F.min("chebi").alias("lo"), F.max("chebi").alias("hi"))
    )
    second = rest.join(mains, "asked", "left")
    ambiguous = second.filter(F.col("lo") != F.col("hi")).select("asked")
    via = second.filter(F.col("lo").eqNullSafe(F.col("hi"))).select("asked", F.col("lo").alias("chebi"))
    return direct.unionByName(via).join(chebi, "chebi", "left").select("asked", "chebi", "id_type", "id_value"), ambiguous


def enrich_chebi(xref: DataFrame, chebi: DataFrame) -> DataFrame:
    """Add, for every ontology id of a compound, its mappings and its main id."""
    have = xref.filter((F.col("entity_type") == "compound") & (F.col("id_type") == "chebi"))
    found, _ = chebi_xref(have.select(F.col("id_value").alias("id")), chebi)
    hit = have.select("entity_type", "entity_key", F.col("id_value").alias("asked")).distinct().join(
        found.filter(F.col("chebi").isNotNull()), "asked"
    )
    mapped = hit.filter(F.col("id_type").isNotNull()).select("entity_type", "entity_key", "id_type", "id_value")
    mains = hit.select("entity_type", "entity_key", F.lit("chebi").alias("id_type"), F.col("chebi").alias("id_value"))
    added = mapped.unionByName(mains).distinct().select(
        "entity_type", "entity_key", F.lit("chebi").alias("source_db"), "id_type", "id_value",
        F.lit(1).cast("bigint").alias("n"),
    )
    return (
        xref.select(*added.columns).unionByName(added)
        .groupBy("entity_type", "entity_key", "source_db", "id_type", "id_value")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def _grams(text: Column, n: int) -> Column:
    """Grams of a text, read in one pass."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _sampled(text: Column) -> Column:
    return F.array_distinct(F.filter(_grams(text, GRAM), lambda g: F.pmod(F.xxhash64(g), F.lit(SAMPLE)) == 0))


def _word_runs(text: Column, inner: bool) -> Column:
    """Hashes of the sampled runs of words between blanks; ``inner`` leaves out the first and the last word.

    The inner words of a query are whole words of whatever contains it.
    """
    def runs(w: Column) -> Column:
        edge = 1 if inner else 0
        starts = F.sequence(F.lit(edge), F.size(w) - RUN - edge)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(RUN)]))
        return F.when(F.size(w) >= RUN + 2 * edge, F.array_distinct(F.filter(hashes, lambda h: F.pmod(h, F.lit(RUN_SAMPLE)) == 0)))

    return F.coalesce(let(F.split(text, " "), runs), F.array().cast("array<bigint>"))


def _meet_rarest(queries: DataFrame, names: DataFrame, in_query: Column, in_name: Column) -> DataFrame:
    """``(qid, entity_key)`` of names that hold the query's rarest gram; ``queries(qid, query)``.

    Only grams that some query holds are kept of the names, in one pass over the texts; how many names hold a gram is
    counted on that table.
    """
    asked = cut(spread(queries, in_query, "gram", "qid"))
    held = cut(spread(names, in_name, "gram", "entity_key").join(asked.select("gram").distinct(), "gram", "left_semi"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no name holds is the rarest of all: its queries are found nowhere
    best = asked.join(often, "gram", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b"))
    return best.filter("b.n > 0").select("qid", F.col("b.gram").alias("gram")).join(held, "gram").select("qid", "entity_key")


def contains_search(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs where ``name`` contains ``query`` (both lower case columns), as ``(query, entity_key)``.

    A name that contains a query contains each gram of it, so a query is looked up by the one that fewest names hold: by runs
    of words where it has them, else by grams of letters. Runs and long grams are sampled by their hash, so only a fraction
    of a text is indexed; queries that own no sampled gram use grams of three letters. The index holds keys, not texts, and the exact test runs on the pairs that meet. A query of one to
    three letters is itself a gram, so holding it is the whole test. Empty and null queries and null names are in no pair.
    """
    # a query goes by a digest, so that its text is not carried along
    q = queries.select("query").filter(F.col("query") != "").distinct().select(F.sha2("query", 256).alias("qid"), "query")
    size = F.length("query")
    col = F.col("query")
    kind = F.when(size <= 3, size.cast("string")).when(F.size(_word_runs(col, True)) > 0, "runs").when(F.size(_sampled(col)) > 0, "grams").otherwise("short grams")
    short = ("1", "2", "3")
    indexes = {"runs": lambda c, inner: _word_runs(c, inner), "grams": lambda c, _: _sampled(c), "short grams": lambda c, _: F.array_distinct(_grams(c, 3))}
    q = cut(q.withColumn("kind", kind), {k: F.count_if(F.col("kind") == k) for k in (*short, *indexes)})
    text = names.select("entity_key", "name").filter(F.col("name").isNotNull())
    of = lambda k: q.filter(F.col("kind") == k).select("qid", "query")
    whole, met = q.select("query").limit(0).withColumn("entity_key", F.lit("")), None
    for k in short:
        if q.observed[k]:
            index = spread(text, F.array_distinct(_grams(F.col("name"), int(k))), "query", "entity_key")
            whole = whole.unionByName(index.join(of(k).select("query"), "query").select("query", "entity_key"))
    for k, grams in indexes.items():
        if q.observed[k]:
            one = _meet_rarest(of(k), text, grams(col, True), grams(F.col("name"), False))
            met = one if met is None else met.unionByName(one)
    if met is not None:
        # the same key may have several names
        pairs = cut(met.distinct())
        asked = pairs.join(q.select("qid", "query"), "qid").select("query", "entity_key")
        # names that no query meets stay where they are; beyond Spark's broadcast threshold both joins share one shuffle
        text = text.join(pairs.select("entity_key").distinct(), "entity_key", "left_semi")
        whole = whole.unionByName(asked.join(text, "entity_key").filter(F.contains(F.col("name"), F.col("query"))).select("query", "entity_key"))
    return whole.distinct()


def name_search(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``(query, entity_key, how)``: the smallest entity with exactly that name, otherwise all that contain it.

    Whole names are compared by SHA-256, so names do not travel to their queries.
    """
    lower = F.lower("query")
    n = names.select("entity_key", F.lower("name").alias("name"))
    first = n.groupBy(F.sha2("name", 256).alias("h")).agg(F.min("entity_key").alias("entity_key"))
    q = queries.select("query").distinct().withColumn("h", F.sha2(lower, 256))
    q = cut(q.join(first, "h", "left").select("query", "entity_key"))
    rest = q.filter(F.col("entity_key").isNull()).select("query", lower.alias("lq"))
    part = contains_search(rest.select(F.col("lq").alias("query")), n).withColumnRenamed("query", "lq")
    return q.filter(F.col("entity_key").isNotNull()).select("query", "entity_key", F.lit("exact").alias("how")).unionByName(
        rest.join(part, "lq").select("query", "entity_key", F.lit("contains").alias("how"))
    )


def uniprot_fanout(seeds: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """``(uniprot)`` to the ids of each linked source; ``links`` maps a source to ``(uniprot, id_value)``."""
    tables = None
    for db, df in links.items():
        one = df.select("uniprot", F.lit(db).alias("id_type"), "id_value")
        tables = one if tables is None else tables.unionByName(one)
    return seeds.select("uniprot").distinct().join(tables, "uniprot").distinct()


def ko_to_ec(ko: DataFrame) -> DataFrame:
    """Orthology descriptions ``(ko, description)`` to the enzyme numbers listed as ``[EC:a b c]``."""
    listed = F.regexp_extract("description", r"\[EC:([^\]]*)\]", 1)
    return ko.filter(listed != "").select("ko", F.explode(F.split(listed, r"\s+")).alias("enzyme_ec")).filter(
        F.col("enzyme_ec") != ""
    ).distinct()


def uniprot_to_ec(seeds: DataFrame, gene_of: DataFrame, ec_of: DataFrame, ko_of: DataFrame, ko_ec: DataFrame) -> DataFrame:
    """``(uniprot)`` to enzyme numbers through its genes, or through orthology groups where genes give none.

    ``gene_of(uniprot, gene)``, ``ec_of(gene, enzyme_ec)``, ``ko_of(gene, ko)``, ``ko_ec(ko, enzyme_ec)``.
    """
    genes = seeds.select("uniprot").distinct().join(gene_of, "uniprot")
    direct = genes.join(ec_of, "gene").select("uniprot", "enzyme_ec").distinct()
    rest = genes.join(direct.select("uniprot").distinct(), "uniprot", "left_anti")
    via = rest.join(ko_of, "gene").join(ko_ec, "ko").select("uniprot", "enzyme_ec").distinct()
    return direct.withColumn("via", F.lit("gene")).unionByName(via.withColumn("via", F.lit("ko")))


def ec_to_protein(ecs: DataFrame, ec_reaction: DataFrame, reaction_bridge: DataFrame, protein_bridge: DataFrame,
                  links: DataFrame) -> DataFrame:
    """Enzyme numbers to proteins via reactions and bridge ids, with their role.

    ``links(protein_key, kind, other_key)`` holds ``complex_ids`` and ``subunit_ids``; a protein that is part of a
    complex is a ``subunit``, one that has subunits a ``complex``, any other ``plain``.
    """
    role = links.groupBy("protein_key").agg(
        F.bool_or(F.col("kind") == "complex_ids").alias("part"), F.bool_or(F.col("kind") == "subunit_ids").alias("whole")
    )
    hit = (
        ecs.select("enzyme_ec").distinct().join(ec_reaction, "enzyme_ec").join(reaction_bridge, "reaction_key")
        .join(protein_bridge, "bridge_id").select("enzyme_ec", "protein_key").distinct()
    )
    return hit.join(role, "protein_key", "left").select(
        "enzyme_ec", "protein_key",
        F.when(F.col("part"), "subunit").when(F.col("whole"), "complex").otherwise("plain").alias("role"),
    )


def protein_links(proteins: DataFrame, xref: DataFrame, bridge_index: DataFrame, reaction_xref: DataFrame) -> DataFrame:
    """Links of proteins that are not enzyme numbers: complexes, subunits, genes, reactions and the reactions' ECs.

    ``bridge_index(bridge_id, reaction_key)``; the result is ``(protein_key, link, target)``.
    """
    kinds = {"complex_ids": "in_complex", "subunit_ids": "has_subunits", "gene_ids": "gene"}
    own = xref.filter(F.col("entity_type") == "protein").join(
        proteins.select(F.col("protein_key").alias("entity_key")).distinct(), "entity_key", "left_semi"
    )
    name = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("id_type"))
    direct = own.filter(F.col("id_type").isin(list(kinds))).select(
        F.col("entity_key").alias("protein_key"), name.alias("link"), F.col("id_value").alias("target")
    )
    bridges = own.filter(F.col("id_type") == "intermediate_reaction_ids").select(F.col("entity_key").alias("left"), F.col("id_value").alias("bridge_id"))
    # proteins and reactions with the same bridge ids meet as sets: only the result has a row for each of their pairs
    pairs = pairs_sharing(bridges, bridge_index.select(F.col("reaction_key").alias("right"), "bridge_id"), ["bridge_id"])
    ec = reaction_xref.filter(F.col("id_type") == "enzyme_ec").select(F.col("entity_key").alias("right"), F.col("id_value").alias("target"))
    of_set = pairs.rights.join(ec, "right").select("rset", "target").distinct().join(pairs.sets, "rset").select("lset", "target").distinct()
    ecs = pairs.lefts.join(of_set, "lset").select("left", "target").unionByName(pairs.few.join(ec, "right").select("left", "target")).distinct()
    link = lambda df, name, target: df.select(F.col("left").alias("protein_key"), F.lit(name).alias("link"), F.col(target).alias("target"))
    return direct.distinct().unionByName(link(pairs.rows("left", "right"), "reaction", "right")).unionByName(link(ecs, "enzyme_ec", "target"))


def reactions_mentioning(links: DataFrame, reactions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Keep the links ``(compound_key, reaction_key)`` whose reaction text holds a name of the compound."""
    names = synonyms.select("compound_key", "name").filter(F.col("name") != "").distinct()
    text = reactions.select("reaction_key", "equation")
    return (
        links.select("compound_key", "reaction_key").distinct().join(text, "reaction_key").join(names, "compound_key")
        .filter(F.contains(F.col("equation"), F.col("name"))).select("compound_key", "reaction_key").distinct()
    )


def filter_organisms(edge: DataFrame, codes: DataFrame, column: str = "dst_key") -> DataFrame:
    """Keep links whose gene id carries one of the organism codes, as in ``org:gene``."""
    org = codes.select(F.lower("organism").alias("o")).distinct()
    return edge.join(org, F.lower(F.substring_index(column, ":", 1)) == F.col("o"), "left_semi")


def flag_ubiquitous(xref: DataFrame, stoplist: DataFrame) -> DataFrame:
    """Entities that hold an id of the stop list ``(id_type, id_value)``; ids compare trimmed and without case."""
    stop = stoplist.select("id_type", F.lower(F.trim("id_value")).alias("v")).distinct()
    hit = xref.select("entity_key", "id_type", F.lower(F.trim("id_value")).alias("v")).join(
        stop, ["id_type", "v"], "left_semi"
    )
    return hit.select("entity_key").distinct()


def unseen(frontier: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    """Frontier rows not seen before; an empty id counts as seen."""
    filled = frontier
    for k in keys:
        filled = filled.filter(F.col(k).isNotNull() & (F.col(k) != ""))
    return filled.join(visited.select(*keys), keys, "left_anti")


def assemble(seeds: DataFrame, xref: DataFrame, edge: DataFrame, participant: DataFrame | None = None) -> DataFrame:
    """Everything a source stores on the seed entities ``(entity_type, entity_key)``, as ``(entity, part, k, v)`` rows."""
    s = seeds.select("entity_type", "entity_key").distinct()
    ids = xref.join(s, ["entity_type", "entity_key"], "left_semi").select(
        "entity_type", "entity_key", F.lit("id").alias("part"), F.col("id_type").alias("k"), F.col("id_value").alias("v")
    )
    out = edge.select(F.col("src_key").alias("entity_key"), "edge_type", "dst_key").join(s, "entity_key").select(
        "entity_type", "entity_key", F.lit("link").alias("part"), F.col("edge_type").alias("k"), F.col("dst_key").alias("v")
    )
    rows = ids.unionByName(out)
    if participant is not None:
        p = participant.select(F.col("reaction_key").alias("entity_key"), "side", "pos", "stoich", "compound_key").join(
            s.filter(F.col("entity_type") == "reaction"), "entity_key"
        )
        rows = rows.unionByName(p.select(
            "entity_type", "entity_key", F.lit("participant").alias("part"), F.col("side").alias("k"),
            F.concat_ws(" ", F.col("stoich").cast("string"), "compound_key").alias("v"),
        ))
    return rows.distinct()


def reaction_master(equations: DataFrame, directions: DataFrame, xrefs: DataFrame, uniprot: DataFrame) -> DataFrame:
    """Master reactions: equations that have a direction row, with their external ids and UniProt ids.

    ``xrefs(master_id, id_type, id_value)`` and ``uniprot(master_id, id_value)``.
    """
    of = lambda t: F.array_sort(F.collect_set(F.when(F.col("id_type") == t, F.col("id_value")))).alias(t)
    ext = xrefs.groupBy("master_id").agg(of("metacyc"), of("kegg"), of("enzyme_ec"))
    up = uniprot.groupBy("master_id").agg(F.array_sort(F.collect_set("id_value")).alias("uniprot"))
    alt = directions.groupBy("master_id").agg(F.array_sort(F.collect_set("alt_id")).alias("alt_ids"))
    return equations.withColumnRenamed("reaction_key", "master_id").join(alt, "master_id").join(ext, "master_id", "left").join(
        up, "master_id", "left"
    )


def explode_accessions(records: DataFrame, column: str = "accessions") -> DataFrame:
    """One row per accession: a record with several ids is repeated under each."""
    return records.withColumn("accession", F.explode(column)).drop(column)


def text_ecs(df: DataFrame, key: str, text: str, level: int = 3) -> DataFrame:
    """Enzyme numbers named in free text, one row each."""
    return spread(df, find_ecs(text, level), "enzyme_ec", key)
