"""Samples (organisms) against the network: annotations, listed metabolites, and who reaches what."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut, plain_unions

ANNOTATION_TYPES = ("enzyme_ec", "metacyc")
FEW = 8  # an id that no more than so many keys of one side hold gives its pairs one by one
PIECE = 1000  # keys of a set that are expanded together, about


def unseen_annotations(annotations: DataFrame, model_ids: DataFrame, per_model: bool = True) -> DataFrame:
    """Annotation ids ``(sample, id_type, id_value)`` that the sample's model ``(sample, …)`` does not have."""
    keys = ["sample", "id_type", "id_value"] if per_model else ["id_type", "id_value"]
    return annotations.select("sample", "id_type", "id_value").distinct().join(model_ids.select(*keys).distinct(), keys, "left_anti")


def unseen_counts(unseen: DataFrame) -> DataFrame:
    return unseen.groupBy("sample", "id_type").agg(F.count("*").alias("n"))


def annotation_sharing(annotations: DataFrame) -> DataFrame:
    """One row: annotations found in one sample only, and in several."""
    per = annotations.select("sample", "id_value").distinct().groupBy("id_value").agg(F.count("*").alias("samples"))
    return per.agg(F.count_if(F.col("samples") == 1).alias("n_unique"), F.count_if(F.col("samples") > 1).alias("n_shared"))


def map_metabolites(metabolites: DataFrame, xref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed metabolites ``(id, id_type)`` to compounds by ontology id or name; and the unmapped ones."""
    c = xref.filter((F.col("entity_type") == "compound") & F.col("id_type").isin("chebi", "synonyms")).select(
        F.col("entity_key").alias("compound_key"), F.lower("id_value").alias("v")
    ).distinct()
    m = metabolites.select(F.col("id").alias("metabolite"), F.lower("id").alias("v")).distinct()
    hit = m.join(c, "v").select("metabolite", "compound_key").distinct()
    return hit, m.select("metabolite").distinct().join(hit.select("metabolite"), "metabolite", "left_anti")


def reactions_with(mapped: DataFrame, participant: DataFrame) -> DataFrame:
    """``(reaction_key, compound_key)``: reactions that hold a mapped compound."""
    return participant.select("reaction_key", "compound_key").distinct().join(mapped.select("compound_key").distinct(), "compound_key", "left_semi")


def proteins_of(linked: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reaction_key, protein_key)`` of linked reactions, and linked reactions without a protein."""
    rp = edge.filter(F.col("edge_type") == "rp").select(F.col("src_key").alias("reaction_key"), F.col("dst_key").alias("protein_key")).unionByName(
        edge.filter(F.col("edge_type") == "pr").select(F.col("dst_key").alias("reaction_key"), F.col("src_key").alias("protein_key"))).distinct()
    r = linked.select("reaction_key").distinct()
    return rp.join(r, "reaction_key", "left_semi"), r.join(rp, "reaction_key", "left_anti")


def annotations_of(proteins: DataFrame, protein_ids: DataFrame) -> DataFrame:
    """``(protein_key, id_type, id_value)``: annotation ids of the proteins."""
    ids = protein_ids.filter(F.col("id_type").isin(list(ANNOTATION_TYPES)))
    return ids.join(proteins.select("protein_key").distinct(), "protein_key", "left_semi").select("protein_key", "id_type", "id_value").distinct()


def _fold(rows: DataFrame, key: str, cols: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``(key, name)`` and ``(name, *cols)``: keys with the same distinct ``cols`` share one set, which is listed once.

    A set is known by two 64-bit hashes of its members and their number. Rows with a null in ``cols`` belong to no set.
    """
    own = rows.select(key, *cols).dropna(subset=cols).distinct()
    named = cut(own.groupBy(key).agg(F.struct(
        F.bit_xor(F.xxhash64(*cols)).alias("a"), F.bit_xor(F.xxhash64(F.lit("second"), *cols)).alias("b"), F.count("*").alias("n")).alias(name)))
    return named, own.join(named.groupBy(name).agg(F.min(key).alias(key)), key).select(name, *cols)


def _matching_sets(protein_annotations: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sample, sset)``, ``(protein_key, pset)`` and the pairs ``(sset, pset)`` that share an annotation."""
    ids = ["id_type", "id_value"]
    samples, of_sample = _fold(annotations, "sample", ids, "sset")
    proteins, of_protein = _fold(protein_annotations, "protein_key", ids, "pset")
    return samples, proteins, of_sample.join(of_protein, ids).select("sset", "pset").distinct()


@dataclass(frozen=True)
class Pairs:
    """Distinct pairs of a ``left`` and a ``right`` key, not expanded.

    ``lefts (left, lset)`` and ``rights (right, rset)`` say which set a key belongs to, ``sets (lset, rset)`` which sets
    meet: all their keys do. ``few (left, right)`` lists the pairs beside those. No pair is in two places.
    """

    lefts: DataFrame
    rights: DataFrame
    sets: DataFrame
    few: DataFrame

    def keep_right(self, keys: DataFrame, how: str) -> "Pairs":
        """Pairs whose right key is (``left_semi``) or is not (``left_anti``) in ``keys (right)``."""
        return replace(self, rights=self.rights.join(keys, "right", how), few=self.few.join(keys, "right", how))

    def right_keys(self) -> DataFrame:
        """``(right)``: right keys that have a pair."""
        met = self.sets.join(self.lefts.select("lset").distinct(), "lset", "left_semi").select("rset").distinct()
        return self.rights.join(met, "rset", "left_semi").select("right").unionByName(self.few.select("right")).distinct()

    def count(self) -> DataFrame:
        """One row ``n``: how many pairs there are; none is expanded."""
        size = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
        met = self.sets.join(size(self.lefts, "lset", "a"), "lset").join(size(self.rights, "rset", "b"), "rset").select((F.col("a") * F.col("b")).alias("n"))
        return met.unionByName(self.few.agg(F.count("*").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))

    def rows(self, left: str, right: str) -> DataFrame:
        """All pairs ``(left, right)``, spread over all tasks.

        Sets are cut into pieces and pieces meet, so what is moved is a small part of the result, whatever a set's size.
        Generated code holds all rows that come of one row of its input; the function around the left keys is not generated,
        so these come one by one, and about ``PIECE`` rows are held instead of its square.
        """
        met = _pieces(self.lefts, "lset", "left").join(self.sets, "lset").join(_pieces(self.rights, "rset", "right"), "rset").select("left", "right")
        dealt = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        every = dealt.select(F.explode(F.transform("left", lambda x: x)).alias("left"), "right").select("left", F.explode("right").alias("right"))
        return every.unionByName(self.few).select(F.col("left").alias(left), F.col("right").alias(right))


def _pieces(keys: DataFrame, name: str, key: str) -> DataFrame:
    """``(name, key)``: the keys of each set, a null one too, in arrays of about ``PIECE``."""
    sizes = keys.groupBy(name).agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    piece = F.pmod(F.xxhash64(key), F.col("pieces")).alias("piece")
    listed = keys.join(sizes, name).groupBy(name, piece).agg(F.collect_list(F.struct(key)).alias("keys"))
    return listed.select(name, F.transform("keys", lambda x: x[key]).alias(key))


def _sets(rows: DataFrame, key: str, cols: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``(key, name)`` and ``(name, *cols)`` as from ``_fold``; ``rows`` are distinct, without nulls in ``cols``, and their key may be null."""
    named = cut(rows.groupBy(key).agg(F.struct(
        F.bit_xor(F.xxhash64(*cols)).alias("a"), F.bit_xor(F.xxhash64(F.lit("second"), *cols)).alias("b"), F.count("*").alias("n")).alias(name)))
    one = named.groupBy(name).agg(F.min(key).alias("_one"))
    return named, rows.join(one, F.col(key).eqNullSafe(F.col("_one"))).select(name, *cols)


def pairs_sharing(left: DataFrame, right: DataFrame, ids: list[str]) -> Pairs:
    """Pairs of a key of ``left (left, *ids)`` and one of ``right (right, *ids)`` that share an id; null ids are no ids.

    Keys that hold the same common ids are one set, and sets meet instead of keys. An id that few keys of one side hold
    would make a set of its own for each of them: its pairs are listed, no more than ``FEW`` for each row of the input.
    """
    plain_unions(left.sparkSession)
    own = {"left": cut(left.select("left", *ids).dropna(subset=ids).distinct()), "right": cut(right.select("right", *ids).dropna(subset=ids).distinct())}
    held = lambda side: own[side].groupBy(*ids).agg(F.count("*").alias(f"n_{side}"))
    known = cut(held("left").join(held("right"), ids).withColumn("common", F.least("n_left", "n_right") > FEW).select(*ids, "common"))
    of = lambda side, common: own[side].join(known.filter(F.col("common") == common).select(*ids), ids, "left_semi")
    lefts, of_left = _sets(of("left", True), "left", ids, "lset")
    rights, of_right = _sets(of("right", True), "right", ids, "rset")
    sets = cut(of_left.join(of_right, ids).select("lset", "rset").distinct())
    few = of("left", False).join(of("right", False), ids).select("left", "right").distinct()
    in_set = lambda keys, key, name: keys.select(F.col(key).alias(f"_{key}"), F.col(name))
    few = few.join(in_set(lefts, "left", "lset"), F.col("left").eqNullSafe(F.col("_left")), "left").join(
        in_set(rights, "right", "rset"), F.col("right").eqNullSafe(F.col("_right")), "left").join(sets, ["lset", "rset"], "left_anti").select("left", "right")
    return Pairs(lefts, rights, sets, cut(few))


def organism_proteins(protein_annotations: DataFrame, annotations: DataFrame, expand: bool = True) -> DataFrame | Pairs:
    """``(sample, protein_key)`` by a shared annotation; without ``expand`` the same as ``Pairs`` of sets.

    A pair comes out once however many annotations it shares, and only the result itself has a row for each pair.
    """
    ids = ["id_type", "id_value"]
    pairs = pairs_sharing(annotations.withColumnRenamed("sample", "left"), protein_annotations.withColumnRenamed("protein_key", "right"), ids)
    return pairs.rows("sample", "protein_key") if expand else pairs


def organism_metabolites(protein_annotations: DataFrame, annotations: DataFrame, rp: DataFrame, linked: DataFrame,
                         mapping: DataFrame) -> DataFrame:
    """``(sample, metabolite, n)``: how many linked (reaction, compound) pairs tie a sample to a metabolite.

    No step has a row for each sample and reaction. Samples and proteins are folded into sets of equal annotations,
    reactions into sets of equal protein sets; pairs are counted for each set of reactions and metabolite before a sample
    set meets them. The samples of a set take over its counts.
    """
    samples, proteins, reached = _matching_sets(protein_annotations, annotations)
    reactions, of_reaction = _fold(rp.join(proteins, "protein_key"), "reaction_key", ["pset"], "rset")
    pairs = linked.join(mapping, "compound_key").select("reaction_key", "compound_key", "metabolite").distinct()
    weights = pairs.join(reactions, "reaction_key").groupBy("rset", "metabolite").agg(F.count("*").alias("w"))
    counts = reached.join(of_reaction, "pset").select("sset", "rset").distinct().join(weights, "rset").groupBy("sset", "metabolite").agg(
        F.sum("w").cast("bigint").alias("n"))
    return samples.join(counts, "sset").select("sample", "metabolite", "n")


def report_matrix(counts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sample by metabolite counts, zero where there is none.

    ``columns`` names the metabolites, and one that occurs without being named is an error; without them the names are
    collected, so it is for few metabolites only (``report_long`` has no such bound).
    """
    if columns:
        named = F.when(F.col("metabolite").isin(columns), F.col("metabolite")).otherwise(
            F.raise_error(F.concat(F.lit("metabolite without a column: "), F.coalesce("metabolite", F.lit("null")))))
        counts = counts.withColumn("metabolite", named)
    wide = counts.groupBy("sample").pivot("metabolite", columns) if columns else counts.groupBy("sample").pivot("metabolite")
    return wide.agg(F.sum("n").cast("bigint")).na.fill(0)


def report_long(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(sample, metabolite, n)`` of every metabolite that occurs; those in ``names`` have a row for each sample, with zeros.

    Unlike the columns of ``report_matrix`` the metabolites need no list, and their number has no bound.
    """
    if names:
        zeros = counts.select("sample").distinct().select(
            "sample", F.explode(F.array(*[F.lit(n) for n in names])).alias("metabolite"), F.lit(0).cast("bigint").alias("n"))
        counts = counts.select("sample", "metabolite", "n").unionByName(zeros)
    return counts.groupBy("sample", "metabolite").agg(F.sum("n").cast("bigint").alias("n"))


def top_participants(participant: DataFrame, names: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` compounds that occur in most equations, with their names ``(compound_key, name)``."""
    top = participant.groupBy("compound_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "compound_key").limit(n)
    one = names.groupBy("compound_key").agg(F.min("name").alias("name"))
    return top.join(one, "compound_key", "left").select("compound_key", "name", "n")


def universal_seeds(reactions: DataFrame | None, proteins: DataFrame | None, ecs: DataFrame | None, kos: DataFrame | None,
                    ko_only: bool = False) -> DataFrame:
    """Seeds that cover everything: reactions ``crp``; proteins, enzyme numbers and orthology groups ``prc``.

    Inputs are ``(id, id_type)`` frames (``ecs`` and ``kos`` only need ``id``).
    """
    parts = []
    if kos is not None:
        parts.append(kos.select("id", F.lit("kegg_ko").alias("id_type"), F.lit("protein").alias("entity_type"), F.lit("prc").alias("mode")))
    if not ko_only:
        if reactions is not None:
            parts.append(reactions.select("id", "id_type", F.lit("reaction").alias("entity_type"), F.lit("crp").alias("mode")))
        if proteins is not None:
            parts.append(proteins.select("id", "id_type", F.lit("protein").alias("entity_type"), F.lit("prc").alias("mode")))
        if ecs is not None:
            parts.append(ecs.select("id", F.lit("enzyme_ec").alias("id_type"), F.lit("protein").alias("entity_type"), F.lit("prc").alias("mode")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def id_sets(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("id_type", "id_value")) -> DataFrame:
    """Union of two id collections with a tag: ``both``, ``left`` or ``right``, in one shuffle."""
    k = list(keys)
    tagged = a.select(*k).withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(
        b.select(*k).withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    got = tagged.groupBy(*k).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return got.select(*k, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def model_report(reaction_ids: DataFrame, by: str = "model") -> DataFrame:
    """Per model: reactions, reactions with each id type, those with only a Reactome id, and shares in percent."""
    kinds = ["enzyme_ec", "kegg", "rhea", "metacyc", "reactome"]
    per = reaction_ids.groupBy(by, "reaction_key").agg(*[F.bool_or(F.col("id_type") == k).alias(k) for k in kinds])
    per = per.na.fill(False, kinds)
    only = F.col("reactome") & ~(F.col("enzyme_ec") | F.col("kegg") | F.col("rhea") | F.col("metacyc"))
    return per.groupBy(by).agg(
        F.count("*").alias("n_reactions"), *[F.count_if(F.col(k)).alias(f"n_{k}") for k in kinds],
        F.count_if(only).alias("n_only_reactome"),
        *[F.round(100 * F.count_if(F.col(k)) / F.count("*"), 3).alias(f"pct_{k}") for k in kinds],
    )
