"""Scored id matching between entities, without ever listing all pairs of a block.

A rule set gives every id type a gain (shared value), a penalty (both have the type but share nothing) and says
whether it counts for the absolute rule. Whether two entities match depends only on three sets of id types: what
each has (its mask) and what they share. So entities with the same mask that share the same values of an id-type
set ``O`` either all match a given other such group or none does. We therefore group by ``(O, values of O, mask)``
and link groups by one representative: the number of links is linear in the rows, however hot a value is, and the
connected components are the same as over all matching pairs. No value is capped or dropped.

Groups are built level by level. A value that one entity alone holds can never be shared, so it is left out at once (its
type stays in the mask). A group of k types is extended to k + 1 only where two entities or more hold it, where some
pair of its masks does not match yet, and where that pair still can. Sharing more never undoes a match, so nothing is
lost, and the number of groups follows what is really shared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import hmdb_variants
from linkloom.session import cut

SCALE = 1000  # scores are kept as whole thousandths, so comparing them is exact
CHUNK = 5  # bits of a mask that are weighed by one look into a table


@dataclass(frozen=True)
class Rule:
    id_type: str
    gain: float = 1.0
    penalty: float = 0.25
    absolute: bool = True  # takes part in the absolute rule
    strict: bool = False  # the absolute rule asks for equality, also when only one side has it


@dataclass(frozen=True)
class MatchConfig:
    rules: tuple[Rule, ...]
    threshold: float
    use_absolute: bool = True
    ceil: bool = False
    hmdb_type: str | None = "hmdb"
    fold_case: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if len(self.rules) > 30:
            raise ValueError("at most 30 id types per rule set: a mask is a 32 bit number")

    @property
    def bits(self) -> dict[str, int]:
        return {r.id_type: 1 << i for i, r in enumerate(self.rules)}

    @property
    def limit(self) -> int:
        """Smallest accepted score in thousandths."""
        t = round(self.threshold * SCALE)
        return t - SCALE + 1 if self.ceil else t

    def with_threshold(self, threshold: float) -> "MatchConfig":
        return MatchConfig(self.rules, threshold, self.use_absolute, self.ceil, self.hmdb_type, self.fold_case)


# The default rule sets. Types that two lists name twice count twice.
_SOURCES = ("metacyc", "kegg", "hmdb", "rhea", "uniprot", "pubchem")
_CHEMICAL = ("pubchem_cid", "pubchem_sid", "inchi", "inchi_key")
COMPOUND = MatchConfig(
    tuple(Rule(t) for t in ("chebi", "chemspider") + _SOURCES)
    + tuple(Rule(t, 2.0, 0.5) for t in _CHEMICAL)
    + (Rule("synonyms", absolute=False),),
    threshold=3,
)
GENE = MatchConfig(
    (Rule("uniprot", 4.0, 0.5), Rule("uniprot_name", 0.5))
    + tuple(Rule(t, 0.5) for t in ("metacyc", "kegg", "hmdb", "rhea", "pubchem") + _CHEMICAL),
    threshold=2,
    hmdb_type=None,
)
PROTEIN = MatchConfig(
    tuple(Rule(t) for t in _SOURCES + _CHEMICAL)
    + (Rule("synonyms", 0.5, 0.0, absolute=False), Rule("single_ec", 1.0, 0.0, absolute=False)),
    threshold=2,
    hmdb_type=None,
    fold_case=("synonyms",),
)
REACTION = MatchConfig(
    (
        Rule("participants", 2.25, 0.0, absolute=False, strict=True),
        Rule("reaction_str", 2.0, 0.0),
    )
    + tuple(Rule(t) for t in _SOURCES + _CHEMICAL),
    threshold=2,
    hmdb_type=None,
    fold_case=("reaction_str",),
)
DEFAULTS = {"compound": COMPOUND, "gene": GENE, "protein": PROTEIN, "reaction": REACTION}


def features(xref: DataFrame, config: MatchConfig) -> DataFrame:
    """``(entity_key, bit, value)``: the distinct values that take part in matching.

    Adds zero-free HMDB ids, and ``single_ec`` for entities with exactly one enzyme number. Rows are dealt by entity, so
    what is asked of each entity next needs no other shuffle.
    """
    bits = config.bits
    rows = xref.select("entity_key", "id_type", "id_value").filter(F.col("id_value").isNotNull())
    if "single_ec" in bits:
        single = (
            rows.filter(F.col("id_type") == "enzyme_ec")
            .groupBy("entity_key")
            .agg(F.min("id_value").alias("id_value"), F.max("id_value").alias("hi"))
            .filter(F.col("id_value") == F.col("hi"))
            .select("entity_key", F.lit("single_ec").alias("id_type"), "id_value")
        )
        rows = rows.unionByName(single)
    rows = rows.filter(F.col("id_type").isin(list(bits)))
    value = F.col("id_value")
    if config.fold_case:
        value = F.when(F.col("id_type").isin(list(config.fold_case)), F.lower(value)).otherwise(value)
    if config.hmdb_type in bits:
        value = F.explode(
            F.when(F.col("id_type") == config.hmdb_type, hmdb_variants("id_value")).otherwise(F.array(value))
        )
    bit = F.element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), F.col("id_type"))
    return rows.select("entity_key", bit.alias("bit"), value.alias("value")).repartition("entity_key").distinct()


def participant_signature(participant: DataFrame) -> DataFrame:
    """Xref rows holding each reaction's multiset of resolved participants; none if one is unresolved.

    The multiset is folded from hashes of ``(compound, times)``, so it combines map-side and no reaction has to
    be collected in one place.
    """
    times = participant.groupBy("reaction_key", "compound_key").agg(F.count("*").alias("times"))
    sig = (
        times.groupBy("reaction_key")
        .agg(
            F.bit_xor(F.xxhash64("compound_key", "times")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit("second"), "times", "compound_key")).alias("h2"),
            F.sum("times").alias("total"),
            F.count_if(F.col("compound_key").isNull()).alias("open"),
        )
        .filter(F.col("open") == 0)
    )
    return sig.select(
        F.lit("reaction").alias("entity_type"),
        F.col("reaction_key").alias("entity_key"),
        F.lit("participants").alias("id_type"),
        F.concat_ws(":", F.hex("h1"), F.hex("h2"), "total").alias("id_value"),
    )


def same_participants(pairs: DataFrame, participant: DataFrame) -> DataFrame:
    """Flag pairs of reactions whose participant lists are equal and fully resolved."""
    sig = participant_signature(participant).select("entity_key", "id_value")
    left = sig.select(F.col("entity_key").alias("left_key"), F.col("id_value").alias("ls"))
    right = sig.select(F.col("entity_key").alias("right_key"), F.col("id_value").alias("rs"))
    return (
        pairs.join(left, "left_key", "left")
        .join(right, "right_key", "left")
        .withColumn("same_participants", F.coalesce(F.col("ls") == F.col("rs"), F.lit(False)))
        .drop("ls", "rs")
    )


def masks(feats: DataFrame) -> DataFrame:
    """Which id types an entity has, as a bit mask."""
    return feats.groupBy("entity_key").agg(F.bit_or("bit").alias("mask"))


def _weight(mask: Column, config: MatchConfig, what) -> Column:
    """The sum of a mask's weights, from tables of the sums of ``CHUNK`` types at a time."""
    weights = [round(what(r) * SCALE) for r in config.rules]
    total = F.lit(0)
    for at in range(0, len(weights), CHUNK):
        part = weights[at : at + CHUNK]
        if any(part):
            sums = [sum(w for i, w in enumerate(part) if m >> i & 1) for m in range(1 << len(part))]
            total = total + F.get(F.array(*[F.lit(x) for x in sums]), F.shiftright(mask, at).bitwiseAND(F.lit(len(sums) - 1)))
    return total


def _score(shared: Column, common: Column, config: MatchConfig) -> Column:
    return _weight(shared, config, lambda r: r.gain + r.penalty) - _weight(common, config, lambda r: r.penalty)


def _absolute(shared: Column, m1: Column, m2: Column, config: MatchConfig) -> Column:
    a = sum(1 << i for i, r in enumerate(config.rules) if r.absolute)
    s = sum(1 << i for i, r in enumerate(config.rules) if r.strict)
    both = m1.bitwiseAND(m2).bitwiseAND(F.lit(a))
    ok = (both != 0) & (both == shared.bitwiseAND(F.lit(a)))
    if s:
        ok = ok & (m1.bitwiseOR(m2).bitwiseAND(F.lit(s)) == shared.bitwiseAND(F.lit(s)))
    return ok


def accepts(shared: Column, m1: Column, m2: Column, config: MatchConfig) -> Column:
    """The match decision from the shared id types and the two masks."""
    ok = _score(shared, m1.bitwiseAND(m2), config) >= config.limit
    return ok | _absolute(shared, m1, m2, config) if config.use_absolute else ok


def score_pairs(pairs: DataFrame, feats: DataFrame, config: MatchConfig) -> DataFrame:
    """Score given pairs ``(left_key, right_key)``: adds ``score``, ``absolute`` and ``matched``."""
    wanted = pairs.select("left_key", "right_key").distinct()
    lf = feats.select(F.col("entity_key").alias("left_key"), "bit", "value")
    rf = feats.select(F.col("entity_key").alias("right_key"), "bit", "value")
    shared = (
        wanted.join(lf, "left_key").join(rf, ["right_key", "bit", "value"])
        .groupBy("left_key", "right_key").agg(F.bit_or("bit").alias("shared"))
    )
    m = masks(feats)
    lm = m.select(F.col("entity_key").alias("left_key"), F.col("mask").alias("lm"))
    rm = m.select(F.col("entity_key").alias("right_key"), F.col("mask").alias("rm"))
    full = (
        wanted.join(lm, "left_key", "left").join(rm, "right_key", "left")
        .join(shared, ["left_key", "right_key"], "left").na.fill(0, ["lm", "rm", "shared"])
    )
    s, l, r = F.col("shared"), F.col("lm"), F.col("rm")
    return full.select(
        "left_key", "right_key",
        (_score(s, l.bitwiseAND(r), config) / SCALE).alias("score"),
        _absolute(s, l, r, config).alias("absolute"),
        accepts(s, l, r, config).alias("matched"),
    )


def any_match(entities: DataFrame, pairs_scored: DataFrame) -> DataFrame:
    """Entities (``entity_key``) that match at least one other of the scored pairs."""
    hit = pairs_scored.filter("matched").select(
        F.explode(F.array("left_key", "right_key")).alias("entity_key")
    ).distinct()
    return entities.join(hit, "entity_key", "left_semi")


def _met(groups: DataFrame, wanted) -> DataFrame:
    """``(o_mask, key, x, y)``: the pairs of entries of each list ``bl`` that ``wanted(x, y)`` takes, made row by row and not kept."""
    x = groups.select("o_mask", "key", "bl", F.explode("bl").alias("x"))
    both = x.select("o_mask", "key", "x", F.explode("bl").alias("y"))
    return both.filter(wanted(F.col("x"), F.col("y")))


def _open_masks(blocks: DataFrame, config: MatchConfig) -> DataFrame:
    """``(key, mask)`` of groups that have a pair of masks which does not match yet but may with more types."""
    # at most one entry per combination of id types
    ms = blocks.groupBy("o_mask", "key").agg(F.collect_list(F.struct("mask", "c")).alias("bl"))
    o = F.col("o_mask")
    higher = F.bitwise_not(F.expr("shiftleft(1, cast(floor(log2(o_mask)) as int) + 1) - 1"))

    def undecided(x: Column, y: Column) -> Column:
        common = x["mask"].bitwiseAND(y["mask"])
        best = o.bitwiseOR(common.bitwiseAND(higher))
        return ((x["mask"] != y["mask"]) | (x["c"] > 1)) & ~accepts(o, x["mask"], y["mask"], config) & accepts(best, x["mask"], y["mask"], config)

    return _met(ms, undecided).select("key", F.col("x.mask").alias("mask")).distinct()


def _hashed(bit, value) -> Column:
    """The 16 bytes that stand for a value of an id type."""
    return F.unhex(F.md5(F.concat_ws("\u0001", F.col(bit).cast("string"), value).cast("binary")))


def block_rows(values: DataFrame, config: MatchConfig, two_sides: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(entity_key, side, mask, o_mask, key)``: the groups of each entity, for all sets of types that are worth looking at,
    and ``(o_mask, key, mask, rep, c)``: their smallest entities and sizes by mask.

    ``values`` is ``(entity_key, side, mask, bit, vk)``. With ``two_sides`` a group counts only if it has entities of two
    sides; without, if it has two entities. A ``key`` belongs to one ``o_mask``. Whether a group counts is asked by a 64-bit
    hash of its key: where two hashes clash a group of one entity stays, which matches nothing.
    """
    level = values.select("entity_key", "side", "mask", F.col("bit").alias("o_mask"), F.col("vk").alias("key"))
    shared = F.min("side") != F.max("side") if two_sides else F.count("*") > 1
    rows = blocks = kept = None
    while True:
        held = level.groupBy(F.xxhash64("key").alias("h")).agg(shared.alias("shared")).filter("shared").select("h")
        level = cut(level.join(held, F.xxhash64("key") == F.col("h"), "left_semi"), {"n": F.count(F.lit(1))})
        if kept is None:
            # values that can be shared at all; the first level holds just these
            kept = level.select("entity_key", F.col("o_mask").alias("bit"), F.col("key").alias("vk"))
        rows = level if rows is None else rows.unionByName(level)
        if blocks is not None and not level.observed["n"]:
            return rows, blocks
        found = cut(level.groupBy("o_mask", "key", "mask").agg(F.min("entity_key").alias("rep"), F.count("*").alias("c")))
        blocks = found if blocks is None else blocks.unionByName(found)
        grown = level.join(_open_masks(found, config), ["key", "mask"], "left_semi").join(kept, "entity_key")
        level = grown.filter(F.col("bit") > F.col("o_mask")).select(
            "entity_key", "side", "mask", F.col("o_mask").bitwiseOR(F.col("bit")).alias("o_mask"), F.unhex(F.md5(F.concat("key", "vk"))).alias("key"))


def _folded(feats: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """``(entity_key, mask, bit, vk)`` of one entity for all that have exactly the same values, the smallest; and the others' links to it.

    Values of an entity are distinct, so two independent xor-folded 64 bit hashes and the count identify the set. They
    are kept in one row of each entity; only entities that have a twin are moved to be told apart.
    """
    own = Window.partitionBy("entity_key")
    rows = feats.filter(F.col("entity_key").isNotNull()).withColumn("first", F.row_number().over(own.orderBy("bit", "value")) == 1)
    once = lambda c: F.when(F.col("first"), c)
    rows = cut(rows.select(
        "entity_key", "first", F.bit_or("bit").over(own).alias("mask"), "bit", _hashed("bit", "value").alias("vk"),
        once(F.bit_xor(F.xxhash64("bit", "value")).over(own)).alias("h1"),
        once(F.bit_xor(F.xxhash64(F.lit("second"), "value", "bit")).over(own)).alias("h2"), once(F.count("*").over(own)).alias("c")))
    one = rows.filter("first")
    same = cut(one.groupBy("h1", "h2", "c").agg(F.min("entity_key").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    twins = cut(one.join(same, ["h1", "h2", "c"]).filter(F.col("entity_key") != F.col("rep")).select("entity_key", "rep", "mask"))
    links = twins.filter(accepts(F.col("mask"), F.col("mask"), F.col("mask"), config)).select(F.col("entity_key").alias("src"), F.col("rep").alias("dst"))
    return rows.select("entity_key", "mask", "bit", "vk").join(twins.select("entity_key"), "entity_key", "left_anti"), links


def match_links(feats: DataFrame, config: MatchConfig) -> DataFrame:
    """Links ``(src, dst)`` whose connected components equal those over all matching pairs; a link may come twice."""
    values, twins = _folded(feats, config)
    rows, blocks = block_rows(values.withColumn("side", F.lit("")), config)
    # a group holds at most one entry per mask, that is, per combination of id types
    groups = cut(blocks.groupBy("o_mask", "key").agg(
        F.collect_list(F.struct("mask", "rep", "c")).alias("bl"), F.sum("c").alias("total")
    ).filter(F.col("total") > 1).drop("total"))
    hits = _met(groups, lambda x, y: ((x["mask"] < y["mask"]) | ((x["mask"] == y["mask"]) & (x["c"] > 1)))
                & accepts(F.col("o_mask"), x["mask"], y["mask"], config))
    between = hits.filter("x.mask < y.mask").select(F.col("x.rep").alias("src"), F.col("y.rep").alias("dst")).distinct()
    ends = hits.select("key", F.explode(F.array("x", "y")).alias("b")).filter("b.c > 1").select("key", "b.mask", "b.rep").distinct()
    within = rows.join(ends, ["key", "mask"]).filter(F.col("entity_key") != F.col("rep")).select(
        F.col("entity_key").alias("src"), F.col("rep").alias("dst"))
    return between.filter(F.col("src") != F.col("dst")).unionByName(within).unionByName(twins)


def candidates(records: DataFrame, existing: DataFrame, config: MatchConfig) -> DataFrame:
    """For every record the smallest existing entity that matches it: ``(record_key, candidate_key)``.

    Both inputs are feature frames. A query by a single id is a record with one value and a threshold of 1.
    """
    tag = lambda df, side: df.select(F.concat(F.lit(side), "entity_key").alias("entity_key"), "bit", "value")
    both = cut(tag(records, "q").unionByName(tag(existing, "e")))
    values = both.join(masks(both), "entity_key").select(
        "entity_key", F.substring("entity_key", 1, 1).alias("side"), "mask", "bit", _hashed("bit", "value").alias("vk"))
    rows = block_rows(values, config, True)[0].withColumn("entity_key", F.expr("substring(entity_key, 2)"))
    blocks = rows.filter("side = 'e'").groupBy("o_mask", "key", "mask").agg(F.min("entity_key").alias("cand"))
    hits = (
        rows.filter("side = 'q'").select(F.col("entity_key").alias("record_key"), F.col("mask").alias("qm"), "o_mask", "key")
        .join(blocks, ["o_mask", "key"])
        .filter(accepts(F.col("o_mask"), F.col("qm"), F.col("mask"), config))
        .select("record_key", "cand")
    )
    return hits.groupBy("record_key").agg(F.min("cand").alias("candidate_key"))
