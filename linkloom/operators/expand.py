"""Typed expansion: from seeds, follow the link types their search modes allow until nothing new is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.lookup import unseen
from linkloom.session import bound_tasks, cut

# The link types each search mode follows. "cr" only fires from seed compounds.
MODES = {
    "": [],
    "gp": ["gp"],
    "gpr": ["gp", "pr"],
    "gprc": ["gp", "pr", "rc"],
    "pg": ["pg"],
    "pr": ["pr"],
    "prc": ["pr", "rc"],
    "rpg": ["pg", "rp"],
    "rp": ["rp"],
    "rc": ["rc"],
    "cr": ["cr", "rc"],
    "crp": ["rp", "cr", "rc"],
    "crpg": ["pg", "rp", "cr", "rc"],
    "global": ["gp", "pg", "pr", "rp", "cr", "rc"],
}
ENTITY_TYPES = ["gene", "protein", "reaction", "compound"]
COMPACT = 16  # tables of reached states that are written together as one
STATE = ["mode_key", "node_type", "node_key"]
KIND = {t[0]: t for t in ENTITY_TYPES}
# Link types outside the mode table and the entity types at their ends.
EXTRA = {"in_complex": ("protein", "protein"), "has_subunits": ("protein", "protein"), "pp": ("protein", "protein"),
         "cp": ("compound", "protein")}
SEED_ONLY = ["cr", "cp"]


def ends(edge_type: str) -> tuple[str, str]:
    """Entity types at the source and target of a link type."""
    return EXTRA.get(edge_type) or (KIND[edge_type[0]], KIND[edge_type[1]])


def end_type(edge_type, side: int) -> Column:
    """The entity type at the source (0) or target (1) of the link type in a column; null for unknown link types."""
    known = dict.fromkeys([*EXTRA, *(a[0] + b[0] for a in ENTITY_TYPES for b in ENTITY_TYPES)])
    table = F.create_map(*[F.lit(x) for e in known for x in (e, ends(e)[side])])
    return F.try_element_at(table, F.col(edge_type) if isinstance(edge_type, str) else edge_type)


def mode_key(modes: list[str]) -> str:
    """One name for a set of modes that are active together."""
    return ",".join(sorted(set(modes)))


def mode_edges(spark: SparkSession, keys: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(mode_key, edge_type, src_type, dst_type, seed_only)``; at most a few rows per mode, so it is broadcast.

    ``extra`` switches on link types outside the table (``in_complex``, ``has_subunits``, ``pp``, ``cp``) in every
    mode; ``cp`` needs a mode that starts from compounds.
    """
    rows = []
    for key in keys if keys is not None else list(MODES):
        allowed = set().union(*[MODES[m] for m in key.split(",")])
        allowed |= {e for e in extra if e != "cp" or "cr" in allowed}
        rows += [(key, e, *ends(e), e in SEED_ONLY) for e in sorted(allowed)]
    return spark.createDataFrame(
        rows, "mode_key string, edge_type string, src_type string, dst_type string, seed_only boolean"
    )


def step(frontier: DataFrame, edge: DataFrame, edge_type: str, unique: bool = True) -> DataFrame:
    """One typed step: nodes ``(mode_key, node_type, node_key)`` to the nodes behind their ``edge_type`` links."""
    src_type, dst_type = ends(edge_type)
    out = (
        frontier.filter(F.col("node_type") == src_type)
        .join(edge.filter(F.col("edge_type") == edge_type).select(F.col("src_key").alias("node_key"), "dst_key"), "node_key")
        .select("mode_key", F.lit(dst_type).alias("node_type"), F.col("dst_key").alias("node_key"))
    )
    return out.distinct() if unique else out


def _start(seeds: DataFrame, stoplist: DataFrame | None) -> DataFrame:
    """Seeds as states; ``open`` is false for stop-listed compounds, which are reached but not expanded."""
    s = seeds.select(*STATE).distinct().withColumn("open", F.lit(True))
    if stoplist is None:
        return s
    stop = stoplist.select(F.lit("compound").alias("node_type"), F.col("entity_key").alias("node_key"), F.lit(False).alias("go")).distinct()
    return s.join(stop, ["node_type", "node_key"], "left").select(*STATE, F.coalesce("go", F.lit(True)).alias("open"))


def _ordered(edge_types: list[str]) -> list[str] | None:
    """Link types so that each comes after all that feed its source type; None when the types form a cycle.

    ``cr`` and ``cp`` start at seeds only, so nothing feeds them.
    """
    left, out = list(edge_types), []
    while left:
        fed = {ends(e)[1] for e in left}
        ready = [e for e in left if e in SEED_ONLY or ends(e)[0] not in fed]
        if not ready:
            return None
        out += ready
        left = [e for e in left if e not in ready]
    return out


def expand_mode(seeds: DataFrame, edge: DataFrame, mode: str, stoplist: DataFrame | None = None,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """Entities reached under one mode (or several active modes joined by commas): ``(mode_key, node_type, node_key)``.

    Where the link types form no cycle, the walk is one lazy plan with a join per link type. Otherwise it loops.
    """
    table = mode_edges(seeds.sparkSession, [mode], extra)
    allowed = sorted(set().union(*[MODES[m] for m in mode.split(",")]))
    allowed += [e for e in extra if e != "cp" or "cr" in allowed]
    order = _ordered(allowed)
    s = seeds.withColumn("mode_key", F.lit(mode))
    if order is None:
        return expand(s, edge, table, stoplist)
    start = _start(s, stoplist)
    reached = {t: start.filter(F.col("node_type") == t).select(*STATE) for t in ENTITY_TYPES}
    seed_open = start.filter("open").select(*STATE)
    done: dict[str, DataFrame] = {}

    def settled(t: str) -> DataFrame:
        # the order puts all links into a type before those out of it, so each type is made distinct once
        if t not in done:
            done[t] = reached[t].distinct()
        return done[t]

    for e in order:
        src, dst = ends(e)
        new = step(seed_open if e in SEED_ONLY else settled(src), edge, e, unique=False)
        reached[dst] = reached[dst].unionByName(new)
    out = None
    for t in ENTITY_TYPES:
        out = settled(t) if out is None else out.unionByName(settled(t))
    return out


def expand(seeds: DataFrame, edge: DataFrame, modes: DataFrame, stoplist: DataFrame | None = None) -> DataFrame:
    """Entities reached by seeds ``(mode_key, node_type, node_key)`` of any mix of modes.

    States are kept per mode set, not per seed, so seeds of one mode share the walk. Every round joins only the
    newly reached states with the links and is written to the checkpoint folder. Rounds end when nothing new is reached,
    which they must: states only grow.
    """
    bound_tasks(seeds.sparkSession)
    start = cut(_start(seeds, stoplist))
    visited = start.select(*STATE)
    # the few rows of the mode table go to every task: Spark does not know its size and would deal all links by their few types
    table = modes.select("mode_key", "edge_type", "seed_only")
    used = F.broadcast(modes.select("edge_type", F.col("src_type").alias("node_type"), "dst_type").distinct())
    # the links are read once and reduced to the types in use
    links = cut(edge.select("edge_type", F.col("src_key").alias("node_key"), "dst_key").join(used, "edge_type"))

    def follow(frontier: DataFrame, seed_only: bool) -> DataFrame:
        # links first: both sides are stored tables of known size, so a small frontier is broadcast
        return (
            frontier.join(links, ["node_type", "node_key"])
            .join(F.broadcast(table.filter("seed_only" if seed_only else "not seed_only")), ["mode_key", "edge_type"])
            .select("mode_key", F.col("dst_type").alias("node_type"), F.col("dst_key").alias("node_key")).distinct()
        )

    fresh = cut(unseen(
        follow(start.select(*STATE), False).unionByName(follow(start.filter("open").select(*STATE), True)).distinct(),
        visited, STATE))
    parts = 1
    while not fresh.isEmpty():
        visited, parts = visited.unionByName(fresh), parts + 1
        if parts >= COMPACT:  # one table again, so that plans stay short over long chains
            visited, parts = cut(visited), 1
        fresh = cut(unseen(follow(fresh, False), visited, STATE))
    return visited


def reached_edges(reached: DataFrame, seeds: DataFrame, edge: DataFrame, modes: DataFrame,
                  stoplist: DataFrame | None = None) -> DataFrame:
    """The links walked between reached entities: ``(mode_key, edge_type, src_key, dst_key)``."""
    open_seeds = _start(seeds, stoplist).filter("open").select(*STATE)
    table = modes
    links = edge.select("edge_type", F.col("src_key").alias("node_key"), "dst_key")

    def walk(nodes: DataFrame, allowed: DataFrame) -> DataFrame:
        return (
            nodes.withColumnRenamed("node_type", "src_type").join(F.broadcast(allowed), ["mode_key", "src_type"])
            .join(links, ["edge_type", "node_key"])
            .select("mode_key", "edge_type", F.col("node_key").alias("src_key"), "dst_key")
        )

    return walk(reached.select(*STATE), table.filter("not seed_only")).unionByName(
        walk(open_seeds, table.filter("seed_only"))
    ).distinct()


def protein_family(seeds: DataFrame, family: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """Proteins tied to seed proteins by complexes and subunits, followed to the end, and one step to EC peers.

    ``family(edge_type, src_key, dst_key)`` holds ``in_complex`` and ``has_subunits`` links, ``peers`` links that are
    not followed further. Returns ``(protein_key)``.
    """
    bound_tasks(seeds.sparkSession)
    start = seeds.select("protein_key").distinct()
    links = cut(family.filter(F.col("edge_type").isin("in_complex", "has_subunits")).select(
        F.col("src_key").alias("protein_key"), "dst_key"
    ))
    visited = fresh = cut(start)
    parts = 1
    while True:
        nxt = fresh.join(links, "protein_key").select(F.col("dst_key").alias("protein_key")).distinct()
        fresh = cut(unseen(nxt, visited, ["protein_key"]))
        if fresh.isEmpty():
            break
        visited, parts = visited.unionByName(fresh), parts + 1
        if parts >= COMPACT:
            visited, parts = cut(visited), 1
    if peers is not None:
        hop = visited.join(peers.select(F.col("src_key").alias("protein_key"), "dst_key"), "protein_key")
        visited = visited.unionByName(hop.select(F.col("dst_key").alias("protein_key")))
    return visited.distinct()
