"""Weakly connected components by alternating star contraction.

Each round only groups edges by node (a map-side combined min) and joins the one-row-per-node result back. Edges of a
hub, a node with more than a thousandth of all edges, are spread over all tasks: there are fewer than a thousand hubs
whatever the input, so their minima go to every task and a giant component is never gathered in one.
The number of rounds grows with the logarithm of the graph, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import bound_tasks, cut, discard

HUB_SHARE = 1000  # a node with more than this part of the edges is a hub


def _toward_smaller(e: DataFrame) -> DataFrame:
    """Orient every edge from the larger node ``u`` to the smaller ``v`` and drop loops."""
    # no end is null; said here, the plans of all who read the edges are the same, so these are made and dealt once
    return e.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull())


def _with_minimum(e: DataFrame, far: str, low: DataFrame, n: int) -> DataFrame:
    """Edges ``(u, far)`` with the minimum ``m`` of their ``u``; ``low`` is ``(u, m, deg)``, ``deg`` the rows of ``u`` among at most ``n`` in ``e``.

    As the degrees add up to ``n`` at most, fewer than ``HUB_SHARE`` rows are broadcast. A hub's edges are dealt by their
    far ends, of which each meets fewer hubs than that; what they find there is not used.
    """
    hub = F.col("deg") * HUB_SHARE > n
    hubs = F.broadcast(low.filter(hub).select("u", F.col("m").alias("hub_m")))
    others = low.filter(~hub).select(F.col("u").alias("at"), F.col("m").alias("own_m"))
    dealt = e.join(hubs, "u", "left").withColumn("at", F.when(F.col("hub_m").isNull(), F.col("u")).otherwise(F.col(far)))
    return dealt.join(others, "at", "left").select("u", far, F.coalesce("hub_m", "own_m").alias("m"))


def _star_large(e: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = e.select("u", "v", F.lit(0).alias("back")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).alias("back")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("back").alias("deg")).withColumn("m", F.least("m", "u"))
    # neighbours larger than the centre are exactly the stored edges read backwards
    out = _with_minimum(e.select(F.col("v").alias("u"), F.col("u").alias("far")), "far", low, n)
    return _toward_smaller(out.select(F.col("far").alias("u"), F.col("m").alias("v"))).distinct()


def _star_small(e: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    out = _with_minimum(e, "v", low, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # every node has an edge; asked for, the degree keeps this the table that the join above reads, or it would be made anew
    own = low.filter("deg > 0").select("u", F.col("m").alias("v"))
    return _toward_smaller(out.unionByName(own)).distinct()


def _fingerprint() -> dict:
    """Aggregates that tell two edge tables apart, taken while a table is written."""
    return {"n": F.count(F.lit(1)), "a": F.bit_xor(F.xxhash64("u", "v")), "b": F.bit_xor(F.xxhash64("v", "u")),
            "c": F.bit_xor(F.hash("u", "v"))}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the smallest node that is connected, in either direction, names the component.

    A row with a null ``dst`` or with ``src == dst`` declares an isolated node. The input is evaluated once; rounds go
    on until the table no longer changes, which it must: every round only moves links to smaller nodes. Each round's
    fingerprint comes from its own write, and the table before it is removed. Texts are contracted by their 64-bit hashes,
    which are far cheaper to move, sort and compare, unless two of them share one; then by themselves.
    """
    found, named = _members(edges, src, dst)
    return found.select("node", F.col("at").alias("component")) if named is None else _smallest_names(cut(found), named)


def component_counts(edges: DataFrame, src: str = "src", dst: str = "dst", **what: Column) -> DataFrame:
    """``(component, *what)``: how many nodes of each component meet each condition on ``node``; components as from ``connected_components``.

    Nodes are counted where they meet their component, so no node gets the name of its component first.
    """
    found, _ = _members(edges, src, dst, what)
    return found.groupBy("at").agg(F.min("node").alias("component"), *[F.count_if(F.col(k)).alias(k) for k in what]).drop("at")


def _members(edges: DataFrame, src: str, dst: str, what: dict[str, Column] | None = None) -> tuple[DataFrame, int | None]:
    """``(node, id, at, *what)`` of each node: ``at`` is the same in a component; and the number of nodes, where ``at`` is a hash.

    Without a number ``at`` is the smallest node itself, and there is no ``id``. ``what`` are columns of ``node``.
    """
    bound_tasks(edges.sparkSession)
    more = [c.alias(k) for k, c in (what or {}).items()]
    u, v = F.col("u"), F.col("v")
    pairs = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")), {"n": F.count_if(u != v)})
    nodes = (
        pairs.select(F.explode(F.array("u", "v")).alias("node")).filter(F.col("node").isNotNull()).distinct()
    )
    links, n = pairs.filter(u.isNotNull() & v.isNotNull()), pairs.observed["n"]
    if dict(pairs.dtypes)["u"] == dict(pairs.dtypes)["v"] == "string":
        named = cut(nodes.select("node", F.xxhash64("node").alias("id")), {"n": F.count(F.lit(1))})
        if named.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
            e = _contracted(links.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")), n)
            at = named.select("node", "id", *more).join(e.select(F.col("u").alias("id"), "v"), "id", "left")
            return at.select("node", "id", F.coalesce("v", "id").alias("at"), *(what or {})), named.observed["n"]
    e = _contracted(links, n)
    return nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("at"), *more), None


def _contracted(links: DataFrame, n: int) -> DataFrame:
    """``(u, v)``: each node that has a smaller one in its component, and the smallest.

    ``links`` are ``n`` rows beside loops and may repeat; the first round reads them as they are.
    """
    e, seen = _toward_smaller(links), {"n": n}
    while n := seen["n"]:
        # the large star makes no more edges than it reads, so ``n`` holds for the small one too
        before, told = e, seen
        e = cut(_star_small(_star_large(e, n), n), _fingerprint())
        seen = e.observed
        if len(told) > 1:  # no longer the given links
            discard(before)
        if told == seen:
            break
    return e


def _smallest_names(found: DataFrame, n: int) -> DataFrame:
    """``(node, component)`` of ``found (node, id, at)``, a table of ``n`` rows: the smallest name of a component is its own.

    As in ``_with_minimum`` names of large components are broadcast, and their nodes are dealt by their ids.
    """
    low = cut(found.groupBy("at").agg(F.min("node").alias("m"), F.count("*").alias("deg")))
    hub = F.col("deg") * HUB_SHARE > n
    hubs = F.broadcast(low.filter(hub).select("at", F.col("m").alias("hub_m")))
    others = low.filter(~hub).select("at", F.col("m").alias("own_m"))
    dealt = found.join(hubs, "at", "left").withColumn("at", F.when(F.col("hub_m").isNull(), F.col("at")).otherwise(F.col("id")))
    return dealt.join(others, "at", "left").select("node", F.coalesce("hub_m", "own_m").alias("component"))
