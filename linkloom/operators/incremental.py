"""Resolved entities that are kept and changed: new records are inserted or merged, and removals split clusters again.

Whether two entities match depends on their own values alone, so what a batch can change is known beforehand: links
with an entity of the batch. The stored entities that share a value with the batch are looked up by value. Those that
agree in what they share, in the id types they have and in their cluster are one to the batch, and one of them stands for
all; the values that the batch does not hold are replaced by private ones, which keep the id types right and match
nothing. Matching then runs over the batch and these few, and clusters are joined by components over the new entities and the
clusters they touch. Stored links are never decided again.

A removal or a change may break links, so the clusters that hold a changed entity are taken out whole and their members
inserted anew: whatever still holds together comes back as one, the rest falls apart, and new links to other clusters (an
id type that spoke against a match is gone) are found as for any batch. All other clusters stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.arrays import spread
from linkloom.operators.components import connected_components
from linkloom.operators.matching import MatchConfig, features, masks, match_links
from linkloom.session import cut


@dataclass(frozen=True)
class Store:
    """``values(entity_key, bit, value)``, ``masks(entity_key, mask)`` and ``cluster(entity_key, cluster_key)`` of one entity type."""

    values: DataFrame
    masks: DataFrame
    cluster: DataFrame

    def save(self, path: str) -> None:
        for name in ("values", "masks", "cluster"):
            getattr(self, name).write.parquet(f"{path}/{name}")


def load(spark, path: str) -> Store:
    return Store(*(spark.read.parquet(f"{path}/{name}") for name in ("values", "masks", "cluster")))


def empty(spark) -> Store:
    """A store without entities."""
    return Store(spark.createDataFrame([], "entity_key string, bit int, value string"), spark.createDataFrame([], "entity_key string, mask int"),
                 spark.createDataFrame([], "entity_key string, cluster_key string"))


def _standing(store: Store, batch: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """Stored values that the batch shares, one entity for all that are the same to it; and the cluster of each of these."""
    wanted = batch.select("bit", "value").distinct()
    met = store.values.join(wanted, ["bit", "value"], "left_semi")
    told = met.groupBy("entity_key").agg(
        F.bit_xor(F.xxhash64("bit", "value")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "value", "bit")).alias("h2"),
        F.count("*").alias("c"), F.bit_or("bit").alias("met"))
    told = told.join(store.masks, "entity_key").join(store.cluster, "entity_key")
    chosen = cut(told.groupBy("h1", "h2", "c", "mask", "cluster_key").agg(F.min("entity_key").alias("entity_key"), F.min("met").alias("met")).select(
        "entity_key", "cluster_key", "mask", "met"))
    own = met.join(chosen.select("entity_key"), "entity_key", "left_semi").select("entity_key", "bit", "value")
    bits = F.array(*[F.lit(b) for b in config.bits.values()])
    hidden = F.filter(bits, lambda b: (b.bitwiseAND(F.col("mask")) != 0) & (b.bitwiseAND(F.col("met")) == 0))
    private = spread(chosen, hidden, "bit", "entity_key").select("entity_key", "bit", F.concat(F.lit("\u0000"), "entity_key").alias("value"))
    return own.unionByName(private), chosen.select("entity_key", "cluster_key")


def insert(store: Store, xref: DataFrame, config: MatchConfig) -> Store:
    """``store`` with the entities of ``xref``, each in a cluster of its own or merged with those that it matches.

    The result is that of resolving all entities at once; the smallest member names a cluster. Entities of ``xref`` must
    not be stored yet (see ``change``). A batch without rows leaves the store as it is.
    """
    return _insert(store, features(xref, config), xref.select("entity_key").distinct(), config)


def _insert(store: Store, batch: DataFrame, keys: DataFrame, config: MatchConfig) -> Store:
    batch, keys = cut(batch), cut(keys)
    standing, cluster_of = _standing(store, batch, config)
    links = match_links(batch.unionByName(standing), config)
    # a stored entity stands for its cluster
    to = lambda end: F.coalesce(F.col(f"c_{end}"), F.col(end))
    for end in ("src", "dst"):
        links = links.join(cluster_of.select(F.col("entity_key").alias(end), F.col("cluster_key").alias(f"c_{end}")), end, "left")
    graph = links.select(to("src").alias("src"), to("dst").alias("dst")).unionByName(
        keys.select(F.col("entity_key").alias("src"), F.lit(None).cast("string").alias("dst")))
    found = cut(connected_components(graph))
    moved = found.filter("node <> component").select(F.col("node").alias("cluster_key"), "component")
    kept = store.cluster.join(moved, "cluster_key", "left").select("entity_key", F.coalesce("component", "cluster_key").alias("cluster_key"))
    new = keys.join(found, F.col("entity_key") == F.col("node")).select("entity_key", F.col("component").alias("cluster_key"))
    return Store(cut(store.values.unionByName(batch)), cut(store.masks.unionByName(masks(batch))), cut(kept.unionByName(new)))


def change(store: Store, changed: DataFrame, xref: DataFrame, config: MatchConfig) -> Store:
    """``store`` after the entities ``changed(entity_key)`` have become what ``xref`` says; without rows there they are gone.

    ``xref`` holds all rows of each changed entity; it may also bring entities that are not stored yet. Only clusters with a
    changed entity are decided anew.
    """
    changed = cut(changed.select("entity_key").distinct())
    hit = store.cluster.join(changed, "entity_key", "left_semi").select("cluster_key").distinct()
    taken = cut(store.cluster.join(hit, "cluster_key", "left_semi").select("entity_key"))
    out = lambda df: df.join(taken, "entity_key", "left_anti")
    rest = Store(out(store.values), out(store.masks), out(store.cluster))
    same = taken.join(changed, "entity_key", "left_anti")
    batch = store.values.join(same, "entity_key", "left_semi").select("entity_key", "bit", "value").unionByName(features(xref, config))
    return _insert(rest, batch, same.unionByName(xref.select("entity_key").distinct()).distinct(), config)


def remove(store: Store, xref: DataFrame, removals: DataFrame, config: MatchConfig, keys: list[str] | None = None) -> tuple[Store, DataFrame]:
    """``store`` and the remaining rows of ``xref`` once the rows named by ``removals`` are gone.

    ``xref`` is what the store was built from; ``removals`` has the columns ``keys`` (entity, id type and value by default).
    A cluster that only removed values held together falls apart; an entity without rows disappears.
    """
    from linkloom.operators.xref import remove_values

    left, gone = remove_values(xref, removals, keys)
    changed = cut(gone.select("entity_key").distinct())
    return change(store, changed, left.join(changed, "entity_key", "left_semi"), config), left
