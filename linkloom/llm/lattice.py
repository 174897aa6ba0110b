"""Near-duplicate embeddings by lattice hashing.

Vectors are normalised and, for each of several tables, projected by random orthonormal directions to two blocks of eight
dimensions. Each block is decoded to its nearest point of the lattice E8 (the better of the two nearest points of D8 and
of D8 shifted by a half); the two points name the vector's home cell. The point of the other coset is the neighbour
probed, alone and in both blocks at once, so each vector visits three more cells per table. Vectors meet where one's home
is a cell of the other; each pair that meets is verified by its cosine in double precision.

With the scale 3 and 12 tables a pair of cosine 0.93 in 64 dimensions meets with a probability of 0.999, and two random
vectors with 0.006 per table; larger corpora take a larger scale and more tables. Components of unit vectors shrink with
the root of their length, so the scale is that of 64 dimensions and grows alike: from 2 to 768 dimensions the same pairs
meet with 0.998 or more (simulated).

Equal vectors of one label are folded first and weigh as many as they are. Only cells in which somebody meets get the
vectors at all. A cell is cut into parts by id, and pairs of parts are compared as matrices, so a cell that holds a third
of all rows becomes many tasks of bounded size. Pairs never leave a task: it counts the links of each vector and names
the smallest id reachable inside the part. A pair that meets several times is counted where it meets first, which both
its vectors' cells tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_arrow
from linkloom.operators.components import connected_components
from linkloom.session import cut

TABLES = 12
BLOCKS = 2
SCALE = 3.0  # of 64 dimensions
PART = 1024  # rows of one part of a cell
SEED = 93


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: rounding, with the worst coordinate turned where the sum is odd."""
    f = np.rint(x)
    off = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lattice point of each row, doubled to whole numbers, and the nearest one of the other coset."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    swap = (((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1))[:, None]
    return (2 * np.where(swap, b, a)).astype(np.int64), (2 * np.where(swap, a, b)).astype(np.int64)


def directions(dim: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    """``tables`` sets of ``8 * blocks`` directions; orthonormal within a set where the dimension allows."""
    rng, width = np.random.default_rng([seed, dim]), 8 * blocks
    sets = []
    for _ in range(tables):
        g = rng.normal(size=(dim, width))
        sets.append(np.linalg.qr(g)[0] if dim >= width else g / np.sqrt(dim))
    return np.stack(sets)


def _code(points: np.ndarray) -> np.ndarray:
    h = np.full(len(points), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(points.shape[1]):
            h = (h ^ points[:, c].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells_of(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cells of each unit vector: an array (vector, table, 2 ** blocks); the first cell is the home. ``scale`` is that of 64 dimensions."""
    scale *= np.sqrt(unit.shape[1] / 64)
    out = np.empty((len(unit), tables, 1 << blocks), dtype=np.int64)
    for t, q in enumerate(directions(unit.shape[1], tables, blocks, seed)):
        p = np.einsum("ij,jk->ik", unit, q) * scale  # row by row alike, however many rows
        near = [nearest_e8(p[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        for m in range(1 << blocks):
            out[:, t, m] = _code(np.concatenate([near[b][m >> b & 1] for b in range(blocks)], axis=1))
    return out


def _unit(column) -> np.ndarray:
    v = np.stack(column).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _first_meeting(cells: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Which of the pairs meet in this cell of this table before anywhere else."""
    ours = np.ones(len(i), dtype=bool)
    for t in range(table + 1):
        hi, hj = cells[i, t, 0], cells[j, t, 0]
        at_i, at_j = (cells[j, t] == hi[:, None]).any(axis=1), (cells[i, t] == hj[:, None]).any(axis=1)
        if t < table:
            ours &= ~(at_i | at_j)
        else:
            big = np.iinfo(np.int64).max
            ours &= np.minimum(np.where(at_i, hi, big), np.where(at_j, hj, big)) == cell
    return ours


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row.

    Rows link when their labels are equal and not null, their vectors as long, and their cosine at least ``threshold``;
    none below is linked. Null, empty and zero vectors and those with null or non-finite components link with nothing, and so
    do rows with a null id (their component is null and they are not kept). Equal vectors link with each other. Rows that
    share an id are one node, whose links add up over its vectors. Other columns are left behind; an empty table gives no rows.
    """
    key, label = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    numbers = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), numbers.alias("v"))
    rows = rows.withColumn("dim", F.size("v"))
    good = F.coalesce(
        (F.col("dim") > 0) & F.col("id").isNotNull() & F.col("label").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    folded = cut(rows.filter(good).groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("w")).withColumn("vk", F.xxhash64("v")))

    def hashed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for a in range(0, part.num_rows, 2048):
                    some = part.slice(a, 2048)
                    cells = cells_of(_matrix(some.column("v"), int(dim)), tables, blocks, scale)
                    n, per = len(cells), tables << blocks
                    take = pa.array(np.repeat(np.arange(n), per))
                    yield pa.RecordBatch.from_arrays([
                        *[some.column(c).take(take) for c in ("rep", "vk", "label", "dim")],
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 << blocks), n)), pa.array(cells.ravel()),
                        pa.array(np.tile(np.arange(1 << blocks) == 0, n * tables))], names=["rep", "vk", "label", "dim", "t", "cell", "home"])

    cell_key = ["label", "dim", "t", "cell"]
    visits = cut(map_arrow(folded.select("rep", "vk", "label", "dim", "v"), hashed, f"rep {key}, vk long, label {label}, dim int, t int, cell long, home boolean"))
    busy = visits.groupBy(*cell_key).agg(F.count("*").alias("n"), F.max("home").alias("any_home")).filter("n > 1 and any_home")
    busy = busy.select(*cell_key, F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    placed = visits.join(busy, cell_key).withColumn("part", F.pmod(F.xxhash64("rep", "vk"), F.col("parts")).cast("int"))
    placed = placed.select(*cell_key, "rep", "vk", "home", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.select(*cell_key, "rep", "vk", "home", "part", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"))
    block = [*cell_key, "pa", "pb"]
    full = placed.join(folded.select("rep", "vk", "w", "v"), ["rep", "vk"])
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = full.repartition(parts, *block).sortWithinPartitions(*block)

    def compare(table: pa.Table):
        """Links and reachable ids of the vectors of one block."""
        first = table.slice(0, 1).to_pylist()[0]
        home, part = table.column("home").to_numpy(), table.column("part").to_numpy()
        w, ids = table.column("w").to_numpy(), table.column("rep")
        same = ids.dictionary_encode().combine_chunks().indices.to_numpy()
        v = table.column("v").combine_chunks()
        unit = _matrix(v, first["dim"])
        close = np.triu(unit @ unit.T >= threshold - 1e-9, 1) & (home[:, None] | home[None, :])
        if first["pa"] != first["pb"]:
            close &= part[:, None] != part[None, :]
        i, j = np.nonzero(close)
        if not len(i):
            return None
        exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = i[exact & (same[i] != same[j])], j[exact & (same[i] != same[j])]
        if not len(i):
            return None
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = back[: len(i)], back[len(i) :]
        ours = _first_meeting(cells_of(unit[used], tables, blocks, scale), a, b, first["t"], first["cell"])
        links = np.bincount(a[ours], w[used[b[ours]]], len(used)) + np.bincount(b[ours], w[used[a[ours]]], len(used))
        order = np.argsort(np.array(pa.compute.rank(ids.combine_chunks().take(pa.array(used)), sort_keys="ascending", tiebreaker="dense")), kind="stable")
        low = np.empty(len(used), np.int64)
        low[order] = np.arange(len(used))  # place by id
        while True:  # smallest id reachable inside the block
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            if (new == low).all():
                break
            low = new
        named = ids.combine_chunks().take(pa.array(used))
        return pa.RecordBatch.from_arrays([named, pa.array(links.astype(np.int64)), named.take(pa.array(order[low]))], names=["rep", "links", "low"])

    def stream(batches):
        held, now = [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in block], strict=True))
            edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if keys[a] != now and held:
                        found = compare(pa.Table.from_batches(held))
                        if found is not None:
                            yield found
                        held = []
                    now = keys[a]
                    held.append(batch.slice(a, b - a))
        if held:
            found = compare(pa.Table.from_batches(held))
            if found is not None:
                yield found

    met = cut(map_arrow(full, stream, f"rep {key}, links long, low {key}"))
    # a block names one id per vector; two vectors of the same id are tied by that id itself
    tied = folded.select("rep").join(met.select(F.col("rep")).distinct(), "rep", "left_semi")
    graph = met.filter(F.col("rep") != F.col("low")).select("rep", "low").distinct()
    comp = connected_components(graph, "rep", "low").withColumnRenamed("node", "c_rep")
    links = tied.distinct().join(met.groupBy("rep").agg(F.sum("links").alias("links")), "rep").select(F.col("rep").alias("l_rep"), "links")
    per_vector = folded.join(links, F.col("rep") == F.col("l_rep"), "left").join(comp, F.col("rep") == F.col("c_rep"), "left")
    per_vector = cut(per_vector.select(F.col("label").alias("f_label"), F.col("vk").alias("f_vk"), F.col("v").alias("f_v"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                       F.coalesce("component", "rep").alias("found")))
    marked = rows.withColumn("vk", F.when(good, F.xxhash64("v")))
    out = marked.join(per_vector, (F.col("label") == F.col("f_label")) & (F.col("vk") == F.col("f_vk")) & (F.col("v") == F.col("f_v")), "left")
    comp_id = F.coalesce("found", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))


def near_duplicates_sql(table: str = "embeddings", threshold: float = 0.93) -> str:
    """The same as SQL, comparing all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= {threshold}),
r AS (SELECT vec_id AS node, vec_id AS seen FROM {table} UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT t.vec_id, coalesce(n.k, 0) AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM {table} t LEFT JOIN n ON n.a = t.vec_id JOIN c ON c.node = t.vec_id"""
