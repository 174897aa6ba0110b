"""Resolution against brute force on random small data; results do not depend on order or partitioning."""

import itertools
import random

import pytest

from linkloom.operators import matching as M
from linkloom.operators.components import connected_components
from linkloom.operators.resolve import clusters, resolve_all
from linkloom.sinks import export as B

SCHEMA = "entity_type string, entity_key string, source_db string, id_type string, id_value string, n long"


def make(seed, types, n=60, values=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        for t in types:
            for _ in range(rnd.choice([0, 1, 1, 2])):
                rows.append(("x", f"e{i:03d}", "s", t, f"v{rnd.randrange(values)}", 1))
    return rows


def brute(rows, cfg):
    """Components over all matching pairs, with the score written out."""
    ids = {}
    for _, e, _, t, v, _ in rows:
        ids.setdefault(e, {}).setdefault(t, set()).add(v)
    parent = {e: e for e in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        score, seen, hit = 0, 0, 0
        for r in cfg.rules:
            x, y = ids[a].get(r.id_type, set()), ids[b].get(r.id_type, set())
            if x and y:
                score += r.gain if x & y else -r.penalty
                if r.absolute:
                    seen += 1
                    hit += bool(x & y)
        if score >= cfg.threshold or (cfg.use_absolute and seen and seen == hit):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {e: root(e) for e in ids}


@pytest.mark.parametrize("seed,absolute", [(1, True), (2, False), (3, False)])
def test_blocks_equal_brute_force(spark, seed, absolute):
    rules = (M.Rule("a"), M.Rule("b", 2.0, 0.5), M.Rule("c"), M.Rule("d", 0.5, 0.0, absolute=False))
    cfg = M.MatchConfig(rules, 3, use_absolute=absolute, hmdb_type=None)
    rows = make(seed, "abcd", values=12)
    got = clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), cfg)
    assert {r.entity_key: r.cluster_key for r in got.collect()} == brute(rows, cfg)


@pytest.mark.parametrize("kind", ["compound", "gene", "protein"])
def test_default_rules_equal_brute_force(spark, kind):
    """All types of a default rule set, two values each, one value held by a third of all entities."""
    cfg, rnd = M.DEFAULTS[kind], random.Random(kind)
    rows = []
    for i in range(50):
        for t in [r.id_type for r in cfg.rules if r.id_type not in ("single_ec", "hmdb")]:
            for _ in range(2):
                if rnd.random() < 0.9:
                    rows.append((kind, f"e{i:03d}", "s", t, "hot" if t == "pubchem" and i % 3 == 0 else f"v{rnd.randrange(60)}", 1))
    got = clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), cfg)
    assert {r.entity_key: r.cluster_key for r in got.collect()} == brute(rows, cfg)


def test_hot_value_stays_linear(spark):
    """Two thirds of the entities are copies that share every value: links are counted, not pairs."""
    rows = [("x", f"e{i:04d}", "s", t, "hot" if i % 3 else f"{t}{i}", 1) for i in range(600) for t in "abc"]
    cfg = M.MatchConfig(tuple(M.Rule(t) for t in "abc"), 3, hmdb_type=None)
    links = M.match_links(M.features(spark.createDataFrame(rows, SCHEMA), cfg), cfg)
    assert links.count() < 600


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("q", None)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["q"] == "q" and got["n100"] == "n000"
    back = connected_components(spark.createDataFrame([(b, a) for a, b in edges if b], "src string, dst string"))
    assert {r.node: r.component for r in back.collect()} == {k: v for k, v in got.items() if k != "q"}


def test_components_with_hubs(spark):
    """Hubs that are linked to each other, from both ends, with loops and repeated links, against union-find."""
    rnd = random.Random(4)
    hubs = [5000, 1, 2500, 9000]
    edges = [(h, rnd.randrange(10000)) for h in hubs for _ in range(1500)] + [(rnd.randrange(10000), h) for h in hubs[:2] for _ in range(500)]
    edges += [(rnd.randrange(20000, 26000), rnd.randrange(20000, 26000)) for _ in range(2500)] + [(5000, 1), (5000, 1), (7, 7), (30001, None), (30002, 30002)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        x, y = find(a), find(a if b is None else b)
        root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


EDGE = "edge_type string, src_key string, dst_key string, source_db string"
PART = "reaction_key string, side string, pos int, stoich int, stoich_raw string, compound_key string"
REACTION = "reaction_key string, direction string"


def test_gene_and_protein_with_the_same_key(spark):
    xref = spark.createDataFrame([("gene", "X1", "h", "uniprot", "U1", 1), ("protein", "X1", "h", "uniprot", "U1", 1)], SCHEMA)
    edge = spark.createDataFrame([("gp", "X1", "X1", "h")], EDGE)
    got = resolve_all(xref, edge, spark.createDataFrame([], PART), reaction=spark.createDataFrame([], REACTION))
    assert {(r.entity_type, r.n) for r in got["xref"].collect()} == {("gene", 1), ("protein", 1)}
    ids = B.dense_ids(got["xref"])
    kv = B.entity_kv(got["xref"], got["edge"], got["participant"], got["reaction"], ids)
    assert {tuple(r) for r in kv.collect()} == {("gene", "0", "uniprot", "U1"), ("protein", "1", "uniprot", "U1"), ("gene", "0", "proteins_connected", "1")}


@pytest.mark.parametrize(("said", "want"), [("<=", "c1 => c2"), (None, "c1 => c2")])
def test_merged_reactions_keep_the_equation_of_one_member(spark, said, want):
    rows = [("reaction", r, "k", t, "R", 1) for r in ("r0", "r1") for t in ("kegg", "reaction_str")] + [("compound", c, "k", "kegg", c, 1) for c in ("c1", "c2")]
    part = spark.createDataFrame([("r1", "left", 0, 1, "", "c1"), ("r1", "right", 0, 1, "", "c2")], PART)
    reaction = spark.createDataFrame([("r1", "=>")] + ([("r0", said)] if said else []), REACTION)
    got = resolve_all(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], EDGE), part, reaction=reaction)
    kv = B.entity_kv(got["xref"], got["edge"], got["participant"], got["reaction"])
    assert [(r.internal_id, r.v) for r in kv.filter("k = 'reaction_compounds'").collect()] == [("r0", want)]
