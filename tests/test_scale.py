"""Steps whose cost must follow the input: wide pages, pages in one split, pairs that share common ids."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.catalog import roles
from linkloom.functions.equations import equation_sides
from linkloom.operators import components as C
from linkloom.operators import expand
from linkloom.operators import lookup as L
from linkloom.operators import matching as M
from linkloom.operators import network as N
from linkloom.operators import property_graph as G
from linkloom.operators import samples as S
from linkloom.sinks.export import entity_kv, sif_organisms
from linkloom.sources import pages as P


def test_table_head_is_read_once_per_page(spark):
    """The head of a table is an expression over the whole page; above the generator it would run for each row."""
    page = "<table><thead><tr><th>HMDBP ID</th><th>Type</th></tr></thead>" + "".join(f"<tr><td>P{i}</td><td>Enzyme</td></tr>" for i in range(30)) + "</table>"
    df = spark.createDataFrame([("a", page), ("b", None)], "page_id string, html string")
    plan = P.extract_table(df)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "<th" not in above and "<th" in below
    assert sorted(map(tuple, P.rows_of_type(P.extract_table(df)).collect())) == sorted(("a", f"P{i}") for i in range(30))


def test_pages_of_one_split_are_parsed_by_many_tasks(spark):
    html = "<table><tr><th>Name</th><td>x</td></tr></table>"
    df = spark.createDataFrame([(str(i), html) for i in range(40)], "page_id string, html string").coalesce(1)
    got = P.extract_boxes(df, ["Name"])
    assert got.rdd.getNumPartitions() > 1
    assert got.count() == 40


def _brute(left, right):
    return {(a, b) for a, i in left if i is not None for b, j in right if i == j}


def _sharing(spark, left, right):
    return S.pairs_sharing(spark.createDataFrame(left, "left string, i string"), spark.createDataFrame(right, "right string, i string"), ["i"])


def test_pairs_by_common_and_by_rare_ids(spark):
    """Pairs meet through common ids, rare ones, both or several; keys may be null and rows may repeat."""
    left = [(f"s{k}", "hub") for k in range(40)] + [(f"s{k}", f"mid{k % 3}") for k in range(60)] + [(f"s{k}", f"own{k}") for k in range(70)]
    right = [(f"p{k}", "hub") for k in range(30)] + [(f"p{k}", f"mid{k % 4}") for k in range(50)] + [(f"p{k}", f"own{k}") for k in range(60)]
    left += [("s1", "hub"), ("s2", None), (None, "mid1"), (None, "own3"), (None, "hub")]
    right += [("p1", "hub"), ("p9", None), (None, "mid2"), (None, "own5"), ("p5", "own60"), ("p44", "own60")]
    pairs = _sharing(spark, left, right)
    rows = [tuple(r) for r in pairs.rows("a", "b").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _brute(left, right)
    assert pairs.count().collect()[0].n == len(rows)
    keys = spark.createDataFrame([(f"p{k}",) for k in range(20, 55)], "right string")
    some = pairs.keep_right(keys, "left_semi")
    wanted = {r for r in rows if r[1] in {f"p{k}" for k in range(20, 55)}}
    assert {tuple(r) for r in some.rows("a", "b").collect()} == wanted and some.count().collect()[0].n == len(wanted)
    assert {r.right for r in some.right_keys().collect()} == {b for _, b in wanted}
    assert {r.right for r in pairs.keep_right(keys, "left_anti").right_keys().collect()} == {b for _, b in rows} - {f"p{k}" for k in range(20, 55)}


def test_keys_with_an_id_of_their_own_still_meet_as_sets(spark):
    """Every key holds the common id and one of its own: 160,000 pairs, of which no table holds more than a row for each key."""
    left = [(f"k{k}", i) for k in range(400) for i in ("hub", f"own{k}")]
    right = [(f"k{k}", i) for k in range(400) for i in ("hub", f"own{k}")]
    pairs = _sharing(spark, left, right)
    assert pairs.sets.count() == 1 and pairs.few.count() == 0
    assert pairs.count().collect()[0].n == pairs.rows("a", "b").distinct().count() == 160_000


def test_large_sets_are_cut_into_pieces(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("left"), F.lit(1).alias("lset"))
    got = S._pieces(keys, "lset", "left")
    assert got.count() == 5 and got.agg(F.max(F.size("left"))).collect()[0][0] < 2 * S.PIECE
    assert got.select(F.explode("left")).distinct().count() == 5000


def test_filters_take_pairs_of_sets(spark):
    ann = spark.createDataFrame([(f"S{k}", "enzyme_ec", f"1.1.1.{k % 2}") for k in range(30)], "sample string, id_type string, id_value string")
    ids = spark.createDataFrame([(f"P{k}", "enzyme_ec", f"1.1.1.{k % 3}") for k in range(36)], "protein_key string, id_type string, id_value string")
    edge = spark.createDataFrame([("pr", f"P{k}", f"R{k % 4}") for k in range(20)], "edge_type string, src_key string, dst_key string")
    model = spark.createDataFrame([("enzyme_ec", "1.1.1.1")], "id_type string, id_value string")

    def stages(expand):
        h1 = N.proteins_in_sample(ids, ann, expand=expand)
        h2 = N.with_reaction(h1, edge)
        h3 = N.proteins_not_in_model(h2, ids, model)
        return {"a": h1, "b": h2, "c": h3, "d": N.reactions_of(h3, edge)}

    plain, folded = stages(True), stages(False)
    assert sorted(map(tuple, N.funnel(plain).collect())) == sorted(map(tuple, N.funnel(folded).collect()))
    assert plain["c"].count() > 0 and sorted(plain["c"].select("sample", "protein_key").collect()) == sorted(folded["c"].rows("sample", "protein_key").collect())
    assert sorted(plain["d"].collect()) == sorted(folded["d"].collect())


def test_sif_of_pairs_is_not_made_distinct_again(spark):
    linked = spark.createDataFrame([("R1", "C1"), ("R1", "C1")], "reaction_key string, compound_key string")
    rp = spark.createDataFrame([("R1", "P1")], "reaction_key string, protein_key string")
    ann = spark.createDataFrame([(f"S{k}", "t", "v") for k in range(20)], "sample string, id_type string, id_value string")
    pa = spark.createDataFrame([(f"P{k}", "t", "v") for k in range(20)], "protein_key string, id_type string, id_value string")
    folded = sif_organisms(linked, rp, S.organism_proteins(pa, ann, expand=False))
    assert sorted(folded.collect()) == sorted(sif_organisms(linked, rp, S.organism_proteins(pa, ann)).collect())
    assert folded.count() == 402
    assert "Aggregate" not in folded._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0].split("Union")[0]


def test_protein_links_meet_reactions_as_sets(spark):
    proteins = spark.createDataFrame([(f"P{k}",) for k in range(30)] + [("P1",)], "protein_key string")
    x = spark.createDataFrame([("protein", f"P{k}", t, v) for k in range(40) for t, v in (("gene_ids", "g"), ("intermediate_reaction_ids", "b"), ("intermediate_reaction_ids", f"c{k}"))],
                              "entity_type string, entity_key string, id_type string, id_value string")
    bridge = spark.createDataFrame([("b", f"R{k}") for k in range(20)] + [(f"c{k}", f"R{k}") for k in range(60)], "bridge_id string, reaction_key string")
    rx = spark.createDataFrame([(f"R{k}", "enzyme_ec", f"1.1.1.{k % 7}") for k in range(25)], "entity_key string, id_type string, id_value string")
    got = [tuple(r) for r in L.protein_links(proteins, x, bridge, rx).collect()]
    pr = {(p, f"R{r}") for p in (f"P{k}" for k in range(30)) for r in range(20)} | {(f"P{k}", f"R{k}") for k in range(30)}
    want = {(f"P{k}", "gene", "g") for k in range(30)} | {(p, "reaction", r) for p, r in pr} | {
        (p, "enzyme_ec", f"1.1.1.{int(r[1:]) % 7}") for p, r in pr if int(r[1:]) < 25}
    assert len(got) == len(set(got)) and set(got) == want


def test_sides_of_a_costly_equation_are_read_once(spark):
    """The expression that makes the equation stands once in the plan."""
    df = spark.createDataFrame([("a", "b <=> c"), ("a + d", "e"), (None, "x")], "l string, r string")
    got = df.select(equation_sides(F.concat("l", F.lit(" => "), "r")).alias("s")).select("s.sign", "s.reversible", "s.left", "s.right")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("concat(") == 1
    assert [tuple(r) for r in got.collect()] == [("<=>", True, ["a => b"], ["c"]), ("=>", False, ["a", "d"], ["e"]), (None, None, None, None)]


def _components(rows):
    near = {}
    for a, b in rows:
        if a is not None:
            near.setdefault(a, set())
        if b is not None:
            near.setdefault(b, set())
        if a is not None and b is not None:
            near[a].add(b), near[b].add(a)
    out = {}
    for node in sorted(near):
        todo = [] if node in out else [node]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = node
                todo += near[x]
    return out


def test_components_of_texts_are_contracted_as_numbers(spark, monkeypatch):
    """Chains, a hub with a third of the nodes, isolated nodes, nulls, loops and repeats; no round moves a text."""
    rows = [(f"n{k}", f"n{k + 1}") for k in range(0, 90) if k % 10] + [("hub", f"h{k}") for k in range(60)] + [(f"i{k}", None) for k in range(5)]
    rows += [("n5", "n5"), ("hub", "h1"), (None, "z"), ("a", "hub"), ("\u00e9", "x")]
    kinds, star = [], C._star_large
    monkeypatch.setattr(C, "_star_large", lambda e, n: (kinds.append(dict(e.dtypes)["u"]), star(e, n))[1])
    got = [tuple(r) for r in C.connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _components(rows)
    assert set(kinds) == {"bigint"}


def test_components_of_texts_whose_hashes_clash(spark, monkeypatch):
    rows = [("a", "b"), ("c", "d"), ("d", "e"), ("f", None)]
    monkeypatch.setattr(C.F, "xxhash64", lambda *cols: F.length(cols[0]).cast("bigint"))
    got = dict(tuple(r) for r in C.connected_components(spark.createDataFrame(rows, "src string, dst string")).collect())
    assert got == _components(rows)


def test_pairs_of_masks_are_rows_not_arrays(spark):
    """Pairs of masks within a group were decided inside one expression over arrays, up to the square of the masks for each row."""
    cfg = M.MatchConfig(tuple(M.Rule(t) for t in "abcd"), 3, hmdb_type=None)
    blocks = spark.createDataFrame([(1, "g", m, f"e{m}", 2) for m in (1, 3, 7, 15)], "o_mask int, key string, mask int, rep string, c long")
    told = M._open_masks(blocks, cfg)
    assert "lambda" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert {r.mask for r in told.collect()} == {3, 7, 15}


def test_values_of_an_entity_are_dealt_once(spark):
    """What is asked of each entity (mask, digests, first row) needs no shuffle beside that of its distinct values."""
    cfg = M.MatchConfig(tuple(M.Rule(t) for t in "ab"), 2, hmdb_type=None)
    rows = [("x", f"e{i}", "s", t, f"{t}{i // 2}", 1) for i in range(6) for t in "ab"]
    feats = M.features(spark.createDataFrame(rows, "entity_type string, entity_key string, source_db string, id_type string, id_value string, n long"), cfg)
    assert M.masks(feats)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {tuple(r) for r in M.match_links(feats, cfg).collect()} == {("e1", "e0"), ("e3", "e2"), ("e5", "e4")}


def test_network_of_annotations_is_written_once(spark):
    """Whoever reads the chosen nodes must not walk the relations again."""
    kv = spark.createDataFrame([("protein", "P1", "enzyme_ec", "1.1.1.1"), ("protein", "P1", "reactions_connected", "R1"), ("reaction", "R1", "kegg", "R"),
                                ("gene", "G1", "proteins_connected", "P1"), ("gene", "G2", "synonyms", "x")], "entity_type string, internal_id string, k string, v string")
    ann = spark.createDataFrame([("enzyme_ec", "1.1.1.1")], "id_type string, id_value string")
    chosen = G.network_from_annotations(ann, G.property_nodes(kv), G.property_id_nodes(kv)[1], G.property_rels(kv))
    assert "Join" not in chosen._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in chosen.collect()} == {("P1", "Protein"), ("R1", "Reaction"), ("G1", "Gene")}


def test_links_are_not_dealt_by_their_type(spark, monkeypatch):
    """Links have few types and modes: a shuffle by these would gather all links in as many tasks."""
    plans, cut = [], expand.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(expand, "cut", lambda df: plans.append(plan(df)) or cut(df))
    edge = spark.createDataFrame([("gp", "G1", "P1"), ("pr", "P1", "R1"), ("rp", "R1", "P2"), ("pg", "P2", "G2"), ("gp", "G2", "P3")], "edge_type string, src_key string, dst_key string")
    seeds = spark.createDataFrame([("global", "gene", "G1")], "mode_key string, node_type string, node_key string")
    modes = expand.mode_edges(spark, ["global"])
    got = expand.expand(seeds, edge, modes)
    assert {r.node_key for r in got.collect()} == {"G1", "P1", "R1", "P2", "G2", "P3"}
    plans.append(plan(expand.reached_edges(got, seeds, edge, modes)))
    assert not [p for p in plans if re.search(r"hashpartitioning\(((mode_key|edge_type|src_type|node_type)#\d+, )+\d+\)", p)]


def test_tasks_take_bounded_input(spark):
    """The session's own sizes stay; Spark's defaults give way."""
    from linkloom.session import bound_tasks

    name, other = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(name)
    spark.conf.unset(name)
    spark.conf.set(other, "5m")
    bound_tasks(spark)
    assert spark.conf.get(name) == "16m" and spark.conf.get(other) == "5m"
    spark.conf.set(name, kept)
    spark.conf.unset(other)


def _without(spark, settings, look):
    """What ``look`` gives while ``settings`` hold."""
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return look()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keys_of_pairs_are_dealt_after_their_union(spark):
    """Both parts of the union are dealt by their key; adaptive execution may deal them anew, so a join above must not rely on it."""
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    left, right = [(f"s{k}", "hub") for k in range(20)] + [("s1", "own")], [(f"p{k}", "hub") for k in range(20)] + [("p1", "own"), ("q", "own")]
    pairs = _sharing(spark, left, right)
    keys = spark.createDataFrame([(f"p{k}",) for k in range(10)] + [("q",)], "right string")
    settings = {"spark.sql.adaptive.enabled": "false"}  # the plan as it is made first; sets are small, the keys' size is not known

    def look():
        found = pairs.keep_right(keys, "left_semi").right_keys()
        return found._jdf.queryExecution().executedPlan().toString(), {r.right for r in found.collect()}

    plan, found = _without(spark, settings, look)
    assert "Exchange hashpartitioning(right" in plan.split("Union")[0]
    assert found == {f"p{k}" for k in range(10)} | {"q"}


def test_generated_code_spreads_one_side_of_pairs_only(spark):
    """It holds all rows of an input row: with both sides spread there, a million for two pieces."""
    pairs = _sharing(spark, [(f"s{k}", "hub") for k in range(20)], [(f"p{k}", "hub") for k in range(20)])
    plan = _without(spark, {"spark.sql.adaptive.enabled": "false"}, lambda: pairs.rows("a", "b")._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Generate explode") == 2 and len(re.findall(r"\*\(\d+\) Generate explode", plan)) == 1
    assert pairs.rows("a", "b").distinct().count() == 400


def test_a_round_of_components_makes_its_edges_once(spark):
    """All who read the large star's edges and the minima must find the same plan, or these are made and dealt again."""
    e = spark.createDataFrame([(f % 7, f % 5) for f in range(40)], "u long, v long")

    def look():
        first = C._toward_smaller(C.cut(e))
        return C._star_small(C._star_large(first, 40), 40)._jdf.queryExecution().executedPlan().toString()

    plan = _without(spark, {"spark.sql.adaptive.enabled": "false"}, look)
    # by node for the minima of both stars, by edge for their results; the joins of so few rows are broadcast
    assert [len(re.findall(rf"(?<!Reused)Exchange hashpartitioning\({k}", plan)) - len(re.findall(rf"ReusedExchange [^\n]*hashpartitioning\({k}", plan))
            for k in (r"u#\d+L, \d", r"u#\d+L, v#")] == [2, 2]


def test_component_sizes_give_no_node_a_name(spark):
    rows = [(f"R_{k}", f"M_{k % 17}_c") for k in range(60)] + [(f"R_{k}", f"M_{k}_e") for k in range(100, 104)] + [("R_1", "R_1"), ("M_x_c", None), (None, "M_y_c")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    sizes = N.component_sizes(edges)
    want = {}
    for node, at in _components(rows).items():
        want.setdefault(at, [0, 0])[node.startswith("R")] += 1
    assert {(r.component, r.n_compounds, r.n_reactions) for r in sizes.collect()} == {(at, a, b) for at, (a, b) in want.items()}
    assert "min(node" not in N.size_histogram(sizes)._jdf.queryExecution().optimizedPlan().toString()


def test_participants_are_dealt_once(spark, tmp_path):
    """Amounts, positions and equations of a reaction are made where its lines were dealt to."""
    rows = [(1, 7, 1, 2.0), (1, 7, 3, 3.0), (1, 5, 1, 1.0), (1, 9, 2, 4.0), (2, 7, 2, 1.0), (None, 3, 1, 1.0), (None, None, 1, 2.0), (3, 4, None, 5.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")

    def look():
        p = roles.participants(spark, str(tmp_path))
        listed = p.groupBy("reaction_key").agg(F.collect_list("compound_key"))
        return listed._jdf.queryExecution().executedPlan().toString(), sorted((tuple(r) for r in p.drop("stoich_raw").collect()), key=str)

    plan, got = _without(spark, {"spark.sql.adaptive.enabled": "false"}, look)
    assert plan.count("Exchange hashpartitioning") == 1
    assert got == sorted([("R1", "left", 0, 1, "C5"), ("R1", "left", 1, 5, "C7"), ("R1", "right", 0, 4, "C9"), ("R2", "right", 0, 1, "C7"),
                          (None, "left", 0, 2, None), (None, "left", 1, 1, "C3"), ("R3", "right", 0, 5, "C4")], key=str)


def test_fields_are_made_distinct_once(spark):
    x = spark.createDataFrame([("protein", "P1", "s", "synonyms", "a", 1)] * 2, "entity_type string, entity_key string, source_db string, id_type string, id_value string, n long")
    e = spark.createDataFrame([("pr", "P1", "R1", "a"), ("pr", "P1", "R1", "b")], "edge_type string, src_key string, dst_key string, source_db string")
    p = spark.createDataFrame([("R1", "left", 0, 2, "", "C1")], "reaction_key string, side string, pos int, stoich int, stoich_raw string, compound_key string")
    r = spark.createDataFrame([("R1", "=>")], "reaction_key string, direction string")
    got = entity_kv(x, e, p, r)
    assert sorted(map(tuple, got.collect())) == [("protein", "P1", "reactions_connected", "R1"), ("protein", "P1", "synonyms", "a"),
                                                 ("reaction", "R1", "reaction_compounds", "C1 => "), ("reaction", "R1", "stoichiometry", "2")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # of equations, and this


def test_plain_pages_are_read_without_the_parser(monkeypatch):
    """Pages of plain tags are most; whatever is not plain is left to the parser, with the same elements and texts."""
    bits = ["<td>", "</td>", "<TD class='a>b' x>", "<a href=\"/r?a=1&b=<2>\">", "</a >", "<br>", "<br/>", "<b />", "<td a=b>", "<td a=b/>", "x", " y ", "&amp;", "&lt", "&#65;", "&#6", "<", "< td>", "</", "</ td>",
            "</td x>", "<!-- <td> -->", "<!x>", "<?p>", "<script>", "</script>", "<title>", "a<b", "\n", "<t\u00e9>", "<td\u00a0x>", "<td x='1'y>", "<td x = '1'>", ">", "<td", "'", "\u00e9", "&", "<nobr>", "</nobr>"]
    rng, plain = random.Random(5), 0
    for _ in range(6000):
        html = "".join(rng.choices(bits[:8] + bits[10:14] if rng.random() < 0.5 else bits, k=rng.randint(0, 9)))
        a, b = P._Outline(), P._Outline()
        a.read(html)
        b.feed(html)
        b.close()
        assert (a.pieces, a.elements, a.stack) == (b.pieces, b.elements, b.stack), html
        plain += P._Outline()._read_plain(html)
    assert plain > 1500
    monkeypatch.setattr(P._Outline, "feed", lambda self, html: pytest.fail("the parser was asked"))
    page = "<html><body><table><tr><th><nobr>Name</nobr></th><td>a &lt;=&gt; b;<br>\nc</td></tr><tr><th>Other DBs</th><td><table><tr><td>CAS:</td><td valign='top'>1</td></tr></table></td></tr></table></body></html>"
    assert list(P._page_boxes(page, {"Name", "Other DBs"})) == [("Name", 0, "a <=> b;\nc", []), ("Other DBs", 0, "CAS:1", ["CAS:", "1"])]
