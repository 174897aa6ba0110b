"""Model expansion on a hand-made network."""

from linkloom.plans.model_expansion import expand_model

PARTS = "reaction_key string, side string, compound_key string"
IDS = "entity_key string, id_type string, id_value string"


def test_expand_model(spark):
    model = spark.createDataFrame([("R_1", "left", "M_a_c"), ("R_1", "right", "M_b_c")], PARTS)
    species = spark.createDataFrame([("M_a_c", "kegg", "C1"), ("M_b_c", "kegg", "C2")], IDS)
    compounds = spark.createDataFrame([("c1", "kegg", "C1"), ("c2", "kegg", "C2"), ("c3", "kegg", "C3")], IDS)
    # r1 is R_1 read backwards, r2 uses up b and gives c3
    parts = spark.createDataFrame([("r1", "left", "c2"), ("r1", "right", "c1"), ("r2", "left", "c2"), ("r2", "right", "c3"), ("r2", "right", "c1")], PARTS)
    new = spark.createDataFrame([("r1",), ("r2",)], "reaction_key string")
    got = expand_model(model, species, compounds, parts, new)
    assert {(r.src, r.dst) for r in got["expanded"].collect()} == {
        ("M_a_c", "R_1"), ("R_1", "M_b_c"), ("M_b_c", "RD_r2"), ("RD_r2", "c3"), ("RD_r2", "M_a_c")}
    row = got["dead_ends"].first()
    assert (row.base_dead_ends, row.expanded_dead_ends, row.newly_connected) == (2, 1, 2)
    assert {r.EXPANSION for r in got["sif"].collect()} == {0, 1}
    assert got["expanded_report"].first()["n_components"] == 1
