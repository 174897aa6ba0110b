"""A spread of registered queries against their SQL on the smallest tables."""

import pytest

from linkloom.catalog import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["expand_prc", "expand_mixed", "reached_network", "ec_extract", "equation_align_ids", "main_id", "chebi_fallback", "name_search",
        "resolve_sparse", "candidate_search", "participant_resolution", "expanded_network", "dead_end_diff", "components", "same_reaction",
        "organism_metabolites", "seed_validation", "reaction_records", "hmdb_reaction_pages", "entity_round_trip", "network_sif", "dense_ids",
        "shared_keys", "shared_key_nodes", "seeds_over_time", "organism_proteins", "model_filters", "equation_sides", "equation_standardize",
        "reaction_record_ids"]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", ["resolve_protein_default", "resolve_reaction_default", "annotate_flow"])
def test_flow(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok and not message.startswith("0 rows"), message
