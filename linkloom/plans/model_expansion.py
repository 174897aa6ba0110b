"""Expansion of a base model with an annotated network, and the report on what it gained."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkloom.operators import network as N
from linkloom.session import cut


def expand_model(model_participant: DataFrame, model_species: DataFrame, compounds: DataFrame, participant: DataFrame,
                 new_reactions: DataFrame, stoplist: DataFrame | None = None, only_connected: bool = False) -> dict[str, DataFrame]:
    """Add the reactions the model lacks, then compare dead ends and components before and after."""
    mapping = cut(N.match_species(compounds, model_species))
    fresh = N.reactions_not_in_model_by_participants(new_reactions, participant, mapping, model_participant)
    parts = participant.join(fresh.select("reaction_key"), "reaction_key", "left_semi")
    base = cut(N.model_network(model_participant))
    grown, rejected = N.expanded_network(base, parts, mapping, stoplist, only_connected)
    grown = cut(grown)
    return {
        "base": base, "expanded": grown, "rejected": rejected, "sif": N.sif_expansion(base, grown),
        "dead_ends": N.compare_dead_ends(base, grown), "base_report": N.network_report(base), "expanded_report": N.network_report(grown),
    }
