"""Registered queries; importing the package fills the registry."""

from linkloom.catalog import expansion, flows, ingest, lookups, networks, outputs, resolution, text  # noqa: F401
from linkloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
