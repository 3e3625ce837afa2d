"""Registered queries of the engine's operators."""

from . import building, cards, catalogues, ingest, networks, parcels, queries, shapes, suitability  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
