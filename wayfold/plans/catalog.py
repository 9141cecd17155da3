"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from . import decks, fields, meshes, requests, surfaces

QUERIES = {**fields.QUERIES, **meshes.QUERIES, **requests.QUERIES, **decks.QUERIES, **surfaces.QUERIES}
ORACLES = {**fields.ORACLES, **meshes.ORACLES, **requests.ORACLES, **decks.ORACLES, **surfaces.ORACLES}
