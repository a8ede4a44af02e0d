"""Queries and check SQL of the corpus operators, collected from their modules."""

from __future__ import annotations

from voxrill.llm import (  # noqa: F401
    archive, chat, fingerprints, linededup, merkle, middles, mixing, neighbours, pieces, quality, registry, simhash, substrings, toxicity,
)

QUERIES = registry.QUERIES
CHECK_SQL = registry.CHECK_SQL
