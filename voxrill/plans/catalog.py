"""Importing this module fills the query catalogue."""

from voxrill.plans import (  # noqa: F401
    corpus_queries,
    fit_queries,
    history_queries,
    phone_queries,
    sequence_queries,
    session_queries,
    source_queries,
    stream_queries,
)
from voxrill.plans.registry import CHECK_SQL, COVERS, QUERIES  # noqa: F401
