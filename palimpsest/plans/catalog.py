"""All registered queries."""

from palimpsest.plans import (  # noqa: F401
    corpus_queries,
    evaluation_queries,
    index_queries,
    memory_queries,
    search_queries,
    source_queries,
    stream_queries,
    text_queries,
    training_queries,
)
from palimpsest.plans.registry import ORACLES, QUERIES  # noqa: F401
