"""Readers that turn files and exported tables into canonical messages."""

from palimpsest.sources import (  # noqa: F401
    batches,
    chat_export,
    commit_log,
    data_package,
    documents,
    mail,
    stores,
)
from palimpsest.sources.registry import (  # noqa: F401
    SINKS,
    SOURCES,
    read_source,
    register_sink,
    register_source,
    run_import,
)
