"""Named source readers and sinks, so that callers can add their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.ingest import SourceRef
from palimpsest.schema import conform

Reader = Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    """A source kind: ``read(spark, locator, **options)`` gives canonical messages."""

    name: str
    kind: str
    register: str
    label: str
    read: Reader


SOURCES: dict[str, Source] = {}
SINKS: dict[str, Callable[[SourceRef, DataFrame], DataFrame]] = {}


def register_source(name: str, kind: str = "", register: str = "text", label: str = ""):
    """Decorator: make a reader available under ``name``."""
    if not name:
        raise ValueError("a source needs a name")

    def add(read: Reader) -> Reader:
        SOURCES[name] = Source(name, kind or name, register, label or name, read)
        return read

    return add


def register_sink(name: str):
    """Decorator: make ``write(source_ref, messages) -> report`` available under ``name``."""

    def add(write):
        SINKS[name] = write
        return write

    return add


def read_source(spark: SparkSession, name: str, locator: str, **options) -> tuple[SourceRef, DataFrame]:
    """(reference, canonical messages) of a registered source; nothing is read yet."""
    source = SOURCES[name]
    rows = conform(source.read(spark, locator, **options))
    return SourceRef(source.kind, f"{source.label} {locator.rstrip('/').rsplit('/', 1)[-1]}", locator), rows


def run_import(spark: SparkSession, name: str, locator: str, sink: str, **options) -> DataFrame:
    """Read a source and hand it to a sink; returns the sink's report."""
    ref, rows = read_source(spark, name, locator, **options)
    return SINKS[sink](ref, rows)
