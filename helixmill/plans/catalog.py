"""Registry of the engine's own queries and of the SQL that states each of them independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "kmer_index_lca"


def load() -> None:
    """Fill the registry; importing the module of queries registers them."""
    from . import queries  # noqa: F401
