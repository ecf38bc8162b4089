"""The library's registered queries, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meetlake.plans import directory, edits, index, letters, library, notes, passages, people, retrieval, search, streaming, timeline

FLAGSHIP = "hybrid_rrf_top3"

PARTS = (retrieval, timeline, passages, notes, people, streaming, edits, library, directory, index, search, letters)


def registered(parts=PARTS) -> dict:
    """The queries of all parts; a name that two of them have is an error."""
    found: dict = {}
    for part in parts:
        if twice := found.keys() & part.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= part.QUERIES
    return found


_ALL = registered()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
