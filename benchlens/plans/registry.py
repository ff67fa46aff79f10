"""All acceptance queries and their DuckDB oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benchlens.plans import (compare_queries, corpus_queries, kmer_queries, pairwise_queries,
                             report_queries, source_queries, text_queries)

_MODULES = [compare_queries, kmer_queries, corpus_queries, text_queries, pairwise_queries,
            source_queries, report_queries]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
