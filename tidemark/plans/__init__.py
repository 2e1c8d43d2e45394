"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from tidemark.plans import align, checks, files, memory, p4, policy, surface, windows

    return (p4, memory, align, windows, checks, policy, files, surface)


def core_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.plans import memory

    return memory.knn_topk(spark, folder)
