"""All queries of the engine, apart from the optional training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexloom.plans import answers, asknown, audit, citations, evalset, graph, retrieval, temporal, texts

MODULES = [asknown, graph, temporal, texts, retrieval, answers, citations, audit, evalset]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answer_context(spark, sf_dir)
