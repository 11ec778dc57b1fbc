"""Problem 4 over the tables: questions joined to what was known of their gold nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators.asknown import join_as_known
from codexloom.runtime import table


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Each (question, gold node) once, however often the question was delivered."""
    q = table(spark, sf, "holdout_hard_set").select(F.col("id").alias("question_id"), "as_of", F.explode("gold").alias("node_id"))
    return q.distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    got = join_as_known(_asked(spark, sf), table(spark, sf, "effective"), [])
    return got.where("version_id IS NOT NULL").select("question_id", "node_id", "version_id")


def p4_as_known(spark: SparkSession, sf: str) -> DataFrame:
    """Every asked node with text and status as known then, nulls where nothing was."""
    return join_as_known(_asked(spark, sf), table(spark, sf, "effective"), ["text", "status", "citation"])


QUERIES = {"p4_found": p4_found, "p4_as_known": p4_as_known}

_KNOWN = """
WITH asked AS (SELECT DISTINCT id AS question_id, as_of, unnest(gold) AS node_id FROM holdout_hard_set),
v AS (SELECT DISTINCT version_id, node_id, text, status, citation, effective_date, recorded_at FROM effective),
k AS (SELECT a.question_id, a.node_id, a.as_of, v.version_id, v.text, v.status, v.citation,
    row_number() OVER (PARTITION BY a.question_id, a.node_id, a.as_of ORDER BY v.effective_date DESC, v.recorded_at DESC, v.version_id DESC) AS rk
  FROM asked a JOIN v ON v.node_id = a.node_id AND (a.as_of IS NULL OR (v.effective_date <= a.as_of AND CAST(v.recorded_at AS DATE) <= a.as_of)))
"""
ORACLE = {
    "p4_found": _KNOWN + "SELECT question_id, node_id, version_id FROM k WHERE rk = 1",
    "p4_as_known": _KNOWN
    + """SELECT a.question_id, a.as_of, a.node_id, k.version_id, k.text, k.status, k.citation
FROM asked a LEFT JOIN k ON k.question_id = a.question_id AND k.node_id = a.node_id AND k.as_of IS NOT DISTINCT FROM a.as_of AND k.rk = 1""",
}
