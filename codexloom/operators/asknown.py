"""Attributes as known at event time: periodic snapshots plus change logs.

A version counts for a day once it is both in effect and on record, that is from
``greatest(effective_date, day of recorded_at)``. Among the versions that count, the
latest effective date wins, then the latest record, then the highest version id. That
maximum only ever rises, so the state of a node at the start of a period (its
snapshot) and the changes inside the period give the state on any day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.runtime import skew_join

#: Length of a snapshot period. It bounds the days, and so the change rows and the
#: distinct event days, that meet in one (node, period).
PERIOD_DAYS = 90


def _period(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days).cast("int")


def change_log(versions: DataFrame, days: int = PERIOD_DAYS) -> DataFrame:
    """(node_id, period, day, state): the best version that began to count on each day.

    Versions without node or effective date never count; without record day they
    count for no dated event. Repeated deliveries collapse.
    """
    day = F.greatest(F.col("effective_date"), F.to_date("recorded_at"))
    return (
        versions.where("node_id IS NOT NULL AND effective_date IS NOT NULL AND recorded_at IS NOT NULL AND version_id IS NOT NULL")
        .select("node_id", day.alias("day"), F.struct("effective_date", "recorded_at", "version_id").alias("state"))
        .groupBy("node_id", "day").agg(F.max("state").alias("state"))
        .withColumn("period", _period(F.col("day"), days))
    )


def snapshots(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(node_id, period, state): each node's state at the start of each period that may be asked for.

    ``asked`` (node_id, low, high) bounds a node's periods. The window runs over one row per
    node and period with changes, never over single versions.
    """
    w = Window.partitionBy("node_id").orderBy("period")
    runs = (
        log.groupBy("node_id", "period").agg(F.max("state").alias("state"))
        .select("node_id", F.max("state").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("state"), (F.col("period") + 1).alias("first"), F.lead("period").over(w).alias("next"))
        .join(asked, "node_id")
        .select("node_id", "state", F.greatest("first", "low").alias("first"), F.least(F.coalesce("next", "high"), F.col("high")).alias("last"))
    )
    return runs.where("first <= last").select("node_id", F.explode(F.sequence("first", "last")).alias("period"), "state")


def as_known(events: DataFrame, versions: DataFrame, node: str = "node_id", as_of: str = "as_of", days: int = PERIOD_DAYS) -> DataFrame:
    """(node_id, as_of, version_id) for each distinct pair of ``events``.

    Pairs for which no version counts yield no row. A null ``as_of`` takes the best of
    all versions, recorded or not. Empty inputs give an empty result.
    """
    pairs = events.where(F.col(node).isNotNull()).select(F.col(node).alias("node_id"), F.col(as_of).alias("as_of")).distinct()
    asked = versions.join(pairs.select("node_id").distinct(), "node_id", "left_semi")
    dated = pairs.where("as_of IS NOT NULL").withColumn("period", _period(F.col("as_of"), days))
    log = change_log(asked, days)
    bounds = dated.groupBy("node_id").agg(F.min("period").alias("low"), F.max("period").alias("high"))
    held = dated.join(snapshots(log, bounds), ["node_id", "period"]).select("node_id", "as_of", "state")
    replayed = dated.join(log, ["node_id", "period"]).where("day <= as_of").select("node_id", "as_of", "state")
    newest = (
        asked.where("effective_date IS NOT NULL AND version_id IS NOT NULL")
        .groupBy("node_id").agg(F.max(F.struct("effective_date", "recorded_at", "version_id")).alias("state"))
    )
    open_ended = pairs.where("as_of IS NULL").join(newest, "node_id").select("node_id", "as_of", "state")
    best = held.unionByName(replayed).unionByName(open_ended).groupBy("node_id", "as_of").agg(F.max("state").alias("state"))
    return best.select("node_id", "as_of", F.col("state.version_id").alias("version_id"))


def join_as_known(events: DataFrame, versions: DataFrame, attributes: list[str], node: str = "node_id", as_of: str = "as_of", days: int = PERIOD_DAYS) -> DataFrame:
    """``events`` with ``version_id`` and the version's ``attributes`` as known then.

    Columns of ``events`` that share a name with an attribute keep it; the attribute
    comes as ``version_<name>``. Events without a known version keep a row of nulls.
    """
    names = {a: a if a not in events.columns else f"version_{a}" for a in ["version_id", *attributes]}
    known = as_known(events, versions, node, as_of, days)
    if attributes:
        rows = versions.groupBy("version_id").agg(*[F.max(a).alias(f"_v_{a}") for a in attributes])
        known = known.join(rows, "version_id", "left")
    known = known.select(F.col("node_id").alias("_k_node"), F.col("as_of").alias("_k_as_of"), F.col("version_id").alias(names["version_id"]), *[F.col(f"_v_{a}").alias(names[a]) for a in attributes])
    keyed = events.withColumns({"_k_node": F.col(node), "_k_as_of": F.col(as_of)})
    return skew_join(keyed, known, ["_k_node", "_k_as_of"], "left").drop("_k_node", "_k_as_of")
