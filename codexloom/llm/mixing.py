"""Mixing sources to target weights by Poisson replication.

Each document of a source is repeated a hash-seeded Poisson number of times, truncated
at the source's cap, whose mean is the source's repetition rate: its target share of the
mixture divided by its own size. The draw of a document inverts the distribution at a
uniform number hashed from its id, so it depends on nothing else and can be repeated.
The mixture is as large as the caps let every present source keep its target share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20_240_607


def source_name(c: Column) -> Column:
    """A source's name without differences of case, separators and outer blanks."""
    return F.regexp_replace(F.lower(F.btrim(c)), r"[\s\-_]+", "_")


def truncated_cdf(mean: float, cap: int) -> list[float]:
    """P(count <= i) for i < cap of the Poisson cut off at ``cap`` whose mean is ``mean``.

    The untruncated rate is found by bisection. A mean of 0 never repeats; one of
    ``cap`` (which no Poisson reaches) always repeats cap times.
    """
    if cap <= 0 or mean <= 0:
        return [1.0] * max(cap, 0)
    if mean >= cap * (1 - 1e-9):
        return [0.0] * cap

    def cdf(rate: float) -> list[float]:
        term, total, out = math.exp(-rate), 0.0, []
        for i in range(cap):
            total += term
            out.append(min(1.0, total))
            term *= rate / (i + 1)
        return out

    low, high = 0.0, 1.0
    while sum(1 - p for p in cdf(high)) < mean and high < 700:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        # The mean of a count is the sum of its tail probabilities.
        low, high = (mid, high) if sum(1 - p for p in cdf(mid)) < mean else (low, mid)
    return cdf((low + high) / 2)


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, float]]:
    """(share, rate) of each source that has tokens, a target and a cap.

    Targets of the other sources are spread in proportion. The mixture's size is the
    largest at which no rate exceeds its cap.
    """
    live = {s: (t, m) for s, (t, m) in targets.items() if totals.get(s, 0) > 0 and t and t > 0 and m and m > 0}
    whole = sum(t for t, _ in live.values())
    if not live:
        return {}
    size = min(m * totals[s] / (t / whole) for s, (t, m) in live.items())
    return {s: (t / whole, min(float(m), size * (t / whole) / totals[s])) for s, (t, m) in live.items()}


def draws(documents: DataFrame, rates: dict[str, tuple[float, int]], id_col: str, source_col: str, seed: int = SEED) -> DataFrame:
    """``documents`` of the sources in ``rates`` (rate, cap) with ``copies`` >= 0."""
    spark = documents.sparkSession
    rows = [(s, truncated_cdf(r, m)) for s, (r, m) in rates.items()]
    table = spark.createDataFrame(rows, "_src string, _cdf array<double>")
    # 53 bits of the hash make a uniform number in [0, 1).
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 11) / F.lit(float(1 << 53))
    keyed = documents.withColumn("_norm", source_name(F.col(source_col)))
    got = keyed.join(F.broadcast(table), F.col("_norm") == F.col("_src")).withColumn("_u", u)
    return got.withColumn("copies", F.size(F.filter("_cdf", lambda p: p <= F.col("_u")))).drop("_cdf", "_u", "_src")


def mixture(documents: DataFrame, rates: dict[str, tuple[float, int]], id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("text",), seed: int = SEED) -> DataFrame:
    """The mixture in random order: id, copy_no, source, ``columns``, shuffle_key.

    Copies are spread over all partitions by the hash of (id, copy) and ordered by it
    within each, so the order doesn't depend on the input's. A document that is delivered
    repeatedly is used once: its copies meet in one partition, where the least source and
    ``columns`` stay (in the columns' order, nulls first).
    """
    d = draws(documents, rates, id_col, source_col, seed).where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    d = d.select(id_col, "copy_no", F.col("_norm").alias("source"), *[c for c in columns], F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), "copy_no").alias("shuffle_key"))
    key = ["shuffle_key", id_col, "copy_no"]
    rest = [c for c in d.columns if c not in key]
    met = d.repartition(*key).groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return met.select(id_col, "copy_no", *[F.col(f"_r.{c}").alias(c) for c in rest], "shuffle_key").sortWithinPartitions(*key)


def shares(sizes: DataFrame, targets: DataFrame, rates: dict[str, tuple[float, int]], id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", seed: int = SEED) -> DataFrame:
    """One row per source of either side: targets, rate, and the share actually reached."""
    have = sizes.groupBy(source_name(F.col(source_col)).alias("source")).agg(F.sum(size_col).alias("tokens_available"), F.count(F.lit(1)).alias("documents"))
    out = draws(sizes, rates, id_col, source_col, seed).groupBy(F.col("_norm").alias("source")).agg(F.sum(F.col(size_col) * F.col("copies")).alias("tokens_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    total = out.agg(F.sum("tokens_used").alias("_all"))
    rate = sizes.sparkSession.createDataFrame([(s, float(r)) for s, (r, _) in rates.items()], "source string, mean_repeats double")
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = t.join(have, t["source"].eqNullSafe(have["source"]), "full").select(F.coalesce(t["source"], have["source"]).alias("source"), "target_share", "max_repeats", "tokens_available", "documents")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        both.join(F.broadcast(rate), "source", "left").join(out, "source", "left").crossJoin(F.broadcast(total))
        .select("source", "target_share", "max_repeats", zero("tokens_available"), zero("documents"), "mean_repeats", zero("copies"), zero("most_copies"), zero("tokens_used"), F.round(F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)), 6).alias("reached_share"))
    )


def solve(sizes: DataFrame, targets: DataFrame, source_col: str = "source", size_col: str = "n_tokens") -> dict[str, tuple[float, int]]:
    """(rate, cap) per source; one row per target reaches the driver."""
    t = {r.source: (r.share, r.cap) for r in targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect() if r.source}
    named = sizes.withColumn("_norm", source_name(F.col(source_col))).where(F.col("_norm").isin(*t))
    totals = {r._norm: r.n for r in named.groupBy("_norm").agg(F.sum(size_col).alias("n")).collect()}
    return {s: (rate, t[s][1]) for s, (_, rate) in plan(totals, t).items()}
