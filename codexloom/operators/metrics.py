"""Deterministic measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def related(a: Column, b: Column) -> Column:
    """Equal, or one is an ancestor of the other in a section's numbering."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("("))) | F.startswith(b, F.concat(a, F.lit("(")))


def hierarchical(gold: Column, found: Column) -> tuple[Column, Column]:
    """Recall over gold and precision over found, by related ids; recall null without gold."""
    hit_g = F.size(F.filter(gold, lambda g: F.exists(found, lambda c: related(g, c))))
    hit_f = F.size(F.filter(found, lambda c: F.exists(gold, lambda g: related(g, c))))
    recall = F.when(F.size(gold) > 0, hit_g / F.size(gold))
    return recall, F.when(F.size(found) > 0, hit_f / F.size(found)).otherwise(0.0)


def exact_recall(gold: Column, found: Column) -> Column:
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, found)) / F.size(F.array_distinct(gold))).otherwise(1.0)


def ranking(gold: Column, ranked: Column, k: int = 10) -> dict[str, Column]:
    """recall, mrr and ndcg at k of distinct ranked ids against gold, binary gains."""
    g, top = F.array_distinct(gold), F.slice(F.array_distinct(ranked), 1, k)
    hits = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(g, x), i + 1)), lambda r: r.isNotNull())
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    n = F.least(F.size(g), F.lit(k))
    ideal = F.when(n > 0, gain(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).otherwise(0.0)
    return {
        "recall": F.when(F.size(g) > 0, F.size(hits) / F.size(g)).otherwise(0.0),
        "mrr": F.when(F.size(hits) > 0, 1 / F.array_min(hits)).otherwise(0.0),
        "ndcg": F.when(ideal > 0, gain(hits) / ideal).otherwise(0.0),
    }


def kappa(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Cohen's kappa of two boolean raters; null where chance agreement is whole."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(F.col(a).cast("double")).alias("_a"), F.avg(F.col(b).cast("double")).alias("_b"))
    pe = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return g.select(*by, "n", "agreement", F.when(pe < 1, F.round((F.col("agreement") - pe) / (1 - pe), 3)).alias("kappa"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of complete pairs; null below three or without variance."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return g.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.round("c", 6)).alias("pearson"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, p50 (the upper median) and p95 (by half-even rank) of each group.

    Equal values are counted first, so the window that finds the ranks runs over
    distinct values and not over rows.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    c = c.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("n", F.sum("_c").over(w))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    p95 = F.least(F.col("n") - 1, F.bround(F.col("n") * 0.95).cast("long"))
    return c.groupBy(*by, "n").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(p95).alias("p95"))


def compare_arms(values: DataFrame, arm: str, key: list[str], by: list[str]) -> DataFrame:
    """(by, first, second, n, agreement, mean_apart, most_apart, within_tenth) of every two arms.

    ``values`` has ``arm``, ``key`` and ``value``, one row for each; only what both arms have counts.
    """
    a, b = values.withColumnsRenamed({arm: "first", "value": "_a"}), values.withColumnsRenamed({arm: "second", "value": "_b"})
    apart = F.abs(F.col("_a") - F.col("_b"))
    g = a.join(b, key).where("first < second").groupBy(*by, "first", "second")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return g.agg(F.count(F.lit(1)).alias("n"), share(apart < 1e-9).alias("agreement"), F.round(F.avg(apart), 6).alias("mean_apart"), F.round(F.max(apart), 6).alias("most_apart"), share(apart <= 0.1 + 1e-9).alias("within_tenth"))


def baseline_hit(gold: Column, citation: Column, text: Column) -> Column:
    """Whether a chunk shows a gold node: its quoted term, its exhibit, or its section by hint.

    A flat index knows no nodes, so a definition counts where its term stands quoted, an
    exhibit where it is named, and a section where the hint is the same or a relative.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    name = F.substring_index(gold, "::", -1)
    quoted = F.concat(F.lit("“"), F.lower(name), F.lit("”"))
    hint = F.regexp_extract(F.coalesce(citation, F.lit("")), r"§\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*)", 1)
    exhibit = F.concat(F.lit("exhibit "), F.lower(name))
    return (
        F.when(F.contains(gold, F.lit("::def::")), F.contains(low(text), quoted) | F.contains(low(citation), quoted))
        .when(F.contains(gold, F.lit("::exhibit::")), F.contains(low(text), exhibit) | F.contains(low(citation), exhibit))
        .otherwise((hint != "") & related(hint, name))
    )


def indexing_cost(words: DataFrame, seconds: float, rate_per_hour: float, by: list[str] | None = None) -> DataFrame:
    """Pages of 500 words, and seconds and cost for a hundred of them, of an index that took ``seconds``."""
    p = words.groupBy(*(by or [])).agg((F.sum("words") / 500).alias("pages"))
    per = F.when(F.col("pages") > 0, F.lit(float(seconds)) / F.col("pages") * 100)
    return p.withColumns({"seconds_per_100": F.round(per, 4), "cost_per_100": F.round(per / 3600 * rate_per_hour, 6)})


def citation_status(citation: Column) -> Column:
    """What a citation claims about its version: original, amended, or null."""
    c = F.lower(citation)
    return F.when(c.contains("as originally executed"), "original").when(c.contains("as amended by") | c.contains("proviso added by"), "amended").when(c.contains("dated "), "original")


def anachronism(citation: Column, as_of: Column) -> Column:
    """The first date a citation claims that lies after the question's day."""
    days = F.transform(F.regexp_extract_all(citation, F.lit(r"(?:effective|dated)\s+(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.try_to_date(d))
    return F.get(F.filter(days, lambda d: d > as_of), F.lit(0))
