"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more rows than this and more than 1/HOT_KEYS of all rows,
#: so there are never more than HOT_KEYS hot keys and their list may be broadcast.
HOT_ROWS, HOT_KEYS, SALTS = 200_000, 4096, 32


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application.

    The archive lies with the driver only; Spark's own file server hands it out, so the
    workers need neither a shared folder nor a search path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, archive = Path(__file__).resolve().parent, os.path.join(tempfile.mkdtemp(prefix="codexloom-"), "codexloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the session's Python workers have this package."""
    ship(df.sparkSession)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is ``spark.checkpoint.dir`` of the session, which all executors
    share. Only a local session without that setting (tests) gets a temporary one.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codexloom-"))
    return df.checkpoint()


def fresh(df: DataFrame, stem: str) -> str:
    """``stem``, made unlike every column of ``df``."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` of two frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


#: Places of an ordered group that one task runs over, where a group may be large.
RANGE = 4096


def range_of(pos: Column, width: int = RANGE) -> Column:
    """The range of places that ``pos`` lies in; null places come first."""
    return F.coalesce(F.floor(pos / width), F.lit(-(1 << 40)))


def running_sum(df: DataFrame, by: str, pos: str, order: Sequence[str], value: str, out: str, width: int = RANGE) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of its group before it in ``order``.

    ``order`` begins with ``pos``. Sums run inside ranges of ``pos``, and over the ranges' totals, so that no
    task gets a whole group.
    """
    b, inside, before = fresh(df, "_range"), fresh(df, "_inside"), fresh(df, "_before")
    rows = df.withColumn(b, range_of(F.col(pos), width))
    rows = rows.withColumn(inside, F.sum(value).over(Window.partitionBy(by, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    total = rows.groupBy(by, b).agg(F.sum(value).alias(before))
    w = Window.partitionBy(by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col(by).alias("_g"), F.col(b).alias("_b"), F.coalesce(F.sum(before).over(w), F.lit(0)).alias(before))
    return rows.join(total, rows[by].eqNullSafe(total["_g"]) & (rows[b] == total["_b"])).withColumn(out, F.col(inside) + F.col(before)).drop("_g", "_b", b, inside, before)


def skew_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``big`` to ``lookup`` (null keys match), splitting hot keys of ``big``.

    Rows of a hot key are spread over SALTS tasks, and only that key's lookup rows
    are copied to each. ``how`` is ``inner`` or ``left``. The lookup's key columns
    are not repeated in the result.
    """
    on, salt, n = list(on), fresh(big, "_salt"), fresh(big, "_n")
    total = big.agg(F.count(F.lit(1)).alias("_total"))
    hot = (
        big.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
        .crossJoin(F.broadcast(total))
        .where((F.col(n) > hot_rows) & (F.col(n) > F.col("_total") / HOT_KEYS))
        .select(*on, F.lit(True).alias(n))
    )

    def marked(df: DataFrame, salts: Column) -> DataFrame:
        h = hot.select(*[F.col(k).alias(f"_h_{k}") for k in on], n)
        cond = F.lit(True)
        for k in on:
            cond = cond & df[k].eqNullSafe(h[f"_h_{k}"])
        return df.join(F.broadcast(h), cond, "left").withColumn(salt, F.when(F.col(n), salts)).drop(n, *[f"_h_{k}" for k in on])

    # Hashed and not random: a task that is run again must salt its rows as before.
    row = F.xxhash64(*[c for c, t in big.dtypes if "map<" not in t and "variant" not in t])
    left = marked(big, F.pmod(row, F.lit(SALTS)).cast("int")).withColumn(salt, F.coalesce(salt, F.lit(0)))
    right = marked(lookup, F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<int>"))
    right = right.withColumn(salt, F.explode(F.coalesce(salt, F.array(F.lit(0)))))
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in {*on, salt} else F.col(c) for c in right.columns])
    cond = left[salt] == right[f"_r_{salt}"]
    for k in on:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return left.join(right, cond, how).drop(salt, f"_r_{salt}", *[f"_r_{k}" for k in on])
