"""Writing and reading graphs, and a store of results that can be resumed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "ignore") -> None:
    """Parquet, edges by type; an existing graph is left alone unless ``mode`` says so."""
    vertices.write.mode(mode).parquet(f"{path}/vertices")
    edges.write.mode(mode).partitionBy("edge_type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def load_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a node-link JSON document; attributes stay as read."""
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    links = "links" if "links" in doc.columns else "edges"
    e = doc.select(F.posexplode(links).alias("seq", "e")).select("seq", "e.*")
    names = {"source": "src", "target": "dst", "key": "edge_key"}
    e = e.withColumnsRenamed({k: v for k, v in names.items() if k in e.columns})
    kind = F.col("edge_type") if "edge_type" in e.columns else F.lit(None).cast("string")
    return nodes, e.withColumn("edge_type", F.coalesce(kind, F.substring_index("edge_key", "::", 1)))


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` whose keys have no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def last_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of ``parts``; of equal keys the row of the latest part."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "_part")]
    best = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_part").alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_answers(answers: DataFrame, path: str, tag: str, at: str) -> None:
    """Answers under their run's tag and time, with the run's settings beside them."""
    spark = answers.sparkSession
    run = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.codexloom.tokenizer")}
    answers.withColumns({"tag": F.lit(tag), "ts": F.lit(at)}).write.mode("append").partitionBy("tag", "ts").parquet(os.path.join(path, "answers"))
    spark.createDataFrame([(tag, at, k, v) for k, v in run.items()], "tag string, ts string, setting string, value string").write.mode("append").parquet(os.path.join(path, "runs"))
