"""Reports of small results, artifacts that are built once, and the provenance of a run."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table in a report. A report is a summary; larger results belong into files.
ROWS = 200


def markdown(df: DataFrame, title: str = "", rows: int = ROWS) -> str:
    """``df`` as a table in Markdown, its first ``rows`` rows in order of all columns.

    Numbers with decimals get four of them, nulls a dash, and bars inside cells are escaped.
    """

    def cell(v: object) -> str:
        text = "-" if v is None else f"{v:.4f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    got = df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]).limit(rows + 1).collect()
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in got[:rows]]
    if len(got) > rows:
        lines += ["", f"The first {rows} rows."]
    return "\n".join(lines) + "\n"


def report(parts: dict[str, DataFrame], heading: str) -> str:
    """Several tables under one heading, in their order."""
    return f"# {heading}\n\n" + "\n".join(markdown(df, name) for name, df in parts.items())


def build_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What lies at ``path``; made and written there first if nothing finished does.

    The writer's own mark of success tells a finished artifact from one that a lost
    driver left behind, which is written anew.
    """
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def provenance(spark: SparkSession, tag: str, at: dt.datetime | None = None) -> DataFrame:
    """(tag, at, setting, value): the session's own settings, versions and the code's revision."""
    at = at or dt.datetime.now(dt.timezone.utc)
    try:
        here = os.path.dirname(os.path.abspath(__file__))
        sha = subprocess.run(["git", "-C", here, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        sha = "unknown"
    own = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(("spark.sql.", "spark.codexloom.", "spark.master"))}
    rows = {**own, "spark.version": spark.version, "code.revision": sha}
    return spark.createDataFrame([(tag, at.isoformat(timespec="seconds"), k, str(v)) for k, v in sorted(rows.items())], "tag string, at string, setting string, value string")
