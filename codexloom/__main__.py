"""Command line: list the queries, run one, or report on some.

    python -m codexloom list
    python -m codexloom run graph_edges --data DIR [--out DIR]
    python -m codexloom ask ID --data DIR [--path graph|baseline|both]
    python -m codexloom report metric_by_path metric_latency --data DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codexloom import reports
from codexloom.plans import answers, catalogue


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="codexloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run, ask, rep = sub.add_parser("run"), sub.add_parser("ask"), sub.add_parser("report")
    run.add_argument("name")
    run.add_argument("--out")
    ask.add_argument("id")
    ask.add_argument("--path", choices=("graph", "baseline", "both"), default="graph")
    rep.add_argument("names", nargs="+")
    for x in (run, ask, rep):
        x.add_argument("--data", required=True)
    a = p.parse_args(argv)
    queries = catalogue.queries()
    if a.what == "list":
        print("\n".join(sorted(queries)))
        return 0
    wanted = [a.name] if a.what == "run" else a.names if a.what == "report" else []
    if unknown := [n for n in wanted if n not in queries]:
        print("no such query: " + ", ".join(unknown), file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("codexloom").getOrCreate()
    if a.what == "run":
        df = queries[a.name](spark, a.data)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            print(reports.markdown(df, a.name))
    elif a.what == "report":
        print(reports.report({n: queries[n](spark, a.data) for n in a.names}, "codexloom"))
    else:
        for name, make in (("graph", answers.answer_context), ("baseline", answers.baseline_context)):
            if a.path in (name, "both"):
                got = make(spark, a.data).where(F.col("qid") == a.id).collect()
                print(f"# {name}\n" + "\n".join(r["prompt" if name == "graph" else "context"] or "" for r in got))
    return 0


if __name__ == "__main__":
    sys.exit(main())
