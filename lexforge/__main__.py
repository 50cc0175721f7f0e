"""Command line: list the queries, run one, print its SQL, or evaluate and report predictions."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexforge", description=__doc__)
    sub = parser.add_subparsers(dest="action", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query on a data folder")
    run.add_argument("query")
    run.add_argument("data")
    run.add_argument("--out", help="Parquet folder for the result; without it the first rows are shown")
    sql = sub.add_parser("sql", help="the SQL of a query")
    sql.add_argument("query")
    ev = sub.add_parser("evaluate", help="top-k accuracies of a table (truth, candidates: array of name and logprob)")
    ev.add_argument("table")
    report = sub.add_parser("report", help="conforming, suggested and withheld names of such a table")
    report.add_argument("table")
    report.add_argument("--least", type=float, default=0.2)
    report.add_argument("--first", type=int, default=3)
    said = parser.parse_args(argv)

    from lexforge.plans import catalog

    if said.action == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    if said.action == "sql":
        print(catalog.oracle_sql().get(said.query, "none").strip())
        return

    from pyspark.sql import SparkSession

    from lexforge.operators import reports as R

    spark = SparkSession.builder.appName("lexforge").getOrCreate()
    if said.action == "run":
        out = catalog.queries()[said.query](spark, said.data)
        if said.out:
            out.write.parquet(said.out)
        else:
            out.show(20, truncate=80)
        return
    rows = spark.read.parquet(said.table)
    if said.action == "evaluate":
        R.top_k_accuracy(rows.withColumn("names", F.transform("candidates", lambda c: c["name"])), "truth", "names").show()
    else:
        R.conformity(rows.select(R.bucket(F.col("truth"), F.col("candidates"), said.least, said.first).alias("kind")), "kind").show()


if __name__ == "__main__":
    main()
