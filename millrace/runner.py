"""Runs a workload file: its queries by name, each checked against an expected result, with times and an exit code.

    python -m millrace.runner PLANS.json TABLES_FOLDER [--kind csv|parquet] [--golden FOLDER] [--times FILE] [--runs N] [NAME ...]

PLANS.json has sql_directory, names and plans (one EXPLAIN tree for each name). A query's rows must equal those that Spark's own SQL returns
for its text with plain columns, and, with --golden, the rows kept there. The exit code is 0 if all do; the file of times is written only then.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import pgplan, sqlfront
from millrace.plans.verify import golden, phases, same_bag, timed
from millrace.sources.catalog import Catalog, read_sql_file


@dataclass
class Query:
    name: str
    sql: str
    explained: dict | None


def read_workload(path: str) -> list[Query]:
    """The queries of a workload file; sql_directory is relative to the file."""
    spec = json.loads(Path(path).read_text())
    plans = spec.get("plans") or [None] * len(spec["names"])
    if len(plans) != len(spec["names"]):
        raise ValueError(f"{len(spec['names'])} names, {len(plans)} plans")
    folder = Path(path).parent / spec["sql_directory"]
    return [Query(n, read_sql_file(str(folder), n), p) for n, p in zip(spec["names"], plans, strict=True)]


def rows_of(query: Query, tables: dict[str, DataFrame]) -> DataFrame:
    """The query's plain rows by its join tree, or by the tree of sizes if it has none."""
    bound = sqlfront.parse(query.sql, {t: df.columns for t, df in tables.items()})
    tree = pgplan.join_tree(query.explained, bound) if query.explained else None
    return sqlfront.run(query.sql, tables, [f"c{k}" for k in range(len(bound.outputs))], tree, honour_build=True)


def run(spark: SparkSession, catalog: Catalog, queries: list[Query], names: list[str] | None = None, kept: str | None = None, runs: int = 0) -> dict[str, dict]:
    """By name: correct, error, and times in seconds and milliseconds by phase."""
    unknown = set(names or ()) - {q.name for q in queries}
    if unknown:
        raise ValueError(f"the workload has no query {', '.join(sorted(unknown))}")
    tables, out = catalog.register(spark), {}
    for query in queries:
        if names and query.name not in names:
            continue
        began = time.perf_counter()
        try:
            df = rows_of(query, tables)
            want = spark.sql(sqlfront.plain_sql(query.sql, catalog.columns()))
            correct = same_bag(df, want) and (kept is None or golden(df, f"{kept}/{query.name}"))
            out[query.name] = {"correct": correct, "phases": phases(df)}
            if runs:
                out[query.name] |= timed(lambda q=query: rows_of(q, tables), runs)
        except Exception as e:  # one query's failure is told, the others run
            out[query.name] = {"correct": False, "error": f"{type(e).__name__}: {e}"[:500]}
        out[query.name]["seconds"] = time.perf_counter() - began
    return out


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("plans")
    p.add_argument("tables")
    p.add_argument("names", nargs="*")
    p.add_argument("--kind", default="csv", choices=("csv", "parquet"))
    p.add_argument("--golden")
    p.add_argument("--times")
    p.add_argument("--runs", type=int, default=0)
    a = p.parse_intermixed_args(args)
    spark = SparkSession.builder.getOrCreate()
    found = run(spark, Catalog(a.tables, kind=a.kind), read_workload(a.plans), a.names, a.golden, a.runs)
    for name, x in found.items():
        print(name, "correct" if x["correct"] else "WRONG", x.get("error", ""), json.dumps(x.get("phases", {})))
    good = all(x["correct"] for x in found.values())
    if good and a.times:
        Path(a.times).write_text(json.dumps(found, indent=1))
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
