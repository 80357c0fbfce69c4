"""Bag equality of results, golden results, phases of a run from Spark's own metrics, and timing runs."""

from __future__ import annotations

import statistics
import time
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Equal types by position, and equal rows with their multiplicities."""
    if [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
        return False
    b = b.toDF(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def golden(df: DataFrame, path: str) -> bool:
    """Whether df equals the result kept under the path; the first time it is kept there, and is equal."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.mode("overwrite").parquet(path)
        return True
    return same_bag(df, spark.read.parquet(path))


def _nodes(plan):
    """The nodes of a physical plan that ran, also behind adaptive stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
        return
    yield plan
    if kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


#: The phases of a run: parts of the names of Spark's time metrics.
PHASES = {
    "build": ("time to build",), "scan": ("scan time",), "broadcast": ("time to collect", "time to broadcast"),
    "shuffle write": ("shuffle write time",), "fetch": ("fetch wait time",), "sort": ("sort time",), "aggregate": ("time in aggregation",),
}


def phases(df: DataFrame) -> dict[str, float]:
    """Runs the plan and returns the rows of its root and the milliseconds of each phase, summed over its tasks."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    out: dict[str, float] = defaultdict(float)
    out["rows"] = execution.toRdd().count()
    out["total"] = 1000 * (time.perf_counter() - began)
    for node in _nodes(execution.executedPlan()):
        metrics = node.metrics().values().iterator()
        while metrics.hasNext():
            metric = metrics.next()
            name = metric.name().get() if metric.name().isDefined() else ""
            for phase, parts in PHASES.items():
                if any(name.startswith(x) for x in parts):
                    out[phase] += max(0, metric.value()) / (1e6 if metric.metricType() == "nsTiming" else 1)
    return dict(out)


def timed(run: Callable[[], DataFrame], runs: int = 10) -> dict[str, float]:
    """One cold run, then statistics over the others, in seconds."""
    took = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    warm = took[1:] or took
    return {"cold": took[0], "median": statistics.median(warm), "mean": statistics.fmean(warm), "min": min(warm), "max": max(warm), "stdev": statistics.pstdev(warm)}
