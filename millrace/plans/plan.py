"""The plan algebra: scans and inner equi-joins with free projection by position, compiled to one lazy DataFrame.

A join whose keys repeat on both sides returns far more rows than it reads, but Spark cuts tasks by the bytes that are read: a file of a few MB
is one task, however many rows it meets. So where two sides could make MANY_PAIRS rows, the rows that the join returns are counted from the
numbers of rows of each key (linear, nothing is multiplied), and if these are many, the larger side is dealt evenly to tasks of TASK_ROWS
rows of the result; the smaller one is broadcast, its rows of one key as one array. Neither side's rows of one key meet in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A shuffled hash join keeps a partition of its build side in memory: at most so many bytes of it are hinted for.
HASHED_PARTITION = 64 << 20
#: Sides of fewer pairs of rows (as estimated) are joined as they are; a counted join is spread from this many rows on.
MANY_PAIRS = 10_000_000
#: Rows of a spread join's result in a task.
TASK_ROWS = 10_000_000


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of what a DataFrame holds."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def as_build_side(df: DataFrame) -> DataFrame:
    """Hinted as the hashed side, where it is too large to be broadcast anyway and its partitions fit in memory."""
    conf = df.sparkSession.conf
    small = conf.get("spark.sql.autoBroadcastJoinThreshold").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    small = int(small[:-1]) * unit[small[-1]] if small[-1] in unit else int(small)
    fits = int(conf.get("spark.sql.shuffle.partitions")) * HASHED_PARTITION
    return df.hint("SHUFFLE_HASH") if small < plan_bytes(df) <= fits else df


def row_bytes(df: DataFrame) -> int:
    """What a row of a hashed table takes, about."""
    return 32 + df._jdf.schema().defaultSize()


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of which no key is NULL. NaN is a key (dropna takes it for NULL)."""
    for c in keys:
        df = df.filter(F.col(c).isNotNull())
    return df


def many_rows(build: DataFrame, stream: DataFrame, keys: list[tuple[str, str]]) -> int:
    """How many rows the join returns, where it is MANY_PAIRS at least, build's keys repeat and build fits in a broadcast; else 0."""
    named = with_keys(build, [b for b, _ in keys]).select(*[F.col(b).alias(f"_k{k}") for k, (b, _) in enumerate(keys)])
    counts = named.groupBy(*named.columns).agg(F.count("*").alias("_n"))
    most, rows = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) < 2 or rows * row_bytes(build) > HASHED_PARTITION:
        return 0
    on = [F.col(s) == F.col(f"_k{k}") for k, (_, s) in enumerate(keys)]
    found = stream.join(counts, on).agg(F.sum("_n"), F.count("*")).first()
    return int(found[0]) if found[0] and found[0] >= max(MANY_PAIRS, 2 * found[1]) else 0


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Dealt evenly to tasks, of a join that returns so many rows."""
    busy = min(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / 1e6))
    return df.repartition(max(busy, math.ceil(rows / TASK_ROWS)))


def multiplied(build: DataFrame, stream: DataFrame, keys: list[tuple[str, str]], wanted: list[str], rows: int) -> DataFrame:
    """The inner join of so many rows, with the columns of stream and those wanted of build. A row of stream is looked up once, and its partners are read off an array for each column."""
    members = with_keys(build, [b for b, _ in keys]).groupBy(*[F.col(b).alias(f"_k{k}") for k, (b, _) in enumerate(keys)]).agg(F.collect_list(F.struct(*wanted)).alias("_rows"))
    members = members.select(*[F.col(f"_k{k}") for k in range(len(keys))], *[F.col(f"_rows.{c}").alias(f"_a_{c}") for c in wanted])
    on = [F.col(s) == F.col(f"_k{k}") for k, (_, s) in enumerate(keys)]
    met = spread(stream, rows).join(F.broadcast(members), on)
    first, *more = wanted
    if not more:
        return met.select(*stream.columns, F.explode(f"_a_{first}").alias(first))
    met = met.select(*stream.columns, *[f"_a_{c}" for c in more], F.posexplode(f"_a_{first}").alias("_at", first))
    return met.select(*stream.columns, first, *[F.get(f"_a_{c}", F.col("_at")).alias(c) for c in more])


@dataclass(frozen=True)
class Scan:
    base: int
    outputs: tuple[int, ...]


@dataclass(frozen=True)
class Join:
    """keys: pairs of positions in the outputs of left and right. outputs: positions in left's outputs, then right's."""

    left: int
    right: int
    keys: tuple[tuple[int, int], ...]
    outputs: tuple[int, ...]
    build_left: bool | None = None


@dataclass
class Plan:
    inputs: list[DataFrame] = field(default_factory=list)
    nodes: list[Scan | Join] = field(default_factory=list)
    root: int = -1

    def scan(self, df: DataFrame, outputs: list[int] | None = None) -> int:
        self.inputs.append(df)
        self.nodes.append(Scan(len(self.inputs) - 1, tuple(range(len(df.columns)) if outputs is None else outputs)))
        self.root = len(self.nodes) - 1
        return self.root

    def join(self, left: int, right: int, keys: list[tuple[int, int]], outputs: list[int], build_left: bool | None = None) -> int:
        if not keys:
            raise ValueError("a join needs a pair of keys")
        widths = len(self.nodes[left].outputs), len(self.nodes[right].outputs)
        if any(not (0 <= a < widths[0] and 0 <= b < widths[1]) for a, b in keys) or any(not 0 <= o < sum(widths) for o in outputs):
            raise ValueError("a position is outside of the inputs' outputs")
        self.nodes.append(Join(left, right, tuple(keys), tuple(outputs), build_left))
        self.root = len(self.nodes) - 1
        return self.root

    def to_dataframe(self, names: list[str] | None = None, honour_build: bool = False) -> DataFrame:
        """Columns have unique positional names on the way. honour_build: hint the build side where its size calls for it; else statistics decide at run time."""
        built: dict[int, DataFrame] = {}
        rows: dict[int, float] = {}  # as estimated; keys are taken to be unique on one side where nothing was counted
        dealt: set[int] = set()
        for i, node in enumerate(self.nodes):  # children come before parents
            if isinstance(node, Scan):
                df = self.inputs[node.base]
                cols = [F.col(f"`{df.columns[k]}`") for k in node.outputs]
                few = df.select(*cols)
                rows[i] = plan_bytes(few) / (8 + few._jdf.schema().defaultSize())
            else:
                l, r = built[node.left], built[node.right]
                lc, rc = [f"n{node.left}_c{k}" for k in range(len(l.columns))], [f"n{node.right}_c{k}" for k in range(len(r.columns))]
                if node.left == node.right:
                    rc = [f"{c}_r" for c in rc]
                    r = r.toDF(*rc)
                swap = rows[node.left] * row_bytes(l) < rows[node.right] * row_bytes(r)
                build, stream, at = (l, r, (node.left, node.right)) if swap else (r, l, (node.right, node.left))
                pairs = [(lc[a], rc[b]) if swap else (rc[b], lc[a]) for a, b in node.keys]
                many = 0
                # a side dealt out before has its tasks; one that is too large for a broadcast stays with Spark's own joins
                if not dealt & {*at} and rows[at[0]] * row_bytes(build) <= HASHED_PARTITION and rows[at[0]] * rows[at[1]] >= MANY_PAIRS:
                    many = many_rows(build, stream, pairs)
                rows[i] = many or max(rows[node.left], rows[node.right])
                if many or dealt & {*at}:
                    dealt.add(i)
                if many:
                    returned = {(lc + rc)[k] for k in node.outputs}
                    df = multiplied(build, stream, pairs, [c for c in build.columns if c in returned] or build.columns[:1], many)
                else:
                    if honour_build and node.build_left is not None:
                        l, r = (as_build_side(l), r) if node.build_left else (l, as_build_side(r))
                    on = F.lit(True)
                    for k, (a, b) in enumerate(node.keys):
                        same = F.col(lc[a]) == F.col(rc[b])
                        on = same if k == 0 else on & same
                    df = l.join(r, on, "inner")
                cols = [F.col((lc + rc)[k]) for k in node.outputs]
            built[i] = df.select(*[c.alias(f"n{i}_c{k}") for k, c in enumerate(cols)])
        out = built[self.root]
        return out.toDF(*(names or [f"c{k}" for k in range(len(out.columns))]))
