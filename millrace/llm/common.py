"""What the training-data operators share: cut tables, word hashes, what workers keep, sums in order."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder, now or when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        files.deleteOnExit(at)
    else:
        files.delete(at, True)


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_arrow_rows(spark: SparkSession, most: int) -> None:
    """From now on Python gets at most so many rows at a time: each batch lies in the JVM and in the worker, beside the next."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= most:
        spark.conf.set(_ARROW_ROWS, most)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int | None) -> Iterator[None]:
    """What is run inside sends Python at most so many rows at a time (None: as the session says)."""
    before = spark.conf.get(_ARROW_ROWS)
    if most:
        limit_arrow_rows(spark, most)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: short lineage that outlives executors.

    The files go when the driver's JVM ends. Unlike an eager checkpoint(), the plan runs once and
    the files are compressed. rows: the most that a batch for Python holds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    remove(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_KEPT: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task: the cache of one operator at a time, so that reused workers do not gather several."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


_MARKS = string.punctuation + "«»„“”‚‘’…–—¿¡·"
_RNG = np.random.default_rng(31)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_NEAR, _FAR = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, m, np.uint64)]) for n, m in ((1 << 12, np.uint64(0x9E3779B97F4A7C15)), (1 << 18, np.uint64(0xC2B2AE3D27D4EB4F))))


def drop_caches() -> None:
    """For operators that keep nothing: what an earlier one has left in a reused worker goes, back to the system too."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def string_hashes(words: pa.Array, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of strings without nulls: a polynomial over the bytes of about `piece` bytes of them at once, so there is no work in Python for each."""
    if not len(words):
        return np.empty(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    there = np.flatnonzero(ends[1:] > ends[:-1])
    starts, stops = ends[there], ends[there + 1]
    out = np.zeros(len(words), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + piece, side="right")))
        at, n = starts[lo:hi] - starts[lo], stops[lo:hi] - starts[lo:hi]
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        term = _BYTE[raw[starts[lo] : stops[hi - 1]]] * _NEAR[place & 4095]
        if n.max() > 4096:
            term *= _FAR[(place >> 12) % len(_FAR)]
        h = np.add.reduceat(term, at) + n.astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[there[lo:hi]] = h ^ (h >> np.uint64(32))
        lo = hi
    return out


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """64-bit hashes of the words of each whole text, in order: lower-case forms without outer punctuation; what has nothing left is no word."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words = pc.utf8_trim(parts.flatten(), characters=_MARKS)
    lists = parts.offsets.to_numpy().astype(np.int64)
    there = np.asarray(pc.binary_length(words)) > 0
    out = string_hashes(words)[there]
    upto = np.concatenate([[0], np.cumsum(there)])[lists - lists[:1]]
    return [out[a:b] for a, b in zip(upto, upto[1:], strict=False)]


def running_start(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str, cell: Column, cells: str = "_cell") -> DataFrame:
    """Adds `out`: the sum of `amount` over the rows of the same keys that come before, by (cell, order).

    No group is gathered: each key's rows are dealt to cells of bounded size, the sums of cells (a partial
    aggregate, few rows) are accumulated, and only a cell's own rows meet in one task.
    """
    dealt = df.withColumn(cells, cell)
    by = [*keys, cells]
    sums = dealt.groupBy(*by).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(cells).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn(out, F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    same = [dealt[k].eqNullSafe(sums[k]) for k in by]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return dealt.join(sums, on).select(*[dealt[c] for c in dealt.columns if c not in (cells, out)], (dealt[out] + sums["_before"]).cast("long").alias(out))
