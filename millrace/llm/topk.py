"""Exact top-k by MaxScore: essential and non-essential terms by score bounds, shards merged.

A vector's components are its terms. A shard of vectors keeps one posting list per term (an integer weight for each
of its vectors, term by term) with its least and greatest weight, so a query knows the least and greatest that each
term can add. Terms are sorted by that span. The terms whose spans together cannot lift a vector from the floor to the
current k-th score are non-essential: only the essential postings are traversed, and the others are probed, largest
span first, for the vectors that are still competitive. Ties at the k-th score stay competitive, so results are exact.

Vectors are dealt evenly to shards of bounded rows. Each shard is built once, in the task that sorts its vectors before the
queries, and the queries stream past it batch by batch, so a task holds one shard and one batch. First each query meets one
shard alone; the k-th score found there is its bar in all shards. Only k rows a query and shard leave a task; a window with a
limit per group merges them.

Defined cases: vectors that are null, or hold null, NaN or infinite components, take no part, nor do those without an id;
shorter vectors count as padded with 0; rows are told apart, not ids: of repeated rows each asks for itself, and is a candidate for all others,
also for those with its id; columns besides the two are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


class Shard:
    """Postings by term. scale: float64 where every sum of products is exact in it, else int64."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.postings.min(1), self.postings.max(1)
        self.read = self.whole = 0  # postings traversed or probed, of all

    def top(self, own: int, query: np.ndarray, k: int, bar: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows but `own`, by score and then smaller id; those below the bar may be left out."""
        query = np.concatenate([query, np.zeros(max(0, len(self.postings) - len(query)), np.int64)])
        query = query[: len(self.postings)]  # what no vector here has adds nothing
        n = len(self.ids)
        self.whole += n * len(query)
        peak = float(np.abs(query).astype(float) @ np.maximum(np.abs(self.low), np.abs(self.high)).astype(float))
        kind = np.float64 if peak < 2**52 else np.int64
        q, posts = query.astype(kind), self.postings if kind is np.int64 else self.floats()
        least = np.minimum(q * self.low, q * self.high)
        span = np.maximum(q * self.low, q * self.high) - least
        terms = np.argsort(-span, kind="stable")
        # a first k-th score: the whole scores of what stands highest in the first terms
        first = q[terms[:4]] @ posts[terms[:4]]
        seed = np.argpartition(-first, min(4 * k, n) - 1)[: min(4 * k, n)]
        seed = seed[self.rows[seed] != own]
        whole = q @ posts[:, seed]
        if len(whole) >= k:
            here = np.partition(whole, len(whole) - k)[len(whole) - k]
            bar = here if bar is None else max(bar, here)
        rest = np.concatenate([np.cumsum(span[terms][::-1])[::-1], [0]]).astype(kind)  # rest[j]: most that terms[j:] add to the floor
        floor = least.sum()
        essential = len(terms) if bar is None else int(np.searchsorted(-rest, -(bar - floor), side="right"))
        essential = max(min(1, len(terms)), min(essential, len(terms)))
        use = terms[:essential]
        score = q[use] @ posts[use] + (floor - least[use].sum())
        self.read += n * essential
        alive = np.arange(n) if bar is None else np.flatnonzero(score + rest[essential] >= bar)
        score = score[alive]
        at = essential
        while at < len(terms):
            step = terms[at : at + 4]
            score = score + q[step] @ posts[step][:, alive] - least[step].sum()
            self.read += len(step) * len(alive)
            at += len(step)
            if len(score) > k and at < len(terms):
                if len(score) > 4 * k:
                    better = np.partition(score, len(score) - k - 1)[len(score) - k - 1]  # k rows beside the query's own
                    bar = better if bar is None else max(bar, better)
                stay = score + rest[at] >= bar if bar is not None else np.ones(len(score), bool)
                alive, score = alive[stay], score[stay]
        keep = self.rows[alive] != own
        alive, score = alive[keep], score[keep]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best].astype(np.int64)

    def floats(self) -> np.ndarray:
        if not hasattr(self, "_floats"):
            self._floats = self.postings.astype(np.float64)
        return self._floats


def usable(v: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad)


def met(vectors: DataFrame, asks: DataFrame, shards: int, k: int) -> DataFrame:
    """query (its row), query_id, vec_id, score: the k best of each shard for the queries that are dealt to it.

    vectors: shard, row, vec_id, v. asks: shard, row, vec_id, v, bar (null: none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at, shard = None, None
        for batch in batches:
            for number, part in batch.groupby("shard", sort=True):
                if number != at:
                    at, shard, held = number, None, []
                if (own := part[~part["asks"]]).size:
                    held.append(own)
                rows = []
                for r in part[part["asks"]].itertuples():
                    if shard is None and held:
                        all_ = pd.concat(held)
                        shard, held = Shard(all_["row"].to_numpy(np.int64), all_["vec_id"].to_numpy(np.int64), matrix(all_["v"], max(map(len, all_["v"])))), []
                    if shard is not None:
                        ids, scores = shard.top(r.row, np.asarray(r.v, np.int64), k, None if pd.isna(r.bar) else int(r.bar))
                        rows.append(pd.DataFrame({"query": r.row, "query_id": r.vec_id, "vec_id": ids, "score": scores}))
                if rows:
                    yield pd.concat(rows)

    both = vectors.select("shard", F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(None).cast("long").alias("bar"))
    both = both.unionByName(asks.select("shard", F.lit(True).alias("asks"), "row", "vec_id", "v", "bar"))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInPandas(run, "query long, query_id long, vec_id long, score long")


def maxscore_topk(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score for every row for which is_query holds."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(usable(F.col("x")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"), is_query.alias("asked"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # kept by the written table
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    held, asks = rows.withColumn("shard", shard), rows.filter("asked")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda got: got.withColumn("rank", F.row_number().over(order))
    # one shard first: a k-th score there is a bar everywhere
    one = met(held, asks.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards))).withColumn("bar", F.lit(None).cast("long")), shards, k)
    bars = ranked(one).filter(F.col("rank") == k).select(F.col("query").alias("_q"), F.col("score").alias("bar")) if shards > 1 else None
    asks = asks.withColumn("bar", F.lit(None).cast("long")) if bars is None else asks.join(bars, F.col("row") == F.col("_q"), "left").drop("_q")
    each = asks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return ranked(met(held, each, shards, k)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_embeddings(embeddings: DataFrame) -> DataFrame:
    """The rows that op5 returns."""
    return maxscore_topk(embeddings, F.col("vec_id") % 100 == 0)
