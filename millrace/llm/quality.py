"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, a temperature.

Random indexing: a word's index vector is the sum of sparse ternary vectors drawn by hash for its form (first and last
two characters, its shape) and for itself; its context vector, kept in a table of hashed rows, sums the index vectors
of its neighbours over the training texts. A word's vector is both together. A document is pooled to the means and the
spreads of its word vectors and the mean agreement of neighbours.

Training takes at most TRAIN_ROWS labelled documents, those with the smallest hash of their id (the documented bound
on fitting; ids choose rows only). They are written as a table of their own, of which a few tasks make the context table
(whole numbers, so the sum is the same in any order) and then the pooled features, both batch by batch; the network is fitted on
the features alone. The model has a fixed size, and scoring tasks get it. Every document is scored over its whole text, without a shuffle;
only texts go to Python and only scores come back.

Defined cases: null and wordless texts score as the average document; without labels, or with labels of one kind, all
scores are the share of label 1 (0.5 without any); a label that is null is none; if a document has several, the least counts, and of several texts
the least; columns besides doc_id, text and quality are not read, and the stage passes them through whatever their names;
repeated rows are scored each; an empty table gives no rows; texts of any length are pooled piece by piece.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, drop_caches, free_name, string_hashes

TRAIN_ROWS = 12_000
#: Tasks that read the training rows.
FIT_TASKS = 8
DIM, ROWS, NONZERO, HIDDEN = 48, 1 << 14, 4, 32
FEATURES = 2 * DIM + 2


def _ternary(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice((-1, 1), n)
    return out


#: Whole numbers: sums of index vectors are exact in any order.
_INDEX = {"word": _ternary(4096, 1), "head": 2 * _ternary(4096, 2), "tail": 2 * _ternary(4096, 3), "shape": 4 * _ternary(64, 4)}
_UNIT = 2.0


def word_rows(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's words as places in the batch's list of different words, and of those the rows in the context table and the index vectors."""
    parts = pc.utf8_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary
    there = np.asarray(pc.utf8_length(words)) > 0
    h = string_hashes(words)
    shape = np.zeros(len(words), np.int64)
    for bit, test in enumerate((pc.utf8_is_upper, pc.utf8_is_lower, pc.utf8_is_title, pc.utf8_is_alpha)):
        shape |= np.asarray(test(words)).astype(np.int64) << bit
    shape |= np.asarray(pc.match_substring_regex(words, "[0-9]")).astype(np.int64) << 4
    shape |= (np.asarray(pc.utf8_length(words)) > 7).astype(np.int64) << 5
    head, tail = string_hashes(pc.utf8_slice_codeunits(words, 0, 2)), string_hashes(pc.utf8_slice_codeunits(words, -2, None))
    index = _INDEX["word"][(h >> np.uint64(20)) % np.uint64(4096)] + _INDEX["head"][head % np.uint64(4096)] + _INDEX["tail"][tail % np.uint64(4096)] + _INDEX["shape"][shape]
    at, ends = np.asarray(coded.indices), parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    found = [at[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
    return [w[there[w]] for w in found], (h % np.uint64(ROWS)).astype(np.int64), index


def slices(texts: pa.Array, rows: int = 128) -> Iterator[pa.Array]:
    """Parts of a batch: bounded rows, nulls empty."""
    for lo in range(0, len(texts), rows):
        yield pc.fill_null(texts.slice(lo, rows), "")


def pooled(at: np.ndarray, vectors: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """Means, spreads, mean agreement of neighbours and the means' length; long texts piece by piece."""
    out = np.zeros(FEATURES, np.float32)
    n = len(at)
    if not n:
        return out
    total, squares, agree = np.zeros(DIM), np.zeros(DIM), 0.0
    for lo in range(0, n, piece):
        x = vectors[at[lo : lo + piece + 1]]
        y = x[:piece]
        total += y.sum(0)
        squares += np.einsum("ij,ij->j", y, y)
        if len(x) > 1:
            agree += float(np.einsum("ij,ij->", x[:-1], x[1:]))
    mean = total / n
    out[:DIM], out[DIM : 2 * DIM] = mean, np.sqrt(np.maximum(squares / n - mean**2, 0))
    out[-2], out[-1] = agree / max(1, n - 1) / max(squares.sum() / n, 1e-9), np.sqrt((mean**2).sum())
    return out


def features(texts: pa.Array, context: np.ndarray) -> np.ndarray:
    out = []
    for part in slices(texts):
        found, rows, index = word_rows(part)
        vectors = index / np.float32(_UNIT) + context[rows]
        out += [pooled(at, vectors) for at in found]
    return np.array(out, np.float32).reshape(-1, FEATURES)


def add_context(texts: pa.Array, table: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the two words before and after it."""
    for part in slices(texts):
        found, rows, index = word_rows(part)
        for at in found:
            for lo in range(0, len(at), 1 << 15):  # with two words on each side
                x, inner = index[at[max(0, lo - 2) : lo + (1 << 15) + 2]], slice(min(lo, 2), min(lo, 2) + min(1 << 15, len(at) - lo))
                near = np.zeros_like(x)
                for d in (1, 2):
                    near[d:] += x[:-d]
                    near[:-d] += x[d:]
                to = rows[at[lo : lo + (1 << 15)]]
                order = np.argsort(to, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
                table[to[order][starts]] += np.add.reduceat(near[inner][order].astype(np.float64), starts, axis=0)


def unit_rows(table: np.ndarray) -> np.ndarray:
    table = table / _UNIT
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)).astype(np.float16)


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 30, seed: int = 5) -> dict[str, np.ndarray]:
    """Two layers by Adam on the rows not in `calibrate`, then one temperature on those."""
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / std).clip(-8, 8)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    fit = np.flatnonzero(~calibrate)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), 128):
            i = order[lo : lo + 128]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]).clip(-30, 30))) - y[i]) / len(i)
            dh = np.outer(d, p[2]) * (h > 0)
            t += 1
            for k, g in enumerate((z[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = dict(mean=mean, std=std, w1=p[0], b1=p[1], w2=p[2], b2=p[3], temperature=np.array([1.0]))
    if calibrate.any():
        logit, target = logits(x[calibrate], model), y[calibrate]
        grid = np.geomspace(0.25, 16, 61)
        loss = [np.mean(np.logaddexp(0, logit / g) - target * logit / g) for g in grid]
        model["temperature"] = grid[[int(np.argmin(loss))]]
    return model


def logits(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    z = ((x - model["mean"]) / model["std"]).clip(-8, 8)
    z[~x.any(1)] = 0
    return (np.maximum(z @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"]) / model["temperature"]


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0: held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def training_table(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, quality, part: labelled rows that are not held out, at most `most`."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(bucket(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # of ids and labels alone, a bounded number
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).withColumn("part", bucket(F.col("doc_id"))))


def fit_on(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> bytes:
    """The model as an npz file. What comes to the driver is a table of fixed size from each of FIT_TASKS tasks, and FEATURES numbers a training row."""
    rows = training_table(documents, labels, most).coalesce(FIT_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        table = np.zeros((ROWS, DIM))
        for batch in batches:
            add_context(batch["text"], table)
        yield pa.RecordBatch.from_arrays([pa.array([table.astype("<i4").tobytes()], pa.binary())], names=["table"])

    found = rows.filter("part <> 1").select("text").mapInArrow(count, "table binary").collect()
    context = unit_rows(sum((np.frombuffer(r["table"], "<i4").reshape(ROWS, DIM).astype(np.float64) for r in found), np.zeros((ROWS, DIM))))
    sent = documents.sparkSession.sparkContext.broadcast(context)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.astype(np.float32)
        for batch in batches:
            x = pa.array([f.tobytes() for f in features(batch["text"], known)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], batch["part"], x], names=["doc_id", "quality", "part", "x"])

    got = rows.select(F.col("doc_id").cast("string"), F.col("quality").cast("double"), F.col("part").cast("int"), "text").mapInArrow(pool, "doc_id string, quality double, part int, x binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in got])
    if len(set(y.tolist())) < 2:
        model = {"prior": np.array([y.mean() if len(y) else 0.5])}
    else:
        x = np.array([np.frombuffer(r["x"], np.float32) for r in got])
        model = {"context": context, **train(x, y, np.array([r["part"] == 1 for r in got]))}
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    return out.getvalue()


def probability(texts: pa.Array, model: dict[str, np.ndarray], context: np.ndarray | None) -> np.ndarray:
    if context is None:
        return np.full(len(texts), float(model["prior"][0]))
    return 1 / (1 + np.exp(-logits(features(texts, context), model).clip(-700, 700)))


def scorer(spark: SparkSession, model: bytes):
    """A function of a text column: the probability of label 1. Texts go to Python, scores come back."""
    sent = spark.sparkContext.broadcast(model)  # of fixed size: table, network, temperature

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_caches()
        net = dict(np.load(io.BytesIO(sent.value)))
        context = net["context"].astype(np.float32) if "context" in net else None
        for texts in batches:
            yield pa.array(probability(texts, net, context), pa.float64())
        drop_caches()  # the worker waits for other operators

    return score


THRESHOLD = 0.3


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that op6 returns."""
    score = scorer(documents.sparkSession, fit_on(documents, labels))
    got = documents.select("doc_id", score(F.col("text")).alias("score"))
    return got.select("doc_id", (bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts, with the columns of documents."""
    score, name = scorer(documents.sparkSession, fit_on(documents, labels)), free_name(documents, "_score")
    return documents.withColumn(name, score(F.col("text"))).filter(F.col(name) >= THRESHOLD).drop(name)
