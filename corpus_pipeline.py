"""The corpus pipeline: quality, repeated lines, near copies, source mix, packing. Each stage reads what the one before wrote.

Defined cases are those of the stages' modules: null and empty texts pass the first four stages (wordless ones are scored as the average document; line
dedup drops only those that it empties; near dedup keeps each of them; the mix takes each once) and are packed as the closing id alone; documents are
told apart by id and text, so null and repeated ids lose nothing; all but the last stage return the columns of documents, whatever more there
are; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import arrow_rows, limit_arrow_rows, remove, shared_dir
from millrace.llm.line_dedup import line_stage
from millrace.llm.mixing import mix_stage
from millrace.llm.near_dedup import near_stage
from millrace.llm.packing import packed_documents
from millrace.llm.quality import quality_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: An executor that all stages have run on has little room left beside its heap: rows that Python gets at a time, and words that the tokenizer of a worker keeps.
PYTHON_ROWS, WORDS = 1024, 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs."""
    return line_stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packed_documents(docs, words=WORDS)


def in_small_batches(stage: Stage) -> Stage:
    """The stage, and from then on the session sends Python PYTHON_ROWS rows at a time, as the caller runs what a stage returns."""

    def small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        limit_arrow_rows(spark, PYTHON_ROWS)
        return stage(spark, docs, sf_dir)

    return small


STAGES: list[tuple[str, Stage]] = [
    (name, in_small_batches(stage))
    for name, stage in (("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_copies), ("mix_sources", mix), ("pack", pack))
]

#: The network, the tokenizer and the packing heuristic are not SQL; tests hold each stage's rows against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one is written.

    The last one goes when the driver's JVM ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    with arrow_rows(spark, PYTHON_ROWS):
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            if k:
                remove(spark, f"{base}/{k - 1}")
            docs = spark.read.parquet(f"{base}/{k}")
    remove(spark, base, at_exit=True)
    return docs
