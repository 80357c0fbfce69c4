"""Typed sources and sinks: CSV dialects, Parquet, rows, a filtered-scan cache, text."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.predicates import Predicate

#: The four column types of the workload.
TYPES = {"INT32": T.IntegerType(), "INT64": T.LongType(), "FP64": T.DoubleType(), "VARCHAR": T.StringType()}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def schema(attributes: list[tuple[str, str]]) -> T.StructType:
    """From (name, type name) pairs."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in attributes])


def read_csv(
    spark: SparkSession, path: str, attributes: list[tuple[str, str]], where: Predicate | None = None, header: bool = False, sep: str = ",",
    escape: str = "\\", trailing_sep: bool = False, check_quotes: bool = True, multi_line: bool = True,
) -> DataFrame:
    """Typed CSV, filtered. Empty fields are NULL, also when quoted; ragged rows and fields of a wrong type fail. A quote inside an unquoted field stays as it is.

    trailing_sep: every row ends in a separator. check_quotes: an open quote at the end of a file (of a line, if not multi_line) fails, which the
    reader alone would not notice; this reads the text once before. multi_line: fields may hold line ends, so a file is read by one task; without
    it files are split. Trusted files of plain lines are read in one pass by many tasks with check_quotes=False, multi_line=False.
    """
    want = schema(attributes)
    read = T.StructType([*want.fields, T.StructField("_end", T.StringType())]) if trailing_sep else want
    if check_quotes:
        check_closed_quotes(spark, path, sep, escape, multi_line)
    df = spark.read.schema(read).csv(path, header=header, sep=sep, quote='"', escape=escape, multiLine=multi_line, mode="FAILFAST", nullValue="", emptyValue="")
    df = df.select(*want.names)
    text = [f.name for f in want.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text}) if text else df
    return df.filter(where.compile(F.col)) if where is not None else df


def check_closed_quotes(spark: SparkSession, path: str, sep: str, escape: str, multi_line: bool = True) -> None:
    """Counts the quotes that open or close a field, line by line, and fails where a file (a line, if not multi_line) has an odd number.

    A quote counts if a line end or separator stands beside it; others are part of a field. Escaped quotes do not count.
    """
    line = F.col("value")
    if escape != '"':
        line = F.regexp_replace(line, ("\\\\" if escape == "\\" else re.escape(escape)) + ".", "")
    part = re.escape(sep)
    quotes = F.size(F.regexp_extract_all(line, F.lit(f'(?:(?:^|(?<={part}))"|"(?:$|(?={part}|\r)))'), F.lit(0)))
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), quotes.alias("n"))
    odd = (lines.groupBy("file").agg(F.sum("n").alias("n")) if multi_line else lines).filter("n % 2 = 1").take(1)
    if odd:
        raise ValueError(f"quote not closed in {odd[0]['file']}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_rows(spark: SparkSession, rows: list[tuple], attributes: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, schema(attributes))


def identity(df: DataFrame) -> str:
    """The files that a DataFrame reads, with their lengths and times; its plan if it reads none."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in sorted(df.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        state = at.getFileSystem(conf).getFileStatus(at)
        out.append(f"{f} {state.getLen()} {state.getModificationTime()}")
    return "\n".join(out) or df._jdf.queryExecution().analyzed().canonicalized().toString()


def cached_scan(df: DataFrame, table: str, where: Predicate | None, folder: str) -> DataFrame:
    """The scan of a table, filtered or whole, kept as Parquet under a name made of the table, its source's state and its predicate's canonical text."""
    spark = df.sparkSession
    text = "\n".join((where.pretty() if where is not None else "all rows", ",".join(df.columns), identity(df)))
    path = f"{folder}/{table}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        (df.filter(where.compile(F.col)) if where is not None else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """One column `line`: values joined by |, strings quoted and escaped, NULL spelled out."""

    def cell(f: T.StructField) -> F.Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            quoted = c
            for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                quoted = F.replace(quoted, F.lit(raw), F.lit(shown))
            c = F.concat(F.lit('"'), quoted, F.lit('"'))
        return F.coalesce(c.cast("string"), F.lit("NULL"))

    return df.select(F.concat_ws("|", *map(cell, df.schema.fields)).alias("line"))
