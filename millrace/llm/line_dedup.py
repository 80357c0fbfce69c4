"""Line dedup: the suffix array over line-ID sequences, by distributed prefix doubling; later copies of maximal repeated runs go.

A document is the sequence of the IDs (two 64-bit hashes) of its lines that hold words. Doubling round k names the 2^k
lines that start at each position by the names of their halves; equal names are equal runs, so the positions with one name are one
interval of the suffix array, whose longest common prefix is 2^k lines at least. Positions whose name is unique leave the
work, and it ends when none is left. The order among intervals carries no meaning for hashed IDs and is not computed.

Then the intervals of all other lengths are found by descending the powers of two: an interval of common prefix n
falls apart by the names of the 2^m lines that follow its prefix, and each part of two positions or more is an interval of common prefix
n + 2^m. The first position of a part stays behind as its witness, all others go on, so that at the end
every position knows its longest previous factor: the longest run of lines from it on that also starts at an earlier position.

What goes: the lines of every such run (so of every maximal repeated run, as its later copy) that holds MIN_WORDS words or more
in all. Earlier is by doc_id, then text hash, then line. The first copy of a line always stays.

Skew: names are grouped by partial aggregation; their members are found by joins with a written table of repeated names, which adaptive
execution can split, so a line that a third of all rows hold is no task of its own. No group is gathered.

Defined cases: null texts are empty; lines without words are kept and are no part of a run; rows with the same doc_id and
text are one document and get one result; a null doc_id comes first; a run may overlap its earlier copy (a line repeated n times
stays once); texts that change keep their other lines as they were; texts of any length are read whole; an empty table gives no rows;
all other columns pass through whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import cut

MIN_WORDS = 6
_AT = ("_d", "_h", "_s")


def _name(*parts: Column | str) -> Column:
    """128 bits in two hashes."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(97), *parts).alias("b"))


def _place() -> Column:
    """Of the corpus order; nulls come first."""
    return F.struct(*_AT)


def has_words(text: Column) -> Column:
    """words_in(text) > 0, by a look at the text up to its first character that is no white space."""
    return text.rlike("[^ \t\n\x0b\x0c\r]")


def line_table(documents: DataFrame) -> DataFrame:
    """Every line with words: document (_d, _h), place among these lines (_s), name."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_words)
    names = F.transform(lines, lambda x: _name(x))
    return documents.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), F.posexplode(names).alias("_s", "name"))


def shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """_g0, _g1 ..: the values of `by` that stand at two places or more, and _first, the first of these. A written table, so that joins with it can be split."""
    groups = rows.groupBy(*by).agg(F.min(_place()).alias("_first"), F.max(_place()).alias("_last")).filter("NOT (_first <=> _last)")
    return cut(groups.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_first"))


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose name stands at two places or more, with `later`: not the first of these."""
    joined = rows.join(shared(rows, ["name"]), F.col("name") == F.col("_g0"))
    return joined.select(*rows.columns, (~_place().eqNullSafe(F.col("_first"))).alias("later"))


def _ahead(rows: DataFrame, names: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """rows with `next`: the name at the place `by` lines further on in the same document."""
    right = names.select(F.col("_d").alias("_rd"), F.col("_h").alias("_rh"), F.col("_s").alias("_rs"), F.col("name").alias("next"))
    on = F.col("_d").eqNullSafe(F.col("_rd")) & (F.col("_h") == F.col("_rh")) & (F.col("_s") + by == F.col("_rs"))
    return rows.join(right, on, how).drop("_rd", "_rh", "_rs")


def doubled(documents: DataFrame, longest: int | None = None) -> list[DataFrame]:
    """For k = 0, 1, ..: the places of runs of 2^k lines that are repeated, with name and later."""
    levels = [cut(repeated(line_table(documents)).dropDuplicates(list(_AT)))]
    while longest is None or 1 << len(levels) <= longest:
        at = levels[-1].select(*_AT, "name")
        pairs = _ahead(at, at, F.lit(1 << len(levels) - 1)).select(*_AT, _name("name", "next").alias("name"))
        found = cut(repeated(pairs))
        if found.isEmpty():
            break
        levels.append(found)
    return levels


def previous_factors(documents: DataFrame, longest: int | None = None) -> DataFrame:
    """_d, _h, _s, length: for every place whose line stands at an earlier place, the lines of the longest run from there on that does."""
    levels = doubled(documents, longest)
    top = len(levels) - 1
    later = [x.filter("later").select(*[F.col(c).alias(f"_k{c}") for c in _AT]) for x in levels]
    out, parts = [], None

    def own(k: int) -> DataFrame:
        """The members of the intervals of 2^k lines that have no earlier copy of 2^(k+1): those after the first are to be extended."""
        rows = levels[k].select(*_AT, F.lit(1 << k).alias("length"), F.col("name").alias("node"), F.col("later").alias("active"))
        if k == top:
            return rows
        x = later[k + 1]
        on = F.col("_d").eqNullSafe(F.col("_k_d")) & (F.col("_h") == F.col("_k_h")) & (F.col("_s") == F.col("_k_s"))
        return rows.join(x, on, "left_anti")

    for m in range(top - 1, -1, -1):
        parts = own(m + 1) if parts is None else parts.unionByName(own(m + 1))
        parts = cut(_ahead(parts, levels[m], F.col("length"), "left"))
        on = (F.col("node") == F.col("_g0")) & (F.col("next") == F.col("_g1"))
        found = parts.join(shared(parts.filter("next IS NOT NULL"), ["node", "next"]), on, "left")
        stays = F.struct("length", "node", "active")
        goes = lambda active: F.struct((F.col("length") + (1 << m)).alias("length"), _name("node", "next").alias("node"), active.alias("active"))
        # the first of a part of two or more stays, and goes on as its witness
        to = F.when(F.col("_first").isNull(), F.array(stays)).when(_place().eqNullSafe(F.col("_first")), F.array(stays, goes(F.lit(False)))).otherwise(F.array(goes(F.col("active"))))
        parts = found.select(*_AT, F.explode(to).alias("x")).select(*_AT, "x.length", "x.node", "x.active")
    out.append(own(0).filter("active").select(*_AT, "length"))
    if parts is not None:
        out.append(cut(parts.filter("active").select(*_AT, "length")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_deleted", T.LongType())]))
def _without(texts: pd.Series, starts: pd.Series, lengths: pd.Series, least: pd.Series) -> pd.DataFrame:
    """Texts without the lines of runs of `least` words or more; runs count the lines with words."""
    out = []
    for text, at, n, most in zip(texts, starts, lengths, least, strict=True):
        if at is None or len(at) == 0:
            out.append((text, 0))
            continue
        lines = text.split("\n")
        words = [len(x.encode().split()) for x in lines]  # parted by ASCII white space
        places = [k for k, w in enumerate(words) if w]
        upto = [0]
        for k in places:
            upto.append(upto[-1] + words[k])
        gone, end = set(), 0
        for s, run in sorted(zip(at.tolist(), n.tolist(), strict=True)):
            if s + run > end and upto[s + run] - upto[s] >= most:
                gone.update(places[max(s, end) : s + run])
                end = s + run
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_deleted"])


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, longest: int | None = None) -> DataFrame:
    """The documents without later copies, as struct columns: row (the columns as they were) and new (text, n_deleted). Null texts become empty.

    longest: the doubling stops at runs of so many lines (for tests)."""
    runs = previous_factors(documents.select("doc_id", "text"), longest).groupBy("_d", "_h").agg(F.collect_list(F.struct("_s", "length")).alias("runs"))
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    on = F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("row.text") == F.col("_h"))
    joined = docs.join(runs, on, "left")
    new = _without(F.coalesce(F.col("row.text"), F.lit("")), F.col("runs")["_s"], F.col("runs")["length"], F.lit(min_words))
    return joined.select("row", new.alias("new"))


def deduped_documents(documents: DataFrame, longest: int | None = None) -> DataFrame:
    """The rows that op3 returns."""
    return dedup_lines(documents.select("doc_id", "text"), longest=longest).select("row.doc_id", "new.text", "new.n_deleted")


def line_stage(documents: DataFrame) -> DataFrame:
    """Documents without later copies, with the columns of documents; those of which no word is left go."""
    out = dedup_lines(documents).filter((F.col("new.n_deleted") == 0) | has_words(F.col("new.text")))
    return out.select(*[F.col("new.text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
