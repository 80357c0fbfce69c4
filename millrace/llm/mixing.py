"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: `share` of all words is dealt to the sources by weight; a source's target stops at `cap` times its own
words and the excess is dealt out again by weight until no target is above its cap (solved in one pass over the
sources, which are sorted by the level at which they fill).
Tape: a source's documents in an order shuffled by hash, repeated end to end `cap` times, cut into blocks of BLOCK words.
Schedule: there is a slot for every BLOCK words of all targets. Slot i is the point  i * golden ratio mod 1 (in 31-bit integers, so
exact at any i), mapped through the cumulative targets to a source; a source's slots are ranked in order, and its k-th
slot takes its k-th block. What the mix takes is what the scheduled blocks hold, no more and no less: a source's words differ
from its target by the discrepancy of the points (of n slots, less than 2 + ln(n) / 2 blocks for each source; the tests hold it to that), and
by the end of its tape, where it is taken cap times over.
Running positions and ranks are sums over cells of bounded size, so that a source with a third of all rows
never meets in one task; only the table of sources (one row each) is gathered for the cumulative targets.

Defined cases: null and wordless texts have size 0, take 0 words and have no slot; a null source is a source, the last; repeated
rows count as often as they come; a document of any length is cut by blocks; an empty table gives no rows; columns besides id, text and source are not
read, and the stage passes them through whatever their names. Reruns agree: order and schedule depend on the data alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, running_start

GOLDEN, BITS = 1327217885, 31  # round(2**31 / golden ratio)
#: Grid over [0, 1) by which points find their source.
GRID = 4096
WEIGHTS = (3, 1, 2)
#: Words of a block.
BLOCK = 128


def words_in(text: Column) -> Column:
    """The number of runs of characters other than space and \\t \\n \\v \\f \\r."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target, and the cumulative shares lo and hi of all targets."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double")).withColumn("most", cap * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    all_ = Window.partitionBy()
    filling = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    dealt = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("even", (share * F.sum("source_size").over(all_) - dealt) / (F.sum("weight").over(all_) - weighed))
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.first(F.when(F.col("level") > F.col("even"), F.col("even")), ignorenulls=True).over(whole)
    by = by.withColumn("target", F.when(found.isNull(), F.col("most")).otherwise(F.least(F.col("most"), found * F.col("weight"))))
    upto = names.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(all_)
    hi = F.when(total > 0, F.sum("target").over(upto) / total).otherwise(0.0)
    return by.withColumn("hi", hi).select("source", "source_size", "target", (F.col("hi") - F.when(total > 0, F.col("target") / total).otherwise(0.0)).alias("lo"), "hi")


def schedule(targets: DataFrame, slots: int, golden: int = GOLDEN) -> DataFrame:
    """slot, source, block (the source's k-th): which block each slot of the mix takes."""
    spark = targets.sparkSession
    edge = lambda c: (F.col(c) * (1 << BITS)).cast("long")
    known = targets.select("source", edge("lo").alias("lo"), F.when(F.col("hi") > 1 - 1e-12, F.lit(1 << BITS)).otherwise(edge("hi")).alias("hi"))
    wide = (1 << BITS) // GRID
    cells = known.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(1 << BITS)) * golden, F.lit(1 << BITS)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") / wide))
    placed = points.join(cells, "cell").filter("u >= lo AND u < hi").select("slot", "source", F.lit(1).alias("one"))
    return running_start(placed, ["source"], ["slot"], "one", "block", F.shiftright("slot", 14)).select("slot", "source", "block")


def mix(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = 7, golden: int = GOLDEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (doc_id, source, size): the placed rows (with `at`, the tape position, and the source's figures),
    the schedule, and the pieces (slot, source, block, doc_id, size, at, pass, start, length) that the mix takes."""
    sizes = cut(sizes.select("doc_id", "source", "size"))
    targets = cut(source_targets(sizes, share, cap))
    n = sizes.count()
    slots = int((targets.agg(F.sum("target")).first()[0] or 0.0) / block + 0.5)
    cell_bits = max(0, (n // 2000).bit_length())
    shuffled = sizes.withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed)))
    placed = running_start(shuffled, ["source"], ["key", "doc_id", "size"], "size", "at", F.shiftright("key", 64 - cell_bits) if cell_bits else F.lit(0))
    plan = cut(schedule(targets, slots, golden))
    have = plan.groupBy("source").agg(F.count("*").alias("blocks"))
    # the scheduled blocks of a source are the first ones of its tape; a written table of sources is broadcast if it is small, and can be split from if not
    t = targets.join(have, targets["source"].eqNullSafe(have["source"]), "left").select(
        targets["source"].alias("_s"), "source_size", "target", F.least(F.coalesce("blocks", F.lit(0)) * block, F.floor(cap * F.col("source_size"))).alias("end")
    )
    placed = cut(placed.join(cut(t), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "at", "source_size", "target", "end"))
    runs = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("end") / F.col("source_size")).cast("int") - 1, F.lit(0)))))
    runs = runs.withColumn("lo", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "end")).filter("hi > lo")
    runs = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    parts = runs.withColumn("start", F.greatest(F.lit(0), F.col("block") * block - F.col("lo"))).withColumn("length", F.least("hi", (F.col("block") + 1) * block) - F.col("lo") - F.col("start"))
    p = plan.select("slot", F.col("source").alias("_s"), F.col("block").alias("_b"))
    pieces = parts.join(p, parts["source"].eqNullSafe(p["_s"]) & (parts["block"] == p["_b"])).select("slot", "source", "block", "doc_id", "size", "at", "pass", "start", "length")
    return placed.drop("end"), plan, pieces


def sizes_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"))


def mixed_documents(documents: DataFrame, golden: int = GOLDEN) -> DataFrame:
    """The rows that op7 returns: what the mix takes of every document, from its first slot on."""
    placed, _, pieces = mix(sizes_of(documents), golden=golden)
    no = F.lit(None).cast("long")
    own = ("doc_id", "source", "size", "at")
    none = placed.select(*own, "source_size", "target", F.lit(0).cast("long").alias("length"), no.alias("slot"), F.lit(1).cast("long").alias("row"))
    figures = (no.alias("source_size"), F.lit(None).cast("double").alias("target"))
    took = pieces.select(*own, *figures, F.col("length").cast("long"), "slot", F.lit(0).cast("long").alias("row"))
    sums = [
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("length").alias("taken"),
        F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"), F.sum("row").alias("rows"),
    ]
    rows = none.unionByName(took).groupBy(*own).agg(*sums)
    # rows with one position are wordless, and alike
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def mix_stage(documents: DataFrame) -> DataFrame:
    """Documents as the mix takes them, with the columns of documents.

    A document comes once for each pass of which the scheduled blocks hold at least half of its words; wordless documents come
    once. Of rows that agree in id, source and size, each comes as often as they do on average, rounded up.
    """
    placed, _, pieces = mix(sizes_of(documents))
    key = ["doc_id", "source", "size"]
    passes = pieces.groupBy(*key, "at", "pass").agg(F.sum("length").alias("got")).filter("2 * got >= size")
    times = passes.groupBy(*key).agg(F.count("*").alias("n")).withColumn("rows", F.lit(0).cast("long"))
    rows = placed.groupBy(*key).agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("n"), F.count("*").alias("rows"))
    times = rows.unionByName(times).groupBy(*key).agg(F.ceil(F.sum("n") / F.sum("rows")).cast("int").alias("times")).filter("times > 0")
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    docs = docs.withColumn("words", words_in(F.col("row.text")))
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    out = docs.join(times, on).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return out.select("row.*")
