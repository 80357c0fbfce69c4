"""Near-duplicate groups by Order MinHash, verified by banded alignment.

Words are lower-cased and stripped of outer punctuation. A text's k-mers are its runs of five words, each labelled with
its occurrence number. Each of SKETCHES hash orders picks the two k-mers with the smallest labelled hashes and
keeps them in text order; their hash is one value of the sketch, so two texts share it if they share the same k-mers in
the same order. Candidates share a value. They are linked if the edit similarity of their words,
1 - distance / longer length, is SIMILARITY or more, found by bit-parallel alignment in a band that is doubled until
the distance fits or exceeds what the similarity admits. Groups are the connected components of links.

Reach: README.md has the measured share of pairs that share a value, by edit similarity. Texts that edits have left
without common k-mers are not found, even where their edit similarity is high (short texts).

Skew: equal texts are one representative from the start (a partial aggregate). A bucket (the texts with one value) is not
paired out: first each text meets the least leader of its buckets, then, where groups still differ, all its buckets'
leaders. The buckets that hold several groups even then (a passage that many texts share) are dealt to blocks of about BLOCK texts,
and each two blocks meet in one task, but for those of the bucket's largest group among themselves. There a pair is left out if its lengths or
its maps of words (a bit for each word) prove that it is not similar, and it is looked at in the first bucket that it shares. Texts with a pair that
is left meet once more, with their words, in blocks of about INNER, and are aligned there; what is written is texts and links between groups, never pairs
of texts, and groups that a block has linked are not aligned in it again. No two texts that share a value and are similar end in different groups, whatever the
size of the bucket; there is no limit on rounds, candidates or partners. Pairs within a group are not searched for.
A bucket of m groups costs m * m / 2 comparisons of bits and m / BLOCK copies of its rows; m' texts with a pair that is left cost m' / INNER copies of theirs.

Defined cases: texts without words (null, empty, marks alone) are groups of their own unless they are equal, non-empty texts; texts
of fewer than five words have one k-mer, the whole text; rows with one doc_id and equal texts are one row
of the result each; a doc_id with several texts is represented once per text; the group's id is its least doc_id; an empty table gives
no rows; other columns are not read by the operator, and the stage passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, drop_caches, free_name, word_hashes

K, SKETCHES, SIMILARITY = 5, 64, 0.8
#: Texts of a bucket that meet in one task.
BLOCK = 2048
#: Texts that meet with their words.
INNER = 128
#: Rows with texts or words that go to Python at a time.
ROWS = 1024
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(1, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SKETCHES, np.uint64)
_POS, _MAX = np.uint64((1 << 20) - 1), np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def kmers(texts: list[np.ndarray], k: int = K) -> list[np.ndarray]:
    """Hashes of each text's runs of k words; of the whole text if it is shorter. Texts have one word or more."""
    flat = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    runs = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    for j in range(k):
        runs = _mix(runs + flat[j : j + len(runs)])
    out, at = [], 0
    for w in texts:
        if len(w) >= k:
            out.append(runs[at : at + len(w) - k + 1])
        else:
            one = np.zeros(1, np.uint64)
            for j in range(len(w)):
                one = _mix(one + w[j : j + 1])
            out.append(one)
        at += len(w)
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes mixed with their occurrence numbers: equal ones get different values."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    starts = np.r_[True, s[1:] != s[:-1]]
    if starts.all():
        return grams
    first = np.maximum.accumulate(np.where(starts, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return np.where(nth > 0, _mix(grams + nth * np.uint64(0x9E3779B97F4A7C15)), grams)


def _two_least(marked: np.ndarray, starts: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash order and each text (from `starts` on) the two least  hash << 20 | place in the text;  the second is _MAX if there is one k-mer."""
    h = marked[None, :] * _MUL[:, None]
    h += _ADD[:, None]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= ~_POS
    h |= np.arange(len(marked), dtype=np.uint64) - base
    one = np.minimum.reduceat(h, starts, axis=1)
    at = (one & _POS).astype(np.int64) + starts
    np.put_along_axis(h, at, _MAX, axis=1)
    return one, np.minimum.reduceat(h, starts, axis=1)


def sketches(texts: list[np.ndarray], piece: int = 8192) -> np.ndarray:
    """One row of SKETCHES values for each text of one word or more; several texts are hashed at a time, a long one piece by piece."""
    out = np.empty((len(texts), SKETCHES), np.uint64)
    grams = kmers(texts)
    at = 0
    while at < len(texts):
        end, total = at + 1, len(grams[at])
        while end < len(texts) and total + len(grams[end]) <= piece:
            total += len(grams[end])
            end += 1
        group = grams[at:end]
        flat = np.concatenate(group)
        if total <= piece:
            n = np.array([len(g) for g in group])
            starts = np.cumsum(n) - n
            one, two = _two_least(np.concatenate([labelled(g) for g in group]), starts, np.repeat(starts, n).astype(np.uint64))
            first, second = (one & _POS).astype(np.int64) + starts, np.where(two == _MAX, -1, (two & _POS).astype(np.int64) + starts)
        else:
            marked = labelled(flat)
            found, places = [], []
            for lo in range(0, total, piece):
                for got in _two_least(marked[lo : lo + piece], np.zeros(1, np.int64), np.zeros(1, np.uint64)):
                    found.append(np.where(got == _MAX, _MAX, got & ~_POS))
                    places.append(np.where(got == _MAX, -1, lo + (got & _POS).astype(np.int64)))
            found, places = np.concatenate(found, 1), np.concatenate(places, 1)
            order = np.argsort(found, axis=1, kind="stable")[:, :2]
            first, second = (np.take_along_axis(places, order[:, k : k + 1], 1) for k in (0, 1))
        low, high = np.where(second < 0, first, np.minimum(first, second)), np.maximum(first, second)
        value = _mix(_ADD[:, None] + flat[low])  # k-mers in text order, without labels
        out[at:end] = np.where(second < 0, value, _mix(value + flat[high])).T
        at = end
    return out


def banded_distance(a: list[int], b: list[int], most: int, least: int = 0) -> int:
    """Edit distance of word sequences, known to be `least` or more, if it is at most `most`, else most + 1. Bit-parallel, in a band around the diagonal."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < len(a) - lo and end < len(b) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    band = max(8, len(a) - len(b), least)
    while True:
        band = min(band, most)
        got = _in_band(len(a), b, places, band)
        if got <= band:
            return got
        if band == most:
            return most + 1
        band *= 4


def _in_band(n: int, b: list[int], places: dict[int, int], band: int) -> int:
    """Distance within a band: column j covers the rows j - band .. j + band of the longer sequence, as vertical differences in bits."""
    width = 2 * band + 1
    full = (1 << width) - 1
    # bit r of column j stands for row j - band + r; rows below 1 cost as if inserted
    vp, vn = full ^ ((1 << (band + 1)) - 1), 0  # rows 1.. of column 0 rise by one each
    vp &= full
    # value at the band's lower edge, row j + band
    score = band
    for j, x in enumerate(b, 1):
        low = j - band  # row of bit 0, from 1
        got = places.get(x, 0)
        eq = (got >> (low - 1) if low >= 1 else got << (1 - low)) & full
        # the window moves down one row: differences move up one bit, and the new lowest row starts at +1
        vp, vn = (vp >> 1) | (1 << (width - 1)), vn >> 1
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        # the lower edge follows the diagonal
        score += not (d0 >> (width - 1)) & 1
        hp1 = (hp << 1) | (1 if low <= 1 else 0)
        hn1 = hn << 1
        vp = (hn1 | (full & ~(d0 | hp1))) & full
        vn = d0 & hp1 & full
    # from the lower edge (row m + band) up to row n
    row = len(b) + band
    for r in range(width - 1, width - 1 - (row - n), -1):
        score -= (vp >> r) & 1
        score += (vn >> r) & 1
    return score


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts have in common, repeats counted; of labelled words, faster if they are sorted."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, marked: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """Whether the edit similarity of two word sequences is `least` or more. marked: their labelled words, where they are at hand."""
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if n == 0 or abs(len(a) - len(b)) > most:
        return False
    alone = n - shared_words(*(marked or (labelled(a), labelled(b))))  # words that have no partner cost one edit each at least
    return alone <= most and banded_distance(a.tolist(), b.tolist(), most, alone) <= most


def digest(text: Column) -> Column:
    """128 bits of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sketched(documents: DataFrame) -> DataFrame:
    """_id, digest of the text, n (words), values (one per hash order; none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, len(batch), 256)):
                found = word_hashes(part["text"])
                n = np.array([len(w) for w in found])
                values = sketches([w for w in found if len(w)])
                ends = np.concatenate([[0], np.cumsum(n > 0)]) * SKETCHES
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part["_id"], part["digest"], pa.array(n, pa.int32()), lists], names=["_id", "digest", "n", "values"])

    src = documents.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), digest(F.col("text")).alias("digest"))
    return src.mapInArrow(run, "_id long, digest binary, n int, values array<bigint>")


def word_bits(words: np.ndarray) -> np.ndarray:
    """A bit for each word, in a map of four bits a word or more; maps of texts with less words are what is left when halves are laid over each other."""
    size = 1 << max(9, int(4 * len(words) - 1).bit_length())
    out = np.zeros(size, bool)
    out[(labelled(words) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def word_table(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, n, words (their 32-bit hashes), bits, of the representatives (rep, digest). One text of each digest is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, len(batch), 256)):
                words = [w >> np.uint64(32) for w in word_hashes(part["text"])]
                made = [pa.array([w.astype("<u4").tobytes() for w in words], pa.binary()), pa.array([word_bits(w).tobytes() for w in words], pa.binary())]
                yield pa.RecordBatch.from_arrays([part["rep"], pa.array([len(w) for w in words], pa.int32()), *made], names=["rep", "n", "words", "bits"])

    texts = documents.select(digest(F.col("text")).alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    return texts.join(reps, "digest").select("rep", "text").mapInArrow(run, "rep long, n int, words binary, bits binary")


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (u, v) of representatives whose texts are similar. words: rep, words."""
    u = words.select(F.col("rep").alias("u"), F.col("words").alias("words_u"))
    v = words.select(F.col("rep").alias("v"), F.col("words").alias("words_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_caches()
        of = lambda x: np.frombuffer(x, "<u4").astype(np.uint64)
        for batch in batches:
            ok = [similar(of(a), of(b)) for a, b in zip(batch["words_u"], batch["words_v"], strict=True)]
            yield batch.loc[ok, ["u", "v"]]

    return pairs.join(u, "u").join(v, "v").select("u", "v", "words_u", "words_v").mapInPandas(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component), for the nodes of edges (u, v).

    Every node is drawn into its least neighbour and the edges between what remains go on, so that stars are gone after one
    step and chains halve; the steps' maps are then composed.
    """
    edges = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = cut(both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("node"), F.least("u", "_m").alias("label")))
        maps.append(into)
        a, b = into.select(F.col("node").alias("u"), F.col("label").alias("lu")), into.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        moved = edges.join(a, "u").join(b, "v").filter("lu <> lv")
        edges = cut(moved.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = maps[0]
    for m in maps[1:]:
        labels = relabelled(labels, m)
    return labels


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels, of which those that are nodes of `more` take its label."""
    m = more.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return labels.join(m, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))


def _may_be_similar(n: np.ndarray, bits: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of some texts, which come by n, the later ones that lengths and word maps admit.

    A word of one text whose bit the other's map lacks has no partner, and a text of n words, the longer one, has at most (1 - SIMILARITY) n of these.
    """
    sizes = np.array([len(x) for x in bits])
    maps: dict[tuple[int, int], np.ndarray] = {}

    def laid(size: int, to: int) -> np.ndarray:
        """The maps of one size, laid over to a smaller one."""
        if (size, to) not in maps:
            x = np.frombuffer(b"".join(bits[k] for k in np.flatnonzero(sizes == size)), np.uint64).reshape(-1, size // to, to // 8)
            maps[size, to] = np.bitwise_or.reduce(x, axis=1)
        return maps[size, to]

    place = np.zeros(len(n), np.int64)  # among the maps of its size
    for size in set(sizes.tolist()):
        place[sizes == size] = np.arange((sizes == size).sum())
    last = np.searchsorted(n, n / SIMILARITY + 1e-6, side="right")
    for i in range(len(n)):
        x = laid(int(sizes[i]), int(sizes[i]))[place[i]]
        found = []
        at = i + 1
        while at < last[i]:  # sizes come in order too
            size = int(sizes[at])
            end = min(int(last[i]), int(np.searchsorted(sizes, size, side="right")))
            y = laid(size, len(x) * 8)[place[at] : place[at] + end - at]
            most = (n[at:end] * (1 - SIMILARITY) + 1e-6).astype(np.int64)  # y is the longer one
            alone = np.bitwise_count(x & ~y).sum(1, dtype=np.int64) + n[at:end] - n[i]
            found.append(at + np.flatnonzero((alone <= most) & (np.bitwise_count(y & ~x).sum(1, dtype=np.int64) <= most)))
            at = end
        yield i, np.concatenate(found) if found else np.empty(0, np.int64)


def _candidates(part: pd.DataFrame, known: Callable[[int, int], bool] = lambda i, j: False) -> Iterator[tuple[int, int]]:
    """Places of the pairs of a block that are of different groups, may be similar and share no earlier bucket; without those that are known by then."""
    value, crossed = int(part["value"].iloc[0]), int(part["low"].iloc[0]) != int(part["high"].iloc[0])
    label, upper, own = part["label"].to_numpy(), part["upper"].to_numpy(), part["values"].to_numpy()
    if (label == label[0]).all():
        return
    for i, js in _may_be_similar(part["n"].to_numpy(np.int64), part["bits"].tolist()):
        js = js[label[js] != label[i]]
        if crossed:
            js = js[upper[js] != upper[i]]
        for j in js.tolist():
            if not known(i, j) and int(np.intersect1d(own[i], own[j], assume_unique=True)[0]) == value:
                yield i, j


def in_blocks(members: DataFrame, labels: DataFrame, words: DataFrame, block: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `work` makes of each two blocks of a bucket (value, rep). labels: node, label. words: rep, n, bits, which `work` gets with all other columns."""
    own = members.groupBy("rep").agg(F.sort_array(F.collect_list("value")).alias("values"))  # SKETCHES at most
    info = own.join(labels.withColumnRenamed("node", "rep"), "rep").join(words, "rep")
    lean = members.join(labels.withColumnRenamed("node", "rep"), "rep")
    most = lean.groupBy("value", "label").agg(F.count("*").alias("k")).groupBy("value").agg(F.max(F.struct("k", "label")).alias("m"))
    lean = lean.join(cut(most.select("value", F.col("m.label").alias("major"))), "value").select("value", "rep", (F.col("label") == F.col("major")).alias("main"))
    sizes = lean.groupBy("value").agg(F.ceil(F.sum(F.col("main").cast("int")) / block).alias("a"), F.ceil(F.sum((~F.col("main")).cast("int")) / block).alias("b"))
    lean = cut(lean.join(cut(sizes), "value"))
    # blocks 0 .. a - 1 are of the largest group, a .. a + b - 1 of the others; two of the former need not meet
    mine = F.when(F.col("main"), F.pmod(F.xxhash64("rep"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("rep"), F.greatest("b", F.lit(1).cast("long"))))
    lean = lean.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.when(F.col("main"), F.col("a")).otherwise(F.lit(0).cast("long")), F.col("a") + F.col("b") - 1)))
    lean = lean.select("value", "rep", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("upper"))
    # a bucket of one block for each side is one group
    dealt = lean.join(info, "rep").repartition("value", "low", "high").sortWithinPartitions("value", "low", "high", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_caches()
        left = None
        for batch in batches:
            batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
            keys = batch[["value", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for lo, hi in zip(starts, starts[1:], strict=False):
                yield work(batch.iloc[lo:hi])
            left = batch.iloc[starts[-1] :]
        if left is not None and len(left):
            yield work(left)

    return dealt.mapInPandas(run, schema)


def block_pairs(members: DataFrame, labels: DataFrame, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: the pairs of different groups that share a bucket (value, rep) and may be similar, each once; as many as there are. labels: node, label. words: rep, n, bits."""

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        rep = part["rep"].to_numpy()
        found = [(max(rep[i], rep[j]), min(rep[i], rep[j])) for i, j in _candidates(part)]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["u", "v"])

    return in_blocks(members, labels, words.select("rep", "n", "bits"), block, pairs, "u long, v long")


def block_links(members: DataFrame, labels: DataFrame, words: DataFrame, block: int = BLOCK, inner: int = INNER) -> DataFrame:
    """u, v: groups that similar texts of a common bucket (value, rep) link, of each two blocks no more than join their groups. words: rep, n, words, bits.

    First maps alone meet, and a text comes back, once a bucket, if it has a partner that may be similar. Those texts meet again, with their words,
    and are aligned there, but for pairs whose groups the block has linked by then. No pair is written.
    """

    def partnered(part: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(len(part), bool)
        for i, j in _candidates(part, lambda i, j: some[i] and some[j]):
            some[i] = some[j] = True
        return part.loc[some, ["value", "rep"]]

    def links(part: pd.DataFrame) -> pd.DataFrame:
        label, found = part["label"].tolist(), []
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while x in top:
                top[x] = x = top.get(top[x], top[x])
            return x

        text = [np.frombuffer(x, "<u4").astype(np.uint64) for x in part["words"]]
        marked = [np.sort(labelled(x)) for x in text]
        for i, j in _candidates(part, lambda i, j: root(label[i]) == root(label[j])):
            if similar(text[i], text[j], SIMILARITY, (marked[i], marked[j])):
                top[root(label[i])] = root(label[j])
                found.append((label[i], label[j]))
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["u", "v"])

    met = cut(in_blocks(members, labels, words.select("rep", "n", "bits"), block, partnered, "value long, rep long").distinct(), ROWS)
    return in_blocks(met, labels, words, inner, links, "u long, v long")


def near_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text digest): doc_id, group_id (the least doc_id of the group), digest, label (one per group, also where ids are null)."""
    drawn = cut(sketched(documents), ROWS)
    reps = drawn.groupBy("digest").agg(F.min("_id").alias("least"), F.first("n").alias("n"), F.first("values").alias("values"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))  # kept by the written table
    spread = reps.filter("n > 0").select("rep", F.explode("values").alias("value"))
    # the least representative leads its bucket; joins by value are with written tables, so that adaptive execution can split a large bucket
    lead = spread.groupBy("value").agg(F.min("rep").alias("leader"), F.max("rep").alias("_max")).filter("leader <> _max").drop("_max")
    members = cut(spread.join(cut(lead), "value"))
    wanted = members.select("rep").distinct()
    words = cut(word_table(documents, reps.join(wanted, "rep").select("rep", "digest")), ROWS)

    star = members.filter("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    tried = star.groupBy("u").agg(F.min("v").alias("v"))
    nodes = wanted.select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    labels = cut(relabelled(nodes, components(cut(verified(tried, words), ROWS))))

    def grouped(pairs: DataFrame) -> DataFrame:
        """The pairs of different groups, with their groups lu, lv."""
        a, b = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        return pairs.join(a, "u").join(b, "v").filter("lu <> lv")

    def joined(pairs: DataFrame) -> DataFrame:
        """The groups after the pairs are verified."""
        found = grouped(cut(verified(pairs, words), ROWS)).select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        return cut(relabelled(labels, components(found)))

    # the other leaders, which join most groups
    labels = joined(grouped(star.distinct()).select("u", "v"))
    # what buckets of several groups still hold
    now = members.select("value", "rep").join(labels.withColumnRenamed("node", "rep"), "rep")
    mixed = now.groupBy("value").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("value")
    rest = cut(members.join(cut(mixed), "value").select("value", "rep"))
    labels = cut(relabelled(labels, components(cut(block_links(rest, labels, words), ROWS))))
    named = reps.select("digest", "rep", "least").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    ids = cut(named.groupBy("label").agg(F.min("least").alias("group_id")))
    named = cut(named.join(ids, "label").select("digest", "label", "group_id"))
    blank = digest(F.lit(""))
    rows = drawn.select("_id", "digest").join(named, "digest")
    return rows.select(F.col("_id").alias("doc_id"), F.when(F.col("digest") == blank, F.col("_id")).otherwise(F.col("group_id")).alias("group_id"), "digest", "label")


def grouped_documents(documents: DataFrame) -> DataFrame:
    """The rows that op1 returns: every row's group."""
    return near_groups(documents.select("doc_id", "text")).select("doc_id", "group_id")


def near_stage(documents: DataFrame) -> DataFrame:
    """One document of each group (the least doc_id, its least digest) and each empty one, with the columns of documents.

    Documents are told apart by doc_id and text: a null doc_id, or one with several texts, is one document per text.
    """
    groups = near_groups(documents.select("doc_id", "text"))
    # empty texts are groups of their own
    own = F.when(F.col("digest") == digest(F.lit("")), F.col("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k")
    keep = groups.groupBy("label", own.alias("own")).agg(least).select(F.col("k.doc_id").alias("_kept_id"), F.col("k.digest").alias("_kept_digest"))
    mark = free_name(documents, "_digest")
    told = documents.withColumn(mark, digest(F.col("text")))
    kept = told.join(keep, told["doc_id"].cast("long").eqNullSafe(keep["_kept_id"]) & (told[mark] == keep["_kept_digest"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).drop(mark)
