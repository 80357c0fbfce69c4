"""Vector bin packing: a dot-product heuristic under limits on tokens, segments and loss-bearing tokens.

Documents may be cut anywhere, so whole blocks of a long document fill sequences alone. What is left over is
placed by the bin-centric dot-product heuristic: of all pieces that fit the open sequence, the one whose demand
vector has the largest weighted dot product with the sequence's free capacity. When none fits, the largest piece
is cut to the space left. A sequence that a limit keeps short, or the last of a partition, is dealt out to
sequences whose lengths are powers of two, which need no padding.

Work goes on in windows of bounded rows and bytes over the input's own partitions: no shuffle, no group.
sequence_id is partition << 40 | count, so it is the same in every rerun over the same partitions.

Defined cases: a null text is empty and holds just the closing id; an empty table gives no rows; repeated rows
and ids are packed as often as they come; a null prompt length means that every id bears loss; texts of any length are cut, never shortened;
columns besides the id, the content and the prompt length are not read.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterable, Iterator
from itertools import count, islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import Merges
from millrace.llm.common import worker_cache

SCHEMA = "id long, start long, length long, doc_tokens long, loss long, sequence_id long, offset long, ids_crc32 long, ids binary"
COLUMNS = ["id", "start", "length", "doc_tokens", "loss", "sequence_id", "offset", "ids_crc32", "ids"]


#: The marks that, however many, are parted from the letters before them as one piece.
MARKS = string.punctuation.replace("'", "")
#: The most bytes of a word that is kept.
LONG = 256
_SPACE = re.compile(rb"[ \t-\r]")


def cut(content: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text that end before white space: as few bytes beyond `most` as its words allow."""
    lo = 0
    while lo < len(content):
        space = _SPACE.search(content, lo + most)
        hi = space.start() if space else len(content)
        yield content[lo:hi]
        lo = hi


def values(words: pa.StringArray) -> list[bytes]:
    """The same as to_pylist(), as bytes, without an object of Arrow's for each."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class WordTokenizer:
    """The ids of texts, word by word through a cache that the Python worker keeps from task to task.

    Exact for the lower-casing BPE with word ends, which parts words at white space and drops it: what stands
    between ASCII white space is looked up, once for the texts that are encoded together. New words of plain letters,
    with a few ASCII marks after them at most, are lower-cased and merged here, all at once; every other word goes through the
    library's whole pipeline. At most `most` words are kept, twice over: when they are full, they become the old ones, in which words are looked up that
    are not among the new ones, so that frequent words stay.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.kept, self.old = most, {}, {}
        # BPE works on bytes that stand as printable characters
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        shown = {b: (b if b in shown else 256 + n) for n, b in ((sum(x not in shown for x in range(b)), b) for b in range(256))}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"], shown, model["end_of_word_suffix"])
        # by character, those from U+0180 on being one: whether it is a letter or a mark, the bytes of its lower case
        chars = [chr(c) for c in range(0x180)]
        self.letter = np.array([c.isalpha() and c != "\u0130" for c in chars] + [False])
        self.mark = np.array([c in MARKS for c in chars] + [False])
        self.marks: dict[bytes, bytes] = {}
        lower = [(c.lower() if ok else c).encode() for c, ok in zip(chars, self.letter, strict=False)] + ["\u0180".encode()]
        self.width = np.array([len(c) for c in lower])
        self.lower = np.array([[c[0], c[-1]] for c in lower], np.uint8)

    @classmethod
    def open(cls, path: str, most: int = 250_000) -> WordTokenizer:
        return worker_cache(f"tokenizer {path} {most}", lambda: cls(path, most))

    def _whole(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _marks(self, marks: bytes) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = self._whole(marks.decode())
        return self.marks[marks]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words."""
        text = b" ".join([w if len(w) <= LONG else b"" for w in words]).decode(errors="replace")
        chars = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0x180)
        ends = np.append(np.flatnonzero(chars == 32), len(chars))
        starts = np.append(0, ends[:-1] + 1)
        letter = self.letter[chars]
        # the first character from each place on that is no letter
        stops = np.append(np.where(letter, len(chars), np.arange(len(chars))), len(chars))
        stops = np.minimum.accumulate(stops[::-1])[::-1][starts]
        tails = ends - stops
        marks = np.append(0, np.cumsum(self.mark[chars]))
        upto = np.append(0, np.cumsum(self.width[chars]))
        sizes = upto[stops] - upto[starts]
        plain = (sizes > 0) & (sizes <= Merges.LONGEST) & (tails <= 8) & (marks[ends] - marks[stops] == tails)
        at = np.flatnonzero(plain)
        raw = np.empty(upto[-1], np.uint8)
        raw[upto[1:] - 1] = self.lower[chars, 1]
        raw[upto[:-1]] = self.lower[chars, 0]
        ids, counts = self.merges(raw, upto[starts[at]], sizes[at])
        flat, bounds = ids.tobytes(), np.append(0, 4 * np.cumsum(counts)).tolist()
        out = [b""] * len(words)
        for k, n, a, b in zip(at.tolist(), tails[at].tolist(), bounds, bounds[1:], strict=False):
            out[k] = flat[a:b] + self._marks(words[k][-n:]) if n else flat[a:b]
        odd = np.flatnonzero(~plain).tolist()
        for lo in range(0, len(odd), 1024):
            part = odd[lo : lo + 1024]
            for k, got in zip(part, self.tokenizer.encode_batch_fast([words[k].decode(errors="replace") for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(got.ids, "<u4").tobytes()
        return out

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        got = list(map(self.kept.get, words))
        at = [k for k, ids in enumerate(got) if ids is None]
        if not at:
            return got
        new = [words[k] for k in at]
        found = list(map(self.old.get, new))
        never = [w for w, ids in zip(new, found, strict=True) if ids is None]
        if never:
            learnt = iter(self._learn(never))
            found = [next(learnt) if ids is None else ids for ids in found]
        if len(self.kept) + len(new) > self.most:
            self.kept, self.old = {}, self.kept
        keep = zip(new, found, strict=True)
        self.kept.update(islice(keep if max(map(len, new)) <= LONG else ((w, ids) for w, ids in keep if len(w) <= LONG), self.most))
        for k, ids in zip(at, found, strict=True):
            got[k] = ids
        return got

    def encode(self, contents: Iterable[bytes], together: int = 1 << 21) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return list(self.encode_each(contents, together))

    def encode_each(self, contents: Iterable[bytes], together: int = 1 << 21) -> Iterator[bytes]:
        """The same, text by text. The words of texts of `together` bytes in all are looked up at once; a longer text is cut at white space."""
        group, total = [], 0
        for content in contents:
            if group and total + len(content) > together:
                yield from self._encode(group)
                group, total = [], 0
            if len(content) > together:
                yield b"".join(ids for part in cut(content, together) for ids in self._encode([part]))
            else:
                group.append(content)
                total += len(content)
        if group:
            yield from self._encode(group)

    def _encode(self, contents: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(contents, pa.binary()).view(pa.string()))
        coded = split.flatten().dictionary_encode()
        known = self._look_up(values(coded.dictionary))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, at = np.frombuffer(b"".join(known), "<u4"), coded.indices.to_numpy()
        counts = size[at]
        upto = np.append(0, np.cumsum(counts))
        raw = ids[np.repeat((np.cumsum(size) - size)[at] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        bounds = (4 * upto[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class Piece:
    """What is left of one document: ids from `at` on are not placed yet; those from `prompt` on bear loss."""

    __slots__ = ("at", "id", "ids", "n", "prompt")

    def __init__(self, id_: int, ids: bytes, prompt: int):
        self.id, self.ids, self.n, self.prompt, self.at = id_, ids, len(ids) // 4, prompt, 0

    def demand(self, k: int) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens of the next k ids."""
        return k, 1, max(0, self.at + k - max(self.at, self.prompt))

    def fitting(self, tokens: int, loss: int) -> int:
        """The most ids, of the next `tokens`, of which at most `loss` bear loss."""
        return max(0, min(tokens, max(0, self.prompt - self.at) + loss))


def pack_window(pieces: list[Piece], capacity: np.ndarray, number: Iterator[int], flush: bool, with_ids: bool = True) -> tuple[list[tuple], list[Piece]]:
    """Rows of placed ids, and the pieces that wait for the next window (none if flush)."""
    rows: list[tuple] = []
    size = int(capacity[0])

    def emit(parts: list[tuple[Piece, int]], length: int) -> list[tuple[Piece, int]]:
        """One sequence of the first `length` ids of parts; returns what is left of parts."""
        seq, offset, left = next(number), 0, []
        for p, k in parts:
            use = min(k, length - offset)
            if use:
                ids = p.ids[4 * p.at : 4 * (p.at + use)]
                rows.append((p.id, p.at, use, p.n, p.demand(use)[2], seq, offset, crc32(ids), ids if with_ids else None))
                p.at += use
                offset += use
            if use < k:
                left.append((p, k - use))
        return left

    for p in pieces:
        while p.n - p.at >= size and p.fitting(size, int(capacity[2])) == size:
            emit([(p, size)], size)
    items = [p for p in pieces if p.at < p.n]
    demand = np.array([p.demand(p.n - p.at) for p in items], np.int64).reshape(-1, 3)
    weight = demand.sum(0) / capacity.astype(float) ** 2  # scarce dimensions weigh more
    left = np.arange(len(items))
    while len(left):
        free, open_ = capacity.astype(np.int64).copy(), []
        while len(left) and free[0] and free[1]:
            need = demand[left]
            fits = (need <= free).all(1)
            if fits.any():
                at = int(np.where(fits, need @ (weight * free), -1.0).argmax())
                i = left[at]
                open_.append((items[i], int(demand[i, 0])))
                free -= demand[i]
                left = np.delete(left, at)
                continue
            at = int(need[:, 0].argmax())
            p = items[left[at]]
            k = p.fitting(min(int(free[0]), p.n - p.at), int(free[2]))
            if k:
                open_.append((p, k))
                free -= p.demand(k)
            break  # the piece's rest has a place in the next sequence
        total = sum(k for _, k in open_)
        if not total:
            raise ValueError("the limits admit no token at all")
        if total < size and not len(left) and not flush:
            return rows, [p for p, _ in open_]
        while open_:
            open_ = emit(open_, 1 << (sum(k for _, k in open_).bit_length() - 1))
        if len(left):  # at most one piece was cut
            i = left[(np.array([items[j].n - items[j].at for j in left]) != demand[left, 0])] if total else left[:0]
            for j in i:
                demand[j] = items[j].demand(items[j].n - items[j].at)
            left = left[demand[left, 0] > 0]
    return rows, []


def pack(
    docs: DataFrame, id_col: str, content: Column, tokenizer: str, eos: int, size: int = 4096, max_segments: int = 64, max_loss: int | None = None,
    prompt_tokens: Column | None = None, window_rows: int = 512, window_bytes: int = 32 << 20, with_ids: bool = True, words: int = 250_000,
) -> DataFrame:
    """One row per piece of a document. ids: the piece's ids, little-endian unsigned 32-bit (null unless with_ids), and their ids_crc32. Ids from prompt_tokens on bear loss. size: a power of two. words: the most that a worker's tokenizer keeps."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    capacity = np.array([size, max_segments, max_loss or size])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, close = WordTokenizer.open(tokenizer, words), np.array([eos], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        number = (base | k for k in count())
        held: list[Piece] = []
        bytes_ = 0
        for batch in batches:
            each = zip(batch["id"], known.encode_each(map(bytes, batch["content"])), batch["prompt"], strict=True)
            for k, (i, ids, prompt) in enumerate(each, 1):
                held.append(Piece(i, ids + close, int(prompt)))
                bytes_ += len(ids)
                if k % 64 and k < len(batch):
                    continue
                if len(held) >= window_rows or bytes_ >= window_bytes:
                    rows, held = pack_window(held, capacity, number, False, with_ids)
                    bytes_ = 0
                    yield pd.DataFrame(rows, columns=COLUMNS)
        if held:
            yield pd.DataFrame(pack_window(held, capacity, number, True, with_ids)[0], columns=COLUMNS)

    prompt = F.coalesce(prompt_tokens, F.lit(0)) if prompt_tokens is not None else F.lit(0)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(content.cast("binary"), F.lit(b"")).alias("content"), prompt.cast("long").alias("prompt"))
    return src.mapInPandas(run, SCHEMA).withColumnRenamed("id", id_col)


#: Production limits on a sequence's segments and loss-bearing tokens.
MAX_SEGMENTS, MAX_LOSS = 64, 4096


def packed_documents(documents: DataFrame, tokenizer: str | None = None, words: int = 250_000) -> DataFrame:
    """The rows that op2 and the pipeline's last stage return."""
    import public_tokenizers

    out = pack(documents, "doc_id", F.col("text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), 2, 4096, MAX_SEGMENTS, MAX_LOSS, with_ids=False, words=words)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("loss").alias("loss_tokens"))
