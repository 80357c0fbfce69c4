"""Byte-pair merges of many words at once: all words of a matrix take their next merge in the same step, so no word costs work in Python."""

from __future__ import annotations

import numpy as np

#: No symbol; no pair; rows of a matrix fit in the low bits of a place's rank.
PAD, NONE, _BITS, _EMPTY = 0xFFFF, 1 << 30, 6, ~np.uint64(0)


class Merges:
    """The merge table of a BPE model over bytes whose words' last symbols end in `suffix`.

    `shown` has the character by which the model writes each byte. Gives the model's own ids: of a word's pairs the one of
    lowest rank is merged, the leftmost of equals, until none is left.
    """

    #: The most bytes of a word.
    LONGEST = 40

    def __init__(self, vocab: dict[str, int], merges: list, shown: dict[int, int], suffix: str):
        if len(merges) >= PAD or max(vocab.values()) >= PAD:
            raise ValueError("the merge table is too large")
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        ranks = np.arange(len(keys), dtype=np.uint64)
        self.levels: list[tuple[np.uint32, np.ndarray]] = []
        rng = np.random.default_rng(7)
        while len(keys):  # keys that meet in a place go to the next table
            factor = np.uint32(rng.integers(1 << 31) * 2 + 1)
            table = np.full(1 << 19, _EMPTY)
            _, first = np.unique(keys * factor >> np.uint32(13), return_index=True)
            table[keys[first] * factor >> np.uint32(13)] = keys[first].astype(np.uint64) << np.uint64(16) | ranks[first]
            self.levels.append((factor, table))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)
        ids = [vocab[chr(shown[b]) + end] for end in ("", suffix) for b in range(256)]
        self.ids = np.array([*ids, PAD], np.int32)
        left, right = np.meshgrid(self.ids, self.ids, indexing="ij")
        self.first = self._ranks(left.ravel(), right.ravel())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, shifted by _BITS; NONE for what is never merged."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        out, todo = np.full(len(keys), NONE, np.int32), None
        for factor, table in self.levels:
            got = table.take(keys * factor >> np.uint32(13))
            same = got >> np.uint64(16) == keys
            hit = np.flatnonzero(same)
            out[hit if todo is None else todo[hit]] = (got[hit] & np.uint64(0xFFFF)).astype(np.int32) << _BITS
            other = np.flatnonzero(~same & (got != _EMPTY))  # an empty place: the pair is in no later table
            if not len(other):
                break
            keys, todo = keys[other], other if todo is None else todo[other]
        return out

    def __call__(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, together: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words raw[start : start + size], one after another, and the number of each. Sizes from 1 to LONGEST."""
        order = np.argsort(sizes, kind="stable")
        ids, counts = [], np.zeros(len(sizes), np.int64)
        for lo in range(0, len(order), together):
            part = order[lo : lo + together]
            got = self._merged(raw, starts[part], sizes[part])
            there = got != PAD
            counts[part] = there.sum(1)
            ids.append(got[there])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        sorted_counts = counts[order]
        begins = np.empty(len(order), np.int64)
        begins[order] = np.cumsum(sorted_counts) - sorted_counts
        upto = np.cumsum(counts) - counts
        return flat[np.repeat(begins - upto, counts) + np.arange(len(flat))].astype("<u4"), counts

    def _merged(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of ids for each word, with PAD around and after them."""
        most = int(sizes.max())
        rows = np.arange(most)[:, None]
        symbols = np.full((most + 3, len(starts)), 512)
        symbols[1:-2] = np.where(rows < sizes, raw[np.minimum(starts + rows, len(raw) - 1)], np.int64(512))
        symbols[sizes, np.arange(len(starts))] += 256
        ids = self.ids[symbols]
        # of each place's pair with the next one: the rank, and the place in the low bits
        places = np.arange(most + 2, dtype=np.int32)[:, None]
        rank = self.first[symbols[:-1] * 513 + symbols[1:]] + places
        out, columns = ids, np.arange(len(starts))
        while True:
            best = rank.min(0)
            live = best < NONE
            n = np.count_nonzero(live)
            if n * 4 < len(live) * 3:
                if out is not ids:
                    out[:, columns] = ids
                if not n:
                    return out.T
                ids, rank, best, columns, live = ids[:, live], rank[:, live], best[live], columns[live], live[live]
            here = np.arange(len(best))
            at = np.where(live, best & (1 << _BITS) - 1, most + 1)
            new = np.where(live, self.made[np.where(live, best >> _BITS, 0)], PAD)
            # what comes after the place moves up by one
            later = at - places[:-1] >> 31
            ids[:-2] ^= (ids[:-2] ^ ids[1:-1]) & later
            rank[:-1] ^= (rank[:-1] ^ rank[1:] - 1) & later
            ids[at, here] = new
            rank[at, here] = self._ranks(new, ids[at + 1, here]) + at
            rank[at - 1, here] = self._ranks(ids[at - 1, here], new) + at - 1
