"""Words of many texts as 64-bit hashes, and tables of what is known of them, with numpy.

A word is a run of bytes without ASCII white space (0x20, 0x09-0x0D). Words are read from the joined
bytes of many texts by eight bytes at a time, so that no Python object is made for a word that was seen before.
A word stands for its hash: words of up to eight bytes and equal length never collide, others do by chance alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at once, about; a longer text is handled alone.
CHUNK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(batch: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes: (first, end)."""
    at = 0
    while at < len(batch):
        end, total = at + 1, len(batch[at])
        while end < len(batch) and total + len(batch[end]) <= size:
            total += len(batch[end])
            end += 1
        yield at, end
        at = end


class WordRun:
    """The words of some texts in order: starts and ends in `raw`, hashes, and the number of words of each text."""

    def __init__(self, batch: list[bytes], lower: bool = False):
        self.raw = b" " + b" ".join(batch) + b" " * 9
        data = np.frombuffer(self.raw, np.uint8)
        if lower:
            data = _LOWER[data]
        blank = _BLANK[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        firsts = np.cumsum([1] + [len(b) + 1 for b in batch])
        self.bounds = np.searchsorted(self.starts, firsts)
        self.hashes = self._hashed(data)

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        left = self.ends - self.starts
        h = mixed((eight[self.starts] & _MASK[np.minimum(left, 8)]) + left.astype(np.uint64) * _LENGTH)
        at = np.flatnonzero(left > 8)
        place, left = self.starts[at], left[at]
        while len(at):
            place, left = place + 8, left - 8
            h[at] = mixed(h[at] * _STEP + (eight[place] & _MASK[np.minimum(left, 8)]))
            on = left > 8
            at, place, left = at[on], place[on], left[on]
        return h

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]


class WordTable:
    """Numbers of hashes in the order in which they came: an open hash table in arrays of a fixed size."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.count = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """For each hash its slot, or the free one where it would go."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        off = np.flatnonzero((self.at[slot] >= 0) & (self.keys[slot] != h))
        while len(off):
            s = (slot[off] + 1) & ((1 << self.bits) - 1)
            slot[off] = s
            off = off[(self.at[s] >= 0) & (self.keys[s] != h[off])]
        return slot

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 where unknown."""
        return self.at[self._probe(h)]

    def add(self, h: np.ndarray) -> None:
        """Numbers for distinct hashes that are not known, in their order. At most half of the slots should be taken."""
        rest = np.arange(len(h))
        while len(rest):
            slot = self._probe(h[rest])
            slot, one = np.unique(slot, return_index=True)  # one hash for each free slot; the others look again
            self.keys[slot], self.at[slot] = h[rest[one]], self.count + rest[one]
            left = np.ones(len(rest), bool)
            left[one] = False
            rest = rest[left]
        self.count += len(h)


#: Words looked up at once. No fewer than a chunk of several texts may hold, so that only a longer text, which is alone, is cut here.
RUN = CHUNK // 2


class WordMemo:
    """Numbers of words, and what a subclass learns of each new one. Forgotten when the table is half full: a memo, never a limit on results."""

    def __init__(self, bits: int = 20):
        self.table = WordTable(bits)
        self.forget()

    def forget(self) -> None:
        self.table.clear()

    def full(self) -> bool:
        return False

    def learn(self, words: list[str]) -> None:
        """Called with new words, in the order of their numbers."""

    def numbers(self, run: WordRun, a: int, b: int) -> np.ndarray:
        """Of the words a..b of a run; good until the next call."""
        h = run.hashes[a:b]
        at = self.table.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            where = a + new[one]
            if self.full() or self.table.count + len(fresh) > 1 << (self.table.bits - 1):
                self.forget()
                fresh, one = np.unique(h, return_index=True)
                where = a + one
            self.learn([run.word(i).decode() for i in where.tolist()])
            self.table.add(fresh)
            at = self.table.find(h)
        return at


class IdMemo(WordMemo):
    """Token ids of words by make(words) -> (ids one after another, number of ids of each)."""

    def __init__(self, make, kind: str, bits: int = 20, most: int = 1 << 22):
        self.make, self.kind, self.most = make, kind, most
        super().__init__(bits)

    def forget(self) -> None:
        super().forget()
        self.ids, self.held = np.zeros(1 << 16, self.kind), 0
        self.first, self.size = np.zeros(1 << (self.table.bits - 1), np.int64), np.zeros(1 << (self.table.bits - 1), np.int64)

    def full(self) -> bool:
        return self.held > self.most

    def learn(self, words: list[str]) -> None:
        ids, sizes = self.make(words)
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.zeros(max(len(ids), self.held), self.kind)])
        self.ids[self.held : self.held + len(ids)] = ids
        at = slice(self.table.count, self.table.count + len(words))
        self.first[at], self.size[at] = self.held + np.cumsum(sizes) - sizes, sizes
        self.held += len(ids)

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        run, ids, sizes = WordRun(batch), [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for a in range(0, len(run.hashes), RUN):
            at = self.numbers(run, a, a + RUN)
            n = self.size[at]
            ends = np.cumsum(n)
            ids.append(self.ids[np.repeat(self.first[at] - ends + n, n) + np.arange(ends[-1])])
            sizes.append(n)
        ends = np.cumsum(np.concatenate(sizes))
        return np.concatenate(ids), np.diff(ends[run.bounds])
