"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240131)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n + n // 4, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text), words in order. Words are runs without blanks, A-Z as a-z."""
    data = np.frombuffer(b" ".join(batch) + b" ", np.uint8)
    blank = _BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up)])
    h = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([0] + [len(b) + 1 for b in batch[:-1]])
    return h, np.searchsorted(firsts, starts, "right") - 1


#: Bytes of text hashed at once, about; a longer text is hashed alone.
CHUNK = 1 << 20


def shingle_sets(batch: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; none without words."""
    out, at = [], 0
    while at < len(batch):
        end, size = at + 1, len(batch[at])
        while end < len(batch) and size + len(batch[end]) <= CHUNK:
            size += len(batch[end])
            end += 1
        out += _sets(batch[at:end], k)
        at = end
    return out


def _sets(batch: list[bytes], k: int) -> list[np.ndarray]:
    h, text = word_hashes(batch)
    counts = np.bincount(text, minlength=len(batch))
    n = len(h) - k + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        s = mixed(s)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, c in enumerate(counts.tolist()):
        a = int(offsets[i])
        if c >= k:
            out.append(np.unique(s[a : a + c - k + 1]))
        elif c:
            whole = np.uint64(c)
            with np.errstate(over="ignore"):
                for x in h[a : a + c]:
                    whole = whole * np.uint64(0xA0761D6478BD642F) + x
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
