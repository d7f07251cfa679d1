"""Words of many texts at once, as arrays over their UTF-8 bytes, and 64-bit hashes of words and word runs.

Hashes are equal for equal words on every machine. Two different words share one with a chance of about 2**-64.
"""

import numpy as np
import pyarrow as pa

from yomisaku.llm.common import text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: all but blanks (space, tab to carriage return).
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words: ASCII letters and digits (after lower-casing) and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_HASH_BYTES = 1 << 20
#: Masks for the first 0 to 8 bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a permutation."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a column of texts: bytes ``starts[i]`` to ``ends[i]``; text d has words first[d] to first[d + 1]."""

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray):
        raw, self.texts = text_bytes(texts)
        self.raw = _LOWER[raw]
        inside = word_bytes[self.raw]
        some = self.texts[:-1] < self.texts[1:]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        head, tail = self.texts[:-1][some], self.texts[1:][some] - 1
        begins[head], stops[tail] = inside[head], inside[tail]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.texts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return segment_hashes(self.raw, self.starts, self.ends)


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each segment, none of which is empty; ``second`` = 1 gives another one.

    Each block of eight bytes is mixed by itself and again with its place before the blocks are added up, so that no
    sum of powers can cancel out as it can in a polynomial.
    """
    out = np.empty(len(starts), np.uint64)
    seed = np.uint64(0x165667B19E3779F9 if second else 0x2545F4914F6CDD1D)
    step = np.uint64(0xC2B2AE3D27D4EB4F if second else 0x9E3779B97F4A7C15)
    at = 0
    while at < len(starts):  # in parts, so that a very long text takes little memory
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _HASH_BYTES)))
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        padded = np.zeros(int(e[-1]) + 8, np.uint8)
        padded[:e[-1]] = raw[starts[at]:ends[to - 1]]
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        sizes = e - s
        count = (sizes + 7) >> 3
        firsts = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(firsts, count)
        begin = np.repeat(s, count) + 8 * place
        values = eight[begin] & _FIRST[np.minimum(np.repeat(e, count) - begin, 8)]
        values = mix(mix(values ^ seed) + (place + 1).astype(np.uint64) * step)
        out[at:to] = np.add.reduceat(values, firsts) + sizes.astype(np.uint64)
        at = to
    return mix(out)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` neighbouring words; one shorter by k - 1 than ``hashes``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i:i + n]
    return mix(total)
