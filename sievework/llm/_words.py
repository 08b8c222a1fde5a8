"""Words and windows of whole Arrow batches as NumPy arrays.

Texts are handled as the bytes of their UTF-8 form: one pass marks where words begin and end, and prefix sums of
a polynomial give the hash of any run of bytes or words in constant time. The polynomial is taken modulo the prime
2**61 - 1 at a seeded point: two different runs of n values agree at no more than n of the 2**61 points, whatever they hold,
and hashes at two points fail independently. (Modulo a power of two, runs such as Thue-Morse words agree at every odd
point.) Work is cut into chunks of a few hundred thousand bytes, never inside a text, so memory does not depend on the size
of an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
PRIME = (1 << 61) - 1
SEED = "sievework"

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Everything but ASCII letters and digits and the bytes of other scripts.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return x - np.uint64(PRIME) * (x >= np.uint64(PRIME))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it: by halves of 30 and 31 bits, as 2**61 counts as one."""
    low, n31, n30 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30)
    a1, a0, b1, b0 = a >> n31, a & low, b >> n31, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> n30) + ((middle & np.uint64((1 << 30) - 1)) << n31) + a0 * b0)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a seeded point and of its inverse, modulo the prime."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        base, out = int.from_bytes(hashlib.sha256(f"{SEED}:{which}".encode()).digest(), "big") % (PRIME - 2) + 2, []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, times(p[: n - len(p)], np.uint64(pow(b, len(p), PRIME)))])
            out.append(p)
        have = _powers[which] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of values[s:e] for each s, e; both ascend. Long arrays are taken in slabs, so that memory beyond the
    arrays themselves depends on the longest run only."""
    if len(values) <= CHUNK_BYTES:
        return _run_hashes(values, starts, ends, which)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = _run_hashes(values[lo:hi], starts[i:j] - lo, ends[i:j] - lo, which)
        i = j
    return out


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    pw, inv = powers(which, len(values) + 1)
    low, n31, n30 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30)
    one, pw = values.astype(np.uint64), pw[: len(values)]
    if values.dtype == np.uint8:
        one += np.uint64(1)
        upper = one * (pw >> n31)
        terms = (upper >> n30) + ((upper & np.uint64((1 << 30) - 1)) << n31) + one * (pw & low)
    else:
        terms = times(_reduced(one), pw)
    # prefix sums of the terms' halves, which stay far below 2**64
    sums, h = np.zeros(len(values) + 1, np.uint64), np.zeros(len(starts), np.uint64)
    np.cumsum(terms >> n31, out=sums[1:])
    d = sums[ends] - sums[starts]
    h += (d >> n30) + ((d & np.uint64((1 << 30) - 1)) << n31)
    np.cumsum(terms & low, out=sums[1:])
    d = sums[ends] - sums[starts]
    h += (d & np.uint64(PRIME)) + (d >> np.uint64(61))
    h = times(_reduced(h), inv[starts])
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost minimum of each window of ``width`` values, in linear memory: minima of ranks from the
    front and the back of blocks of ``width``."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    blocks = np.full(-(-n // width) * width, n, np.int64)
    blocks[:n] = rank
    blocks = blocks.reshape(-1, width)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return order[np.minimum(back[: n - width + 1], front[width - 1 : n])]


class Chunk:
    """Some whole texts: rows lo..hi of a batch. ``at[i]:at[i + 1]`` are the words of the i-th text;
    ``starts``/``ends`` are byte positions in ``data``; ``hashes`` identify words."""

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.lo, self.offsets = lo, offsets
        self.n = len(offsets) - 1
        self.data = LOWER[data] if lower else data
        gap = separators[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begin, end = ~gap, ~gap
        begin[1:] &= gap[:-1] | first[1:-1]
        end[:-1] &= gap[1:] | first[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = run_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words with one blank after each, and where each word begins and ends in them."""
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        for i in range(0, len(sizes), 1 << 16):
            n = sizes[i : i + (1 << 16)]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(ends[i : i + (1 << 16)] - n, n) + step] = self.data[np.repeat(self.starts[i : i + (1 << 16)], n) + step]
        return out, ends - sizes, ends

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of(self) -> np.ndarray:
        """For each word, which text of the chunk it is in."""
        return np.repeat(np.arange(self.n), self.counts())

    def windows(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of ``size`` words that lie in one text, and their hashes."""
        starts = np.arange(max(0, len(self.hashes) - size + 1))
        left = np.repeat(self.at[1:], self.counts())[: len(starts)] - starts
        starts = starts[left >= size]
        h = self.hashes if which == 0 else mix(self.hashes ^ np.uint64(0xD6E8FEB86659FD93))
        return starts, run_hashes(h, starts, starts + size, which)


def chunks(texts: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACES, lower: bool = False) -> Iterator[Chunk]:
    """Chunks of an Arrow array of strings; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separators, lower)
        lo = hi
