"""Periodic runs in texts: maximal stretches of words that repeat with a period, found by divide and conquer.

A run is a stretch of consecutive words with smallest period q, at least ``exponent`` times as long as q and at least
``least`` words long, that no neighbouring word extends. The scheme is that of Main and Lorentz on interned word ids
(words are numbered by a dictionary, so equality is exact), arranged by block size rather than by recursion:

* Periods below `BASE` are the leaves: the text is compared with itself shifted by each of them.
* Blocks of size B = 32, 64, ... look for periods q from B/2 to B - 1 around their midpoints. A run of period q is at
  least 4 q long, so one of the midpoints, B apart, lies within it with q words of it on the left and one past its partner
  on the right: the repetition crosses that midpoint. One pass compares the 16 words before each midpoint with those
  before its partner at every q, as one hash each. Where any agree, Z-functions of the words after the midpoint and, backwards,
  of those before it give how far the text matches its shifted self in both directions, in time linear in B.
* A match that reaches the end of what the Z-functions saw is extended. Stretches within a run of the same period or of one of a
  smaller block size are passed over; of equal intervals the smallest period stays. A run of another period of the same block
  size tells nothing: it may cover twice the smaller period around a midpoint and still be a different run.

All texts of a chunk go through the leaves and midpoint passes at once as NumPy arrays; only midpoints where something
repeats are looked at one by one. The work is proportional to words times the log of a text's length for any input.

Defined results: null and empty texts have no runs; every row stands alone, so nulls in doc_id and repeated rows keep
their rows; an empty table gives an empty result; other columns are ignored. A very long text costs memory in proportion to
its words, in one task; white space between kept words becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import mix

#: Periods below are found by shifting; the words that midpoints compare at once.
BASE = 16
CHUNK_WORDS, MATRIX = 200_000, 1 << 21
SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, kept_text string"


def z_function(s: list[int], upto: int) -> list[int]:
    """z[i] for i < upto: how many values s and s[i:] share at their beginning."""
    n, z, lo, hi = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many values a and b share at their beginning, in growing steps."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the `BASE` values from each place on."""
    h, width = mix(ids.astype(np.uint64)), 1
    while width < BASE:
        h = mix(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ np.uint64(width)))
        width *= 2
    return h


def _short_periods(ids: np.ndarray, exponent: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found = []
    for q in range(1, min(BASE, len(ids))):
        edge = np.diff((ids[:-q] == ids[q:]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start = np.flatnonzero(edge == 1)
        length = np.flatnonzero(edge == -1) - start + q
        long = length >= max(least, exponent * q)
        found.append((start[long], length[long], np.full(int(long.sum()), q)))
    return found


class _Text:
    """Where a text lies in the chunk, and its ids as a list once they are needed."""

    def __init__(self, ids: np.ndarray, lo: int, hi: int):
        self.ids, self.lo, self.hi = ids, lo, hi
        self.values: list[int] = ids[lo:hi].tolist()

    def crossing(self, m: int, half: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, length of the match with itself, period) of repetitions that cross midpoint ``m``; periods from
        ``half`` to 2 * half - 1, with at least a period of the match before m."""
        m -= self.lo
        s, block = self.values, 2 * half
        after = s[m : m + 2 * block]
        before = s[max(0, m - block) : m][::-1]
        ahead = min(block - 1, len(s) - m)
        # the left part backwards, a value that occurs nowhere, then all up to the block's end backwards
        back = [*before, -1, *s[max(0, m - block) : m + ahead][::-1]]
        z_after, z_back = z_function(after, min(block, len(after))), z_function(back, len(before) + 1 + ahead)
        for q in periods:
            left = z_back[len(before) + 1 + ahead - q]
            if left < q:
                continue
            right = z_after[q]
            if q + right == len(after):
                right += _matching(self.ids[self.lo + m + right : self.hi], self.ids[self.lo + m + q + right : self.hi])
            if left == len(before):
                left += _matching(self.ids[self.lo : self.lo + m - left][::-1], self.ids[self.lo : self.lo + m + q - left][::-1])
            yield self.lo + m - left, left + right, q


def find_runs(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period. ``ids``: non-negative word ids of several texts,
    text i at lo[i]:hi[i], with a value of its own (negative, never repeated) after each. ``exponent``: 4 or more."""
    found = _short_periods(ids, exponent, least)
    # the furthest end of a run, known from smaller block sizes, that begins at or before each place
    reach = np.zeros(len(ids) + 1, np.int64)
    for start, length, _ in found:
        np.maximum.at(reach, start, start + length)
    np.maximum.accumulate(reach, out=reach)
    half, longest = BASE, int((hi - lo).max()) if len(lo) else 0
    grams = _grams(ids) if longest >= 4 * half else None
    texts: dict[int, _Text] = {}
    while longest >= 4 * half:
        which = np.flatnonzero(hi - lo >= 4 * half)
        count = (hi[which] - lo[which] - half) // (2 * half) + 1
        owner = np.repeat(which, count)
        mids = lo[owner] + half + 2 * half * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        inside = mids + half < hi[owner]
        mids, owner = mids[inside], owner[inside]
        padded = np.concatenate([grams, np.zeros(2 * half, np.uint64)])
        shifted = np.lib.stride_tricks.sliding_window_view(padded, half)
        rows = max(1, MATRIX // half)
        ends: dict[int, int] = {}  # where the last run of each period of this block size ends
        level: list[tuple[int, int, int]] = []
        for i in range(0, len(mids), rows):
            m = mids[i : i + rows]
            row, col = np.nonzero(shifted[m - BASE + half] == grams[m - BASE][:, None])
            at, q = m[row], col + half
            fits = (at + q < hi[owner[i + row]]) & (reach[at - q] < at + q)
            for k in np.split(np.flatnonzero(fits), np.flatnonzero(np.diff(row[fits])) + 1):
                if not len(k):
                    continue
                mid, own = int(at[k[0]]), int(owner[i + row[k[0]]])
                if own not in texts:
                    texts[own] = _Text(ids, int(lo[own]), int(hi[own]))
                periods = [int(x) for x in q[k] if ends.get(int(x), 0) < mid + x]
                for start, matched, p in texts[own].crossing(mid, half, periods) if periods else ():
                    length = matched + p
                    if length >= max(least, exponent * p) and reach[start] < start + length:
                        level.append((start, length, p))
                        ends[p] = start + length
        if level:
            found.append(tuple(np.array(level, np.int64).T))
        for start, length, _ in level:
            reach[start : start + length] = np.maximum(reach[start : start + length], start + length)
        half *= 2
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), (), ())))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _best(start: list[int], length: list[int], period: list[int]) -> dict[str, int] | None:
    """The run of the greatest length / period, compared exactly; then of the smallest start, then period."""
    top = None
    for s, n, q in zip(start, length, period, strict=True):
        if top is None or n * top[2] > top[1] * q:
            top = (s, n, q)
    return top and dict(zip(("start", "length", "period"), top, strict=True))


def _chunk(texts: list[list[bytes]], exponent: int, least: int) -> Iterator[tuple[int, list[dict], dict | None, bytes]]:
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    lo = np.cumsum(sizes + 1) - sizes - 1
    hi = lo + sizes
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    ids[hi] = -2 - np.arange(len(texts))
    for i, t in enumerate(texts):
        ids[lo[i] : hi[i]] = [number.setdefault(w, len(number)) for w in t]
    start, length, period = find_runs(ids, lo, hi, exponent, least)
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    stays = np.cumsum(gone[:-1]) == 0
    at = np.searchsorted(start, np.append(lo, len(ids)))
    for i, t in enumerate(texts):
        own = slice(at[i], at[i + 1])
        s, n, q = (start[own] - lo[i]).tolist(), length[own].tolist(), period[own].tolist()
        keep = stays[lo[i] : hi[i]]
        kept = t if not s else [t[k] for k in np.flatnonzero(keep).tolist()]
        yield len(t), [{"start": a, "length": b, "period": c} for a, b, c in zip(s, n, q, strict=True)], _best(s, n, q), b" ".join(kept)


def _runs(exponent: int, least: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            i = 0
            while i < batch.num_rows:
                part, words, j = [], 0, i
                while j < batch.num_rows and words < CHUNK_WORDS:
                    part.append((texts[j].as_py() or b"").split())
                    words += len(part[-1])
                    j += 1
                n, runs, best, kept = zip(*_chunk(part, exponent, least))
                others = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                made = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*others, *made], [*batch.schema.names[:-1], "n_words", "runs", "best", "kept_text"])
                i = j

    return go


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start and length in words, period; by start, then period), best
    (the run of the greatest exponent) and kept_text: the words that no run holds after its first period."""
    if exponent < 4:
        raise ValueError("midpoints meet every run from an exponent of 4 on")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runs(exponent, least), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
