"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Features are all runs of one and two words, hashed into buckets by CRC-32. A bucket's gain is a thousand times the log of
its smoothed share in the target texts over its share in the documents, rounded down; the weight of a document is the
floored mean gain of its features. A hash of the doc_id gives each document a Gumbel number; the highest sums of weight
and Gumbel number are a draw without replacement with probabilities that grow with the weight.

Two passes read the texts and none is shuffled: the first counts buckets, each task into one array, of which one row a
bucket leaves the task; the second looks the gains up and writes a narrow row a document. Scores are integers within a range
that does not depend on the data's size (gains are logs of ratios of counts, Gumbel numbers of 32-bit hashes), so an exact
histogram of the scores has a bounded number of rows, some 120,000 at the most, and may go through the driver. Suffix sums of
it tell for each score how many documents score higher: the rank at which its own documents begin. The score where the
draw ends is the cutoff; documents from there on are numbered within their score by doc_id.

One score's documents are ordered together. Copies of one text differ in their Gumbel numbers, which spread over
thousands of scores, so no score holds more than about 1/2700 of all documents, unless rows repeat a doc_id.

Defined results: null and empty texts have no features and weight 0, and are never drawn if ``min_words`` is above 0;
a null doc_id hashes like the word null and comes last in ties; of rows with one doc_id and score, any order; rows
repeated are drawn one by one; an empty target leaves weights that only tell rare features; an empty table gives an empty
result; other columns are ignored. A very long text costs time and memory in proportion to its length; a word of any
length is hashed whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable
from ._words import NON_WORD, Chunk, chunks

BUCKETS = 10_000
#: Words up to so many bytes are hashed side by side; longer ones one by one.
LONG = 64
_ONES = np.uint32(0xFFFFFFFF)
_state: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of the CRC of one byte, and for each length up to `LONG` and each of a register's four bytes what it
    becomes after so many zero bytes: the register is linear, so its parts add up."""
    if "bytes" not in _state:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        shift = np.zeros((LONG + 1, 4, 256), np.uint32)
        shift[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(LONG):
            shift[n + 1] = (shift[n] >> np.uint32(8)) ^ one[shift[n] & np.uint32(255)]
        _state["bytes"], _state["shift"] = one, shift
    return _state["bytes"], _state["shift"]


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after ``n`` zero bytes each."""
    shift, byte = _tables()[1], np.uint32(255)
    return shift[n, 0, register & byte] ^ shift[n, 1, (register >> np.uint32(8)) & byte] ^ shift[n, 2, (register >> np.uint32(16)) & byte] ^ shift[n, 3, register >> np.uint32(24)]


def word_registers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC register after each word. Words are ordered by size, so that every step takes a prefix of them."""
    one = _tables()[0]
    order = np.argsort(-sizes, kind="stable")
    at, size, out = starts[order], sizes[order], np.full(len(starts), _ONES, np.uint32)
    least = np.searchsorted(-size, -np.arange(1, LONG + 2), "right")  # words of at least 1, 2, ... bytes
    several = int(least[LONG])
    for k in range(several):
        out[k] = zlib.crc32(data[at[k] : at[k] + size[k]]) ^ 0xFFFFFFFF
    for j in range(LONG):
        if least[j] <= several:
            break
        now = out[several : least[j]]
        out[several : least[j]] = (now >> np.uint32(8)) ^ one[(now ^ data[at[several : least[j]] + j]) & np.uint32(255)]
    back = np.empty_like(out)
    back[order] = out
    return back


def features(c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each feature of a chunk the number of its text and its bucket."""
    sizes = c.ends - c.starts
    word = word_registers(c.data, c.starts, sizes)
    text = c.text_of()
    first = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    second = first + 1
    after_blank = (word[first] >> np.uint32(8)) ^ _tables()[0][(word[first] ^ np.uint32(32)) & np.uint32(255)]
    short = np.minimum(sizes, LONG)
    # what the second word adds to a register is its own register less what the initial one would have become
    pair = _shifted(after_blank ^ _ONES, short[second]) ^ word[second]
    for k in np.flatnonzero(sizes[second] > LONG):
        i = second[k]
        pair[k] = zlib.crc32(c.data[c.starts[i] : c.ends[i]], int(after_blank[k] ^ _ONES)) ^ 0xFFFFFFFF
    each = np.concatenate([word, pair]) ^ _ONES
    return np.concatenate([text, text[first]]), (each % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for c in chunks(batch.column("text"), NON_WORD, lower=True):
                total += np.bincount(features(c, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    each = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at the most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of each bucket, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for c in chunks(batch.column("text"), NON_WORD, lower=True):
                text, bucket = features(c, len(gain))
                rows = slice(c.lo, c.lo + c.n)
                words[rows], n[rows] = c.counts(), np.bincount(text, minlength=c.n)
                # whole numbers well below 2**53 add up exactly
                total[rows] = np.bincount(text, weights=gain[bucket].astype(np.float64), minlength=c.n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times the Gumbel number of a document, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_weigh(gain), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 25, min_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank. ``percent`` of the documents with at least
    ``min_words`` words are drawn (rounded down) and ranked from 1; the others have a null rank."""
    rows = durable(weigh(docs, target, id_col, text_col, target_text_col, buckets, seed), "resample-weights")
    may = F.col("n_words") >= min_words
    histogram = sorted(rows.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["score"])
    n = np.array([r["n"] for r in histogram], np.int64)
    higher = np.cumsum(n) - n
    drawn = percent * int(n.sum()) // 100
    offsets = [(int(r["score"]), int(h)) for r, h in zip(histogram, higher, strict=True) if h < drawn]
    out = ["doc_id", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("bigint").alias("rank")
    if not offsets:
        return rows.select(*out, nothing)
    cutoff = offsets[-1][0]
    in_order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    table = F.broadcast(docs.sparkSession.createDataFrame(offsets, "score bigint, higher bigint"))
    ranked = rows.where(may & (F.col("score") >= cutoff)).join(table, "score").withColumn("rank", F.col("higher") + F.row_number().over(in_order))
    chosen = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"))
    return chosen.unionByName(rows.where(~(may & (F.col("score") >= cutoff))).select(*out, nothing))
