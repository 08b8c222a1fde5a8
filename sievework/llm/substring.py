"""Substring de-duplication over a log-structured index of window fingerprints.

A window is 50 consecutive words. Keeping the hash of every window of history would outgrow the corpus, so windows are
filed by content: among the 10-word hashes inside a window the smallest is its anchor (winnowing), and consecutive
windows with one anchor form a block. Equal windows have equal anchors, wherever they stand. A block is known by its
anchor's hash, made of word hashes, and by an independent hash of the bytes of all its words, two polynomials modulo a
61-bit prime at seeded points of their own; equality rests on them, the words themselves are not compared again.

The index holds immutable runs, each sorted by anchor: (anchor, block, smallest doc_id). A batch of documents is
merge-joined with the runs and with itself:

* a block that a smaller document holds too is a duplicate as a whole;
* where blocks with one anchor differ (edits, ends of passages), only the first document of each different block is
  looked at again, and its windows are verified one by one by two such hashes of their full words.

The batch's blocks become a new run of the lowest tier, listed in a manifest by which a later session opens the index again; ``fanout`` runs of a tier are compacted into one of the next, so
that a row is rewritten a logarithmic number of times. Pre-aggregation before each shuffle makes hot passages cheap;
blocks on very many documents are joined by a broadcast of bounded size. Tables of a batch go once its spans are written.

Defined results: null and empty texts have no windows; a null doc_id is compared with nothing and loses nothing; rows
with the same doc_id do not count as smaller than each other; a doc_id that is no integer is refused by Spark's cast; an
empty table gives an empty result; other columns are ignored. A very long text costs time and memory in proportion to
its words.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, durable_path, hot_join
from ._common import durable as _durable
from ._words import SEED, SPACES, Chunk, chunks, run_hashes, sliding_argmin

GRAM = 10
BLOCK_SCHEMA = "fp bigint, bh bigint, doc_id bigint, tag int, start int, n int"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: their handles go with the driver's garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def _blocks(c: Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, block hash, text, first window (word of the chunk) and number of windows of each block."""
    counts = c.counts()
    n = len(c.starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    left = np.repeat(c.at[1:], counts) - np.arange(n)
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return none, none, none, none, none
    grams = run_hashes(c.hashes, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    anchor = sliding_argmin(grams, window - GRAM + 1)[starts]
    text = np.repeat(np.arange(c.n), counts)[starts]
    edge = np.ones(len(starts), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    spelled, first_byte, last_byte = c.spelled()
    whole = run_hashes(spelled, first_byte[begin], last_byte[begin + size + window - 2], 1)
    # the anchor's place in the block is part of its identity
    whole = whole ^ ((anchor[first] - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return grams[anchor[first]].view(np.int64), whole.view(np.int64), text[first], begin, size


def _find_blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text"), SPACES):
                fp, bh, text, begin, size = _blocks(c, window)
                rows = pa.array(text + c.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp, pa.int64()), pa.array(bh, pa.int64()), batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array((begin - c.at[text]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["fp", "bh", "doc_id", "tag", "start", "n"],
                )

    return run


def _find_windows(window: int):
    """The windows of the wanted blocks of each document, with their full hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [np.array([w["bh"] for w in x], np.int64) for x in batch.column("wanted").to_pylist()]
            for c in chunks(batch.column("text"), SPACES):
                _, bh, text, begin, size = _blocks(c, window)
                at = np.searchsorted(text, np.arange(c.n + 1))
                pick = np.zeros(len(bh), bool)
                for i in range(c.n):
                    pick[at[i] : at[i + 1]] = np.isin(bh[at[i] : at[i + 1]], wanted[c.lo + i])
                b, s = begin[pick], size[pick]
                starts = np.repeat(b - np.cumsum(s) + s, s) + np.arange(int(s.sum()))
                which = np.repeat(text[pick], s)
                h1 = run_hashes(c.hashes, starts, starts + window) if len(starts) else np.zeros(0, np.uint64)
                spelled, first_byte, last_byte = c.spelled()
                h2 = run_hashes(spelled, first_byte[starts], last_byte[starts + window - 1], 1) if len(starts) else np.zeros(0, np.uint64)
                rows = pa.array(which + c.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array((starts - c.at[which]).astype(np.int32))],
                    ["h1", "h2", "doc_id", "tag", "start"],
                )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column("spans").to_pylist(), []
        counts, gone = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for c in chunks(batch.column("text"), SPACES):
            delta = np.zeros(len(c.starts) + 1, np.int64)
            for i in range(c.n):
                for s in spans[c.lo + i] or ():
                    delta[c.at[i] + s["start"]] += 1
                    delta[c.at[i] + s["start"] + s["n"]] -= 1
            kept = np.cumsum(delta[:-1]) == 0
            data = c.data.tobytes()
            for i in range(c.n):
                lo, hi = c.at[i], c.at[i + 1]
                stay = np.flatnonzero(kept[lo:hi]) + lo
                counts[c.lo + i], gone[c.lo + i] = hi - lo, hi - lo - len(stay)
                out.append(b" ".join([data[s:e] for s, e in zip(c.starts[stay].tolist(), c.ends[stay].tolist())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(gone), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """tag tells rows with one doc_id but different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pmod(F.xxhash64(text), F.lit(2147483647)).cast("int").alias("tag"), text.alias("text"))


class FingerprintIndex:
    """The runs, oldest first, in a folder, and which of them are valid: numbered manifests, of which the last counts.

    ``path``: a folder that all executors share; an index that lives there already is opened, in this session or any later
    one. Without a path the index is made anew in the shared folder and goes when the Python process ends. ``add`` takes
    documents with ids above all of history's. A batch that fails leaves the index as its last manifest says."""

    def __init__(self, spark: SparkSession, window: int = 50, fanout: int = 2, path: str | None = None):
        self.spark, self.window, self.fanout = spark, window, fanout
        self.root = (path or durable_path(spark, "index")).rstrip("/")
        self.runs: list[tuple[int, str]] = []  # tier, name of the run's folder
        self.highest: int | None = None
        self.generation = 0
        self._open()

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _open(self) -> None:
        path, fs = self._at("manifests")
        if not fs.exists(path):
            return
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return
        self.generation = max(numbers)
        said = json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/manifests/{self.generation:012d}.json").collect()))
        if (said["window"], said["gram"], said["seed"]) != (self.window, GRAM, SEED):
            raise ValueError(f"the index at {self.root} holds windows of {said['window']} words, grams of {said['gram']} and hashes of seed {said['seed']}")
        self.runs, self.highest = [tuple(r) for r in said["runs"]], said["highest"]

    def _commit(self) -> None:
        """The next manifest, under a name that only one writer can create; then runs that it does not list go."""
        self.generation += 1
        said = {"window": self.window, "gram": GRAM, "seed": SEED, "highest": self.highest, "runs": self.runs}
        unfinished, fs = self._at("manifests", f"{self.generation:012d}.part-{uuid.uuid4().hex}")
        out = fs.create(unfinished, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        final = self._at("manifests", f"{self.generation:012d}.json")[0]
        if fs.exists(final) or not fs.rename(unfinished, final):
            raise RuntimeError(f"another writer has added to the index at {self.root}")
        listed = {name for _, name in self.runs}
        folder = self._at("runs")[0]
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            if status.getPath().getName() not in listed:
                fs.delete(status.getPath(), True)

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.schema("fp bigint, bh bigint, m bigint").parquet(*(f"{self.root}/runs/{n}" for n in names)) if names else None

    def history(self) -> DataFrame | None:
        return self._read([name for _, name in self.runs])

    def _append(self, run: DataFrame, tier: int = 0) -> None:
        name = f"{tier}-{uuid.uuid4().hex}"
        _durable(run.sortWithinPartitions("fp", "bh"), path=f"{self.root}/runs/{name}")
        self.runs.append((tier, name))

    def compact(self, tier: int) -> None:
        """Merges the runs of a tier into one of the next that keeps the smallest doc_id of each block."""
        old = [name for t, name in self.runs if t == tier]
        self._append(self._read(old).groupBy("fp", "bh").agg(F.min("m").alias("m")), tier + 1)
        self.runs = [(t, name) for t, name in self.runs if name not in old]

    def add(self, batch: DataFrame, store: DataFrame) -> DataFrame:
        """Duplicate spans (doc_id, tag, spans of start and n words) of the batch, which joins the index.
        ``batch``, ``store`` (history and batch): doc_id, tag, text."""
        w, spark, used = self.window, self.spark, []

        def durable(df: DataFrame, name: str) -> DataFrame:
            used.append(durable_path(spark, name))
            return _durable(df, path=used[-1])

        own = durable(batch.where("doc_id IS NOT NULL").mapInArrow(_find_blocks(w), BLOCK_SCHEMA), "blocks")
        ends = own.agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).first()
        lowest = ends["m"]
        if lowest is not None and self.highest is not None and lowest <= self.highest:
            raise ValueError(f"the batch begins at doc_id {lowest}, the index holds ids up to {self.highest}")
        past = self.history()
        counted = durable(own.groupBy("fp", "bh").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"), F.count(F.lit(1)).alias("_n")), "counted")
        new = counted.select("fp", "bh", "m")
        if past is None:
            known, together = counted.where("m <> x").select("fp", "bh", "m", "_n"), new
        else:
            met = counted.hint("merge").join(past.withColumnRenamed("m", "h"), ["fp", "bh"], "left")
            known = met.select("fp", "bh", F.least("m", "h").alias("m"), "x", "_n").where("m <> x").select("fp", "bh", "m", "_n")
            together = new.unionByName(past.join(new.select("fp").distinct().hint("merge"), "fp", "left_semi"))
        whole = hot_join(own, durable(known, "known"), ["fp", "bh"]).where("doc_id > m").select("doc_id", "tag", "start", (F.col("n") + (w - 1)).alias("n"))
        whole = durable(whole, "whole")
        release(spark)
        # anchors with several different blocks, of which one begins in this batch after the first of all
        several = together.groupBy("fp").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("lo"), F.max("m").alias("hi")).where((F.col("k") > 1) & (F.col("lo") < F.col("hi")) & (F.col("hi") >= F.lit(lowest)))
        several = durable(several.select("fp", F.col("k").alias("_n")), "several")
        firsts = hot_join(together, several, ["fp"]).groupBy(F.col("m").alias("doc_id")).agg(F.collect_set(F.struct("bh")).alias("wanted"))
        firsts = durable(firsts, "firsts")
        windows = store.join(firsts, "doc_id").mapInArrow(_find_windows(w), "h1 bigint, h2 bigint, doc_id bigint, tag int, start int")
        windows = durable(windows, "windows")
        release(spark)
        least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"), F.count(F.lit(1)).alias("_n")).where("m <> x").select("h1", "h2", "m", "_n")
        single = hot_join(windows.where(F.col("doc_id") >= F.lit(lowest)), durable(least, "least"), ["h1", "h2"]).where("doc_id > m").select("doc_id", "tag", "start", F.lit(w).alias("n"))
        spans = _durable(whole.unionByName(single).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
        self._append(new)
        for path in used:
            discard(spark, path)
        tier = 0
        while sum(t == tier for t, _ in self.runs) >= self.fanout:
            self.compact(tier)
            tier += 1
        if ends["x"] is not None:
            self.highest = ends["x"]
        self._commit()
        release(spark)
        return spans


def dedup_batch(batch: DataFrame, store: DataFrame, index: FingerprintIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of a new ``batch``, as `dedup_substrings` gives: what documents of earlier batches or smaller ids of this one
    hold already is removed, and the batch joins the index. ``store``: all documents so far, the batch among them, of which only
    those are read as texts that hold the first of several blocks with one anchor."""
    rows = _rows(batch, id_col, text_col)
    return _removed(rows, index.add(rows, _rows(store, id_col, text_col)))


def _removed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    joined = rows.join(spans.withColumnRenamed("doc_id", "_d").withColumnRenamed("tag", "_t"), (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, n_batches: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (the kept words joined by one space).

    The documents enter the index in ``n_batches`` batches in order of doc_id, as crawls would."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n_batches) for k in range(1, n_batches)]), 1000).alias("c")).first()["c"] or [] if n_batches > 1 else []
    index, spans, below = FingerprintIndex(spark, window), None, None
    for upto in [*sorted(set(cuts)), None]:
        batch = rows if below is None else rows.where(F.col("doc_id") > below)
        store = rows
        if upto is not None:
            batch, store = batch.where(F.col("doc_id") <= upto), rows.where(F.col("doc_id") <= upto)
        got = index.add(batch, store)
        spans = got if spans is None else spans.unionByName(got)
        below = upto
    return _removed(rows, spans)
