"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Items fall into classes by length (up to 64 words, 128, 256, ...). For each class every training text is cut into
overlapping passages of twice the class's length, so that any of its items lies in one passage whole, and every passage
is a query. What a text is held against for one item depends on that item's class alone, never on other items.

Inverse document frequencies and the mean length come from all items by a Spark job. Weights are divided by the score
an item gives itself, so a threshold is a share of a perfect match. A passage whose terms' upper bounds cannot reach
the threshold ends there (the first pivot test of WAND, done for all passages of a chunk at once); the others go
through the postings with block maxima, and all items above the threshold are retrieved. A hit counts if the item's
question and answer overlap the passage: five-word shingles of the question, of which an edited word costs up to five,
and the words of the answer (the last sentence of an item of several sentences).

The postings of at most ``max_items`` items (and ``max_words`` words) are built on the driver and sent to the
executors at a time; a larger benchmark is searched part by part with the same statistics, so the parts don't show in
the result. Texts are never shuffled.

Defined results: null and empty texts or items match nothing; items with a null id are items like others; an empty
benchmark or corpus gives no hit; items shorter than five words must occur as a whole; equal items are hit together;
repeated rows each get their own result; all columns pass through unchanged, whatever their names. A very long text
costs time and memory in proportion to its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import durable
from ._words import NON_WORD, Chunk, chunks, run_hashes

SHINGLE = 5
GROUP = 8
COMMON_SHARE = 0.3
K1, B = 1.2, 0.75
#: Words of the shortest class of items.
SHORTEST = 64


def hits_type(items: DataFrame, id_col: str) -> T.ArrayType:
    each = [T.StructField("item_id", items.schema[id_col].dataType), *(T.StructField(x, T.DoubleType()) for x in ("score", "question_overlap", "answer_overlap"))]
    return T.ArrayType(T.StructType(each))


@dataclass
class Item:
    item_id: object
    terms: np.ndarray
    question: np.ndarray
    question_size: int
    answer: np.ndarray


@dataclass
class Index:
    """Postings of term k: ``items[at[k]:at[k + 1]]`` in item order with weights; maxima per term and
    per block of GROUP neighbouring items."""

    terms: np.ndarray
    at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    best: np.ndarray
    group_at: np.ndarray  # for each term, the best weight in every group of GROUP neighbouring items that holds it
    groups: np.ndarray
    group_best: np.ndarray
    rare_best: np.ndarray  # ``best``, but 0 for the commonest terms, which give any one item ``common`` at most
    common: float
    entries: list[Item]
    length: int


def _hashes(text: str) -> np.ndarray:
    return next(chunks(pa.array([text]), NON_WORD, lower=True)).hashes


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence answers, if there are several."""
    found = re.match(r"(?s)(.*[.!?])\s+(\S.*)$", text.strip())
    return (found[1], found[2]) if found else (text, "")


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    starts = np.arange(len(h) - size + 1)
    return np.unique(run_hashes(h, starts, starts + size))


@dataclass
class Statistics:
    """Of all items: their number, their mean length and in how many of them a term (of this part) occurs."""

    n: int
    mean: float
    df: dict[int, int]


def length_class(n: int) -> int:
    return max(SHORTEST, 1 << (n - 1).bit_length())


def own_statistics(texts: list[str]) -> Statistics:
    """The statistics of items at hand."""
    each = [h for h in map(_hashes, texts) if len(h)]
    return Statistics(len(each), sum(map(len, each)) / max(1, len(each)), dict(Counter(int(t) for h in each for t in np.unique(h))))


def build_indexes(items: list[tuple[object, str]], stats: Statistics) -> list[Index]:
    """An index for each class of length."""
    classes: dict[int, list[tuple[object, str, np.ndarray]]] = {}
    for item_id, text in items:
        h = _hashes(text or "")
        if len(h):
            classes.setdefault(length_class(len(h)), []).append((item_id, text, h))
    return [build_index(classes[c], stats, c) for c in sorted(classes)]


def build_index(items: list[tuple[object, str, np.ndarray]], stats: Statistics, length: int) -> Index:
    entries, docs = [], []
    for item_id, text, h in items:
        question, answer = split_item(text)
        q = _hashes(question)
        if len(q) < SHINGLE:  # too short to stand alone
            q, answer = h, ""
        size = min(SHINGLE, len(q))
        entries.append(Item(item_id, h, _shingles(q, size), size, np.unique(_hashes(answer)) if answer else h[:0]))
        docs.append(Counter(h.tolist()))
    postings: dict[int, list[tuple[int, float]]] = {}
    for i, d in enumerate(docs):
        norm = K1 * (1 - B + B * len(entries[i].terms) / stats.mean)
        w = {t: math.log(1 + (stats.n - stats.df[t] + 0.5) / (stats.df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in d.items()}
        own = sum(w.values())
        for t, x in w.items():
            postings.setdefault(t, []).append((i, x / own))
    terms = np.array(sorted(postings), np.uint64)
    lists = [postings[int(t)] for t in terms]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = [p for x in lists for p in x]
    weights = np.array([p[1] for p in flat])
    best = np.array([max(p[1] for p in x) for x in lists])
    by_group = []
    for x in lists:
        most: dict[int, float] = {}
        for i, w in x:
            most[i // GROUP] = max(w, most.get(i // GROUP, 0.0))
        by_group.append(sorted(most.items()))
    group_at = np.concatenate([[0], np.cumsum([len(x) for x in by_group])]).astype(np.int64)
    grouped = [p for x in by_group for p in x]
    rare_best, mine, common = best.copy(), np.zeros(len(docs)), 0.0
    for k in sorted(range(len(lists)), key=lambda k: (-len(lists[k]), k)):
        for i, w in lists[k]:
            mine[i] += w
        if mine.max() > COMMON_SHARE:
            break
        common, rare_best[k] = float(mine.max()), 0.0
    return Index(terms, at, np.array([p[0] for p in flat], np.int64), weights, best, group_at, np.array([p[0] for p in grouped], np.int64), np.array([p[1] for p in grouped]), rare_best, common, entries, length)


def reachable(index: Index, terms: np.ndarray, threshold: float) -> list[int]:
    """The groups of neighbouring items that could reach the threshold, by the maxima of each group: the block-max
    test for all blocks at once."""
    lo, n = index.group_at[terms], index.group_at[terms + 1] - index.group_at[terms]
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return np.flatnonzero(np.bincount(index.groups[at], weights=index.group_best[at]) >= threshold).tolist() if len(at) else []


def search(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least ``threshold``, by block-max WAND over distinct term numbers: blocks
    that cannot reach it are skipped, within a block the cursors jump to the pivot."""
    found = []
    for g in reachable(index, terms, threshold):
        found += _wand(index, terms, threshold, g * GROUP, (g + 1) * GROUP)
    return found


def _wand(index: Index, terms: np.ndarray, threshold: float, first: int, end: int) -> list[tuple[int, float]]:
    """WAND over the items from ``first`` to before ``end``. A cursor is [item, term, posting, last posting + 1]."""
    items, weights, cursors, found = index.items, index.weights, [], []
    for t in terms.tolist():
        lo, hi = int(index.at[t]), int(index.at[t + 1])
        if hi - lo > 8:
            lo += int(items[lo:hi].searchsorted(first))
        while lo < hi and items[lo] < first:
            lo += 1
        if lo < hi and items[lo] < end:
            cursors.append([int(items[lo]), t, lo, hi])
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += float(index.best[c[1]])
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        if cursors[0][0] == item:
            score = sum(float(weights[c[2]]) for c in cursors if c[0] == item)
            if score >= threshold:
                found.append((item, score))
            item += 1
        left = []
        for c in cursors:
            while c[2] < c[3] and items[c[2]] < item:
                c[2] += 1
            if c[2] < c[3] and items[c[2]] < end:
                c[0] = int(items[c[2]])
                left.append(c)
        cursors = left
    return found


def _overlaps(entry: Item, h: np.ndarray) -> tuple[float, float | None]:
    if len(h) < entry.question_size:
        return 0.0, 0.0 if len(entry.answer) else None
    q = float(np.isin(entry.question, _shingles(h, entry.question_size)).mean())
    return q, float(np.isin(entry.answer, h).mean()) if len(entry.answer) else None


def find_hits(indexes: list[Index], texts: pa.Array, threshold: float, overlap: float, answer_overlap: float) -> dict[int, list[dict]]:
    """Row of the batch → hits, the best of each item."""
    out: dict[int, dict[object, dict]] = {}
    if not indexes:
        return {}
    for c in chunks(texts, NON_WORD, lower=True):
        if len(c.hashes):
            for index in indexes:
                _search_chunk(index, c, threshold, overlap, answer_overlap, out)
    return {row: [x[k] for k in sorted(x, key=lambda k: (k is None, k))] for row, x in out.items()}


def _search_chunk(index: Index, c: Chunk, threshold: float, overlap: float, answer_overlap: float, out: dict[int, dict[object, dict]]) -> None:
    h, stride = c.hashes, index.length
    term = np.searchsorted(index.terms, h)
    term[term == len(index.terms)] = 0
    known = index.terms[term] == h
    bound = np.concatenate([[0.0], np.cumsum(np.where(known, index.best[term], 0.0))])
    rare = np.concatenate([[0.0], np.cumsum(np.where(known, index.rare_best[term], 0.0))])
    passages = np.maximum(1, -(-(c.counts() - stride) // stride))
    owner = np.repeat(np.arange(c.n), passages)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(passages) - passages, passages)
    lo = c.at[owner] + nth * stride
    hi = np.minimum(lo + 2 * stride, c.at[owner + 1])
    possible = (bound[hi] - bound[lo] >= threshold - 1e-9) & (rare[hi] - rare[lo] >= threshold - index.common - 1e-9)
    for p in np.flatnonzero(possible):
        distinct = np.unique(term[lo[p] : hi[p]][known[lo[p] : hi[p]]])
        if index.best[distinct].sum() < threshold:
            continue
        for i, score in search(index, distinct, threshold):
            entry = index.entries[i]
            q, a = _overlaps(entry, h[lo[p] : hi[p]])
            if q >= overlap and (a is None or a >= answer_overlap):
                mine = out.setdefault(c.lo + int(owner[p]), {})
                if score > mine.get(entry.item_id, {"score": 0.0})["score"]:
                    mine[entry.item_id] = {"item_id": entry.item_id, "score": round(score, 6), "question_overlap": q, "answer_overlap": a}


def _tagger(shared, text_col: str, threshold: float, overlap: float, answer_overlap: float, kind: pa.DataType | None):
    """Adds the hits of each row, or, without a ``kind``, lets only rows without any pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            hits = find_hits(shared.value, batch.column(k), threshold, overlap, answer_overlap)
            if kind is None:
                keep = np.ones(batch.num_rows, bool)
                keep[list(hits)] = False
                yield batch.filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hits.get(i, []) for i in range(batch.num_rows)], kind)], [*batch.schema.names, "_hits"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words and the distinct terms of each item."""
    for batch in batches:
        ns, terms = [], []
        for c in chunks(batch.column("text"), NON_WORD, lower=True):
            for i in range(c.n):
                h = c.hashes[c.at[i] : c.at[i + 1]]
                ns.append(len(h))
                terms.append(np.unique(h).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["part", "n", "terms"])


def _parts(items: DataFrame, id_col: str, text_col: str, max_items: int, max_words: int) -> Iterator[list[Index]]:
    """The indexes of one part of the items after the other, all weighted by the statistics of all items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") / 2).alias("w")).first()
    parts = max(1, math.ceil(size["n"] / max_items), math.ceil((size["w"] or 0) / max_words))
    rows = durable(rows.withColumn("part", F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(parts)).cast("int")), "items")
    terms = durable(rows.select("part", "text").mapInArrow(_terms, "part int, n bigint, terms array<bigint>").where("n > 0"), "item-terms")
    total = terms.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    each = terms.select("part", F.explode("terms").alias("t"))
    df = durable(each.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "item-df")
    for k in range(parts):
        mine = df.join(each.where(F.col("part") == k).select("t").distinct(), "t", "left_semi")
        counts = {r["t"] % (1 << 64): r["df"] for r in mine.collect()}
        texts = sorted(((r["id"], r["text"]) for r in rows.where(F.col("part") == k).collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        yield build_indexes(texts, Statistics(total["n"], total["mean"] or 1.0, counts))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, overlap: float = 0.5, answer_overlap: float = 0.5, item_id_col: str = "item_id", item_text_col: str = "text", max_items: int = 20_000, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item."""
    sc, out = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = hits_type(items, item_id_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("_hits", kind)])
    for indexes in _parts(items, item_id_col, item_text_col, max_items, max_words):
        shared = sc.broadcast(indexes)
        got = rows.mapInArrow(_tagger(shared, "text", threshold, overlap, answer_overlap, to_arrow_type(kind)), schema)
        got = durable(got.select("doc_id", F.inline("_hits")), "hits")
        shared.destroy()
        out = got if out is None else out.unionByName(got)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.6, overlap: float = 0.5, answer_overlap: float = 0.5, item_id_col: str = "item_id", item_text_col: str = "text", max_items: int = 20_000, max_words: int = 2_000_000) -> DataFrame:
    """The documents that hold no test item; their columns unchanged."""
    sc, out, shared = docs.sparkSession.sparkContext, docs, None
    for indexes in _parts(items, item_id_col, item_text_col, max_items, max_words):
        if shared is not None:  # the part before is done with before the next is sent
            out = durable(out, "clean")
            shared.destroy()
        shared = sc.broadcast(indexes)
        out = out.mapInArrow(_tagger(shared, text_col, threshold, overlap, answer_overlap, None), docs.schema)
    return out
