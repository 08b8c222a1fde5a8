"""Toxicity by maximum-scoring segments of token log-odds.

Tokens (lower-cased words and their first 4 to 7 bytes, so that inflected and compound forms share evidence) get the
log-odds ratio of toxic against clean labelled documents under an informative Dirichlet prior; all whose z-score is
significant keep it, toxic or clean, all others a small negative score. A token scores by the most toxic of its
features, without one by the cleanest. In each text the linear-time algorithm for all maximal scoring
segments finds the passages. Each segment's score is turned into an expected number of such segments by chance in a
text of that length (its E-value: an extreme-value law whose rate and scale come from clean labelled documents); those
up to ``max_e`` are listed as toxic passages. A logistic curve over the logarithm of the best segment's E-value, fitted
on labelled documents, gives the probability of the text.

Three narrow passes: count tokens of labelled documents, score all documents, fit two curves on counts. Labels are
sent to the executors; ``max_labelled`` bounds them (a hash sample beyond it), and so the features, all of which
are sent.

Defined results: null and empty texts get the probability of a text without any hit; a null doc_id is not a labelled
row; a doc_id labelled twice counts as toxic if any label says so; with no labels at all every score is 0; repeated
rows each get their result; of segments that tie the first is the best; an empty table gives an empty result; other
columns are ignored. A very long text costs time and memory in proportion to its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable
from ._words import NON_WORD, Chunk, chunks, mix, run_hashes

PREFIXES = (4, 5, 6, 7)
BACKGROUND = -0.25
SEGMENT = "array<struct<start:int,end:int,score:double>>"


def token_features(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, feature hashes): whole words, then each prefix length of longer words."""
    out = [(np.arange(len(c.starts)), c.hashes)]
    for k in PREFIXES:
        longer = np.flatnonzero(c.ends - c.starts > k)
        out.append((longer, mix(run_hashes(c.data, c.starts[longer], c.starts[longer] + k) ^ np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1)))))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a feature, summed per batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        keys, classes = [], []
        for c in chunks(batch.column("text"), NON_WORD, lower=True):
            text = c.text_of()
            found = [(text[w], h) for w, h in token_features(c)]
            t, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            order = np.lexsort((h, t))
            t, h = t[order], h[order]
            once = np.ones(len(t), bool)
            once[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            keys.append(h[once])
            classes.append(toxic[c.lo + t[once]])
        if keys:
            h, y = np.concatenate(keys), np.concatenate(classes)
            u, inverse = np.unique(h, return_inverse=True)
            n1 = np.bincount(inverse, weights=y, minlength=len(u)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n1), pa.array(n - n1)], ["h", "n1", "n0"])


def fit_log_odds(labelled: DataFrame, min_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and the log-odds of all significant ones, positive and negative."""
    counts = durable(labelled.select("text", "toxic").mapInArrow(_count, "h bigint, n1 bigint, n0 bigint").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "tox-counts")
    total = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    if not total["n1"] or not total["n0"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    n1, n0 = float(total["n1"]), float(total["n0"])
    strength = 0.1
    prior = strength * (F.col("n1") + F.col("n0"))
    mass = strength * (n1 + n0)
    odds = lambda y, n: F.log((y + prior) / (n + mass - y - prior))
    delta = odds(F.col("n1"), n1) - odds(F.col("n0"), n0)
    z = delta / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    held = F.when(delta > 0, F.col("n1")).otherwise(F.col("n0"))
    best = counts.where(held >= 2).select("h", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= min_z).select("h", "delta").toArrow()
    h = best.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], best.column("delta").to_numpy()[order]


def maximal_segments(at: list[int], score: list[float], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score) in linear time. Positions not listed score
    ``background`` each; listed ones score positively."""
    sums, total, previous = [], 0.0, -1
    for p, s in zip(at, score):
        left = total + background * (p - previous - 1)
        previous, total = p, left + s
        sums.append((left, total))
    return _segments(at, [x[0] for x in sums], [x[1] for x in sums])


def _segments(at: list[int], lefts: list[float], rights: list[float]) -> list[tuple[int, int, float]]:
    """The same from the positions that score positively and the sums of all scores before and after each."""
    stack: list[list[float]] = []  # left sum, right sum, first, last
    for p, left, right in zip(at, lefts, rights):
        now = [left, right, p, p]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= now[0]:
                j -= 1
            if j < 0 or stack[j][1] >= now[1]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(int(a), int(b), right - left) for left, right, a, b in stack]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, odds = shared.value
        for batch in batches:
            n, best, segments = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for c in chunks(batch.column("text"), NON_WORD, lower=True):
                n[c.lo : c.lo + c.n] = c.counts()
                worth, clean = np.zeros(len(c.starts)), np.zeros(len(c.starts))
                if len(hashes):
                    for words, h in token_features(c):
                        k = np.searchsorted(hashes, h)
                        k[k == len(hashes)] = 0
                        mine = np.where(hashes[k] == h, odds[k], 0.0)
                        worth[words], clean[words] = np.maximum(worth[words], mine), np.minimum(clean[words], mine)
                hit = np.flatnonzero(worth)
                each = np.where(worth > 0, worth, np.where(clean < 0, clean, BACKGROUND))
                edges = np.searchsorted(hit, c.at)
                for i in np.flatnonzero(np.diff(edges)):
                    mine = hit[edges[i] : edges[i + 1]] - c.at[i]
                    sums = np.concatenate([[0.0], np.cumsum(each[c.at[i] : c.at[i + 1]])])
                    found = _segments(mine.tolist(), sums[mine].tolist(), sums[mine + 1].tolist())
                    best[c.lo + i] = max(s for _, _, s in found)
                    segments[c.lo + i] = [{"start": a, "end": b + 1, "score": s} for a, b, s in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(best), pa.array(segments, kind)], ["doc_id", "n", "best", "segments"])

    return run


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve over (x, toxic, clean), by damped Newton steps with a
    weak prior."""
    x = np.array([b[0] for b in bins])
    y1, y0 = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    a, b = 1.0, math.log((y1.sum() + 1) / (y0.sum() + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((y1 + y0) * p - y1) @ x + 0.01 * a, ((y1 + y0) * p - y1).sum() + 0.01 * b])
        w = (y1 + y0) * p * (1 - p)
        hess = np.array([[w @ (x * x) + 0.01, w @ x], [w @ x, w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_folds: int = 5, min_z: float = 3.5, max_labelled: int = 400_000, max_e: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_tokens, segments (word positions, scores and
    E-values of the maximal segments whose E-value is at most ``max_e``), n_maximal (all maximal segments) and e_value
    (of the best one).

    Rows whose crc32(doc_id as text) is divisible by ``held_out_folds`` are never learnt from."""
    sc = docs.sparkSession.sparkContext
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held_out_folds)) == 0
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held)
    known = durable(known.select(F.col("doc_id").alias("_l"), F.col("toxic").cast("int").alias("toxic")), "tox-labels")
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("_l"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = fit_log_odds(rows.join(F.broadcast(known), F.col("doc_id") == F.col("_l")), min_z)
    scored = rows.mapInArrow(_score(sc.broadcast(model)), f"doc_id {dict(rows.dtypes)['doc_id']}, n bigint, best double, segments {SEGMENT}")
    scored = durable(scored, "tox-scores")
    train = scored.join(F.broadcast(known), F.col("doc_id") == F.col("_l"))
    clean = train.where("toxic = 0").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"), F.count(F.when(F.col("best") > 0, 1)).alias("k"), F.sum("best").alias("s")).first()
    rate = (clean["k"] + 0.5) / ((clean["n"] or 0) + 1.0)
    scale = (clean["k"] + 1.0) / ((clean["s"] or 0.0) + 4.0)
    # expected segments of this score or better by chance; a text without a hit has score 0
    log_e_of = lambda best: F.log(F.lit(rate) * F.greatest("n", F.lit(1))) - F.lit(scale) * best
    log_e = log_e_of(F.col("best"))
    x = F.greatest(F.lit(-20.0), F.least(F.lit(60.0), F.when(F.col("best") > 0, -log_e).otherwise(F.least(-log_e, F.lit(0.0)) - 2.0)))
    bins = train.groupBy((F.round(x * 4) / 4).alias("x")).agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("y1"), F.count(F.when(F.col("toxic") == 0, 1)).alias("y0")).collect()
    slope, offset = _logistic([(r["x"], r["y1"], r["y0"]) for r in sorted(bins, key=lambda r: r["x"])]) if bins else (0.0, -40.0)
    score = 1 / (1 + F.exp(-(F.lit(slope) * x + F.lit(offset))))
    rated = F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), F.exp(log_e_of(s["score"])).alias("e_value")))
    listed = F.filter(rated, lambda s: s["e_value"] <= max_e)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("n").alias("n_tokens"), listed.alias("segments"), F.size("segments").alias("n_maximal"), F.exp(log_e).alias("e_value"))
