"""Exact de-duplication, importance resampling and periodic runs against brute force, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from sievework.llm import _common, exact, periodic, queries, resampling
from sievework.llm._words import NON_WORD, chunks

AWKWARD = [
    (1, "a b c"), (2, "abc"), (3, " a\tb\nc\r\x0b\x0c "), (4, None), (5, ""), (6, " \n"), (None, "abc"), (2, "abc"), (None, "   a b c  "), (7, "a bc"), (8, "😀 é"), (9, "😀é"),
    (10, "w " * 50_000), (11, "w" * 1_000_000), (12, "x y " * 20_000 + "end"), (13, "one two three " * 7), (14, "é" * 70 + " " + "b" * 64 + " " + "c" * 65 + " d"), (15, "A a A a A a"),
    (3, "word " * 30), (3, "word " * 30), (None, "some other words of which there are more than twenty in all so that it may be drawn as well as any other one here"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").repartition(3)
    for clash in ("digest", "row", "run", "best", "copies", "score", "weight", "n_words", "rank", "runs", "size", "leaf", "keep_id"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def table_rows(spark, path):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_exact_dedup_awkward_rows(spark, awkward, fanout):
    got = exact.exact_duplicates(awkward, fanout=fanout).collect()
    assert tuple(got[0].__fields__) == EXACT
    assert ordered(got) == ordered(brute.exact_groups(AWKWARD))
    kept = exact.drop_exact_duplicates(awkward, fanout=fanout)
    assert kept.columns == awkward.columns
    # of rows that are equal altogether one stays
    assert kept.count() == sum(r[3] for r in brute.exact_groups(AWKWARD))
    assert exact.exact_duplicates(awkward.limit(0)).collect() == [] == exact.drop_exact_duplicates(awkward.limit(0)).collect()


def test_exact_dedup_whole_table(spark, small):
    assert ordered(queries.op12_exact_dedup(spark, small).collect()) == ordered(brute.exact_groups(table_rows(spark, small)))


def test_exact_dedup_hot_group_and_digest_collisions(spark, monkeypatch):
    """A third of all rows in one group, spread over salts; ids of another type; equal digests that are not verified."""
    monkeypatch.setattr(_common, "hot_limit", lambda total: 50)
    rows = [(f"d{k:05d}", ("same text" if k % 3 else f"text {k % 40} of {k}") + " " * (k % 7)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "name string, body string").repartition(7)
    got = exact.exact_duplicates(docs, "name", "body", fanout=2)
    best = min((-len(t), i) for i, t in rows if t.startswith("same"))[1]
    hot = [r for r in got.collect() if r["group_size"] > 100]
    assert len(hot) == 2000 and {r["keep_id"] for r in hot} == {best} and [r["doc_id"] for r in hot if r["kept"]] == [best]
    entry = "run int, digest bigint, sha binary, size int, best struct<fewer:int,nameless:boolean,doc_id:bigint,row:bigint>, copies bigint"
    runs = spark.createDataFrame([(0, 5, b"a", 1, (-1, False, 1, 0), 1), (1, 5, b"b", 1, (-1, False, 2, 1), 1), (1, 5, b"a", 1, (-1, False, 0, 2), 1)], entry)
    assert sorted((bytes(r["sha"]), r["best"]["doc_id"], r["copies"]) for r in exact.merge_runs(runs, 2).collect()) == [(b"a", 0, 2), (b"b", 2, 1)]


def test_feature_buckets_are_crc32():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abZ9é😀") for _ in range(rng.choice((1, 3, 12, 63, 64, 65, 300)))) for _ in range(rng.randrange(9))) for _ in range(60)] + ["", "one", "x" * 2_000_000]
    import pyarrow as pa

    got = {}
    for c in chunks(pa.array(texts), NON_WORD, lower=True):
        text, bucket = resampling.features(c, 10_000)
        for i, b in zip(text.tolist(), bucket.tolist()):
            got.setdefault(c.lo + i, []).append(b)
    for i, t in enumerate(texts):
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        assert sorted(got.get(i, [])) == sorted(zlib.crc32(f.encode()) % 10_000 for f in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))])


def test_resampling_whole_table(spark, small):
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(kind == "bigint" for _, kind in got.dtypes)
    assert ordered(got.collect()) == ordered(brute.resampled(table_rows(spark, small), target))


def test_resampling_awkward_rows(spark, awkward):
    target = spark.createDataFrame([("Word some words",), (None,), ("",)], "text string")
    for percent in (0, 25, 100):
        got = ordered(resampling.resample(awkward, target, percent=percent).collect())
        want = ordered(brute.resampled(AWKWARD, ["Word some words", None, ""], percent))
        # rows equal in doc_id and score may share their ranks in any order
        assert sorted((str(r[:4]), r[4] is None) for r in got) == sorted((str(r[:4]), r[4] is None) for r in want)
        assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert resampling.resample(awkward.limit(0), target).collect() == []
    assert len(resampling.resample(awkward, target.limit(0)).collect()) == len(AWKWARD)


def test_resampling_ties_at_the_cutoff(spark, monkeypatch):
    """All documents with one score: the smallest ids are drawn, in order."""
    monkeypatch.setattr(resampling, "gumbel", lambda doc_id, seed: F.lit(0).cast("bigint"))
    docs = spark.createDataFrame([(k, "same words again " * 8) for k in range(100, 0, -1)], "doc_id bigint, text string").repartition(5)
    got = resampling.resample(docs, docs.limit(1), percent=33).where("rank IS NOT NULL").collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(k, k) for k in range(1, 34)]


def test_resampling_prefers_the_target(spark):
    """Documents of the target's words are drawn more than twice as often as their share."""
    rng = random.Random(5)
    common, rare = [f"w{k}" for k in range(300)], [f"t{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(rare if k % 10 == 0 else common) for _ in range(40))) for k in range(2000)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(" ".join(rare * 3),)], "text string"), percent=10)
    drawn = [r["doc_id"] for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 200 and sum(i % 10 == 0 for i in drawn) > 50  # 20 without weights


def test_periodic_runs_whole_table(spark, tiny):
    got = queries.op13_periodic_runs(spark, tiny)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert ordered(got.collect()) == ordered(brute.op13_row(i, t) for i, t in table_rows(spark, tiny))


def test_periodic_runs_awkward_rows(spark, awkward):
    got = periodic.collapse_runs(awkward).collect()
    want = []
    for i, t in AWKWARD:
        ws = brute.WORD.findall(t or "")
        runs = brute.periodic_runs(ws) if len(ws) < 1000 else {10: [(0, 50_000, 1)], 12: [(0, 40_000, 2)]}[i]
        want.append((i, len(ws), runs, hashlib.sha256(brute.collapsed(ws, runs).encode()).hexdigest()))
    seen = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got]
    assert ordered(seen) == ordered(want)
    assert periodic.collapse_runs(awkward.limit(0)).collect() == []
    planted = queries.planted_repeats(awkward).collect()
    assert ordered((r["doc_id"], tuple(brute.WORD.findall(r["text"] or ""))) for r in planted) == ordered((i, tuple(brute.planted(i, t))) for i, t in AWKWARD)


def _with_sentinels(texts):
    lo, ids = [], []
    for k, t in enumerate(texts):
        lo.append(len(ids))
        ids += [*t, -2 - k]
    return np.array(ids, np.int64), np.array(lo, np.int64), np.array([a + len(t) for a, t in zip(lo, texts)], np.int64)


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("matrix", [1 << 21, 64])
def test_periodic_runs_of_hostile_sequences(monkeypatch, matrix):
    """Nested periods, long periods, near repetitions, Fibonacci words, random words over few letters."""
    monkeypatch.setattr(periodic, "MATRIX", matrix)
    rng = random.Random(8)
    texts = [_fibonacci(900), [0] * 500, [0, 1] * 300, ([0] * 40 + [1]) * 30, [rng.randrange(2) for _ in range(700)], [], [0], [0] * 5, [0] * 6]
    for period in (7, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 127, 130, 250):
        root = [rng.randrange(50) for _ in range(period)]
        for words in (4 * period - 1, 4 * period, 4 * period + 3, 9 * period + 5):
            pad = [100 + rng.randrange(50) for _ in range(rng.randrange(90))]
            texts.append(pad + (root * 10)[:words] + pad[::-1])
        inner = root + [7] * 9
        texts += [inner * 5, (inner * 5 + [3]) * 4, (root * 4)[:-1] + [99] + root * 5]
    ids, lo, hi = _with_sentinels(texts)
    start, length, period = periodic.find_runs(ids, lo, hi)
    got = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        k = int(np.searchsorted(lo, s, "right")) - 1
        got[k].append((s - int(lo[k]), n, q))
    for t, g in zip(texts, got):
        assert g == brute.periodic_runs(t)


def _of_two_periods(p, q, n):
    """The word of ``n`` letters with both periods and as many different letters as they allow."""
    s = list(range(n))
    while True:
        was = list(s)
        for d in (p, q):
            for i in range(n - d):
                s[i] = s[i + d] = min(s[i], s[i + d])
        if s == was:
            return s


def test_periodic_runs_that_overlap():
    """Two runs of barely four periods each share almost as many words as they can; both are found, wherever the midpoints lie."""
    rng, texts = random.Random(5), []
    for p, q, shared in [(31, 18, 46), (30, 16, 41), (62, 35, 85), (59, 33, 80), (28, 17, 40), (31, 29, 50)]:
        both = _of_two_periods(p, q, shared)
        for first, second in ((p, q), (q, p)):
            s = list(both)
            while len(s) < 4 * first:
                s.insert(0, s[first - 1])
            for _ in range(4 * second - shared):
                s.append(s[-second])
            for before in range(0, 64, 3):
                texts.append([1000 + k for k in range(before)] + s + [2000 + k for k in range(rng.randrange(40))])
    ids, lo, hi = _with_sentinels(texts)
    got = [[] for _ in texts]
    for s, n, q in zip(*(x.tolist() for x in periodic.find_runs(ids, lo, hi))):
        k = int(np.searchsorted(lo, s, "right")) - 1
        got[k].append((s - int(lo[k]), n, q))
    for t, g in zip(texts, got):
        assert g == brute.periodic_runs(t)


def test_periodic_runs_stay_fast_on_long_texts():
    """A million words of one word, of a Fibonacci word, and of a period of 300,000: near-linear time."""
    rng = random.Random(1)
    root = [rng.randrange(1000) for _ in range(100_000)]
    for t, want in (([5] * 1_000_000, [(0, 1_000_000, 1)]), (_fibonacci(300_000), []), (root * 4 + root[:7], [(0, 400_007, 100_000)])):
        got = periodic.find_runs(*_with_sentinels([t]))
        assert list(zip(*(x.tolist() for x in got))) == want


def test_exact_dedup_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    out = queries.op12_exact_dedup(spark, small).select("doc_id", "group_size", "keep_id", "kept", "text_sha256")
    assert ordered(out.collect()) == ordered(con.sql(f"SELECT doc_id, group_size, keep_id, kept, text_sha256 FROM ({queries.OP12_SQL})").fetchall())
