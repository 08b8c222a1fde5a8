"""Texts that mean harm: very long ones of every special character, chains and unclosed mark-up, colliding words."""

import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from sievework.llm import decontam, exact, lines, mixing, near_dedup, periodic, pii, quality, resampling, sharding, substring, toxicity, url_filter
from sievework.llm import _words as W

LONG = 150_000
CHAINS = ["mail a@b" + ".c" * 1_000_000, "a@" * LONG, "a." * LONG + "@b", "1.2." * LONG, "4 " * LONG, "4-" * LONG, "+1(" * LONG, "<!--" * LONG, "<p" * LONG, "<script>" * LONG, "</style " * LONG, "< >" * LONG, "-->" * LONG,
          "a: " * LONG, "::" * LONG, "[at]" * LONG, "x_at_" * LONG, "(dot)" * LONG, "ab:" * LONG, "0" * LONG + ".1.1.1", "http://" * LONG, "é" * LONG, "😀 " * LONG, "\n" * LONG, "same line\n" * LONG, "w" * 10_000_000]
TEXTS = [c * LONG for c in sorted(set(string.punctuation + string.whitespace))] + CHAINS + ["The quiet harbour wakes before the sun, and boats return with silver nets of fish for the market on the old stone pier."] * 2


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("hostile"))
    df = spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, source string").repartition(8)
    df.write.parquet(f"{at}/documents.parquet")
    return spark.read.parquet(f"{at}/documents.parquet")


def _items(spark):
    return spark.createDataFrame([(1, "Where do boats return with silver nets of fish before the sun is up? the old stone pier")], "item_id bigint, text string")


def _labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(len(TEXTS))], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(
    "run",
    [
        pytest.param(lambda s, d: pii.find_pii(d), id="pii"),
        pytest.param(lambda s, d: quality.judge(d), id="quality"),
        pytest.param(lambda s, d: near_dedup.near_duplicates(d), id="near_dedup"),
        pytest.param(lambda s, d: lines.dedup_lines(d, "doc_id", "source", "text"), id="lines"),
        pytest.param(lambda s, d: sharding.shard(d, n_shards=4), id="sharding"),
        pytest.param(lambda s, d: toxicity.score_toxicity(d, _labels(s)), id="toxicity"),
        pytest.param(lambda s, d: substring.dedup_substrings(d), id="substring"),
        pytest.param(lambda s, d: mixing.mix(d), id="mixing"),
        pytest.param(lambda s, d: decontam.contaminated(d, _items(s)).select("doc_id").distinct(), id="decontam"),
        pytest.param(lambda s, d: url_filter.filter_urls(d.withColumnRenamed("text", "url").withColumnRenamed("doc_id", "page_id")), id="urls"),
        pytest.param(lambda s, d: resampling.resample(d, _items(s), min_words=1), id="resampling"),
        pytest.param(lambda s, d: exact.exact_duplicates(d), id="exact"),
        pytest.param(lambda s, d: periodic.collapse_runs(d), id="periodic"),
    ],
)
def test_operators_end(spark, hostile, run):
    """Every operator gives its row for every text, in time."""
    began = time.time()
    got = run(spark, hostile).select(F.count(F.lit(1))).first()[0]
    assert got <= len(TEXTS)
    assert time.time() - began < 120


def test_results_on_hostile_texts(spark, hostile):
    got = {r["doc_id"]: r for r in pii.find_pii(hostile.where("length(text) > 0")).collect()}
    assert len(got) == len(TEXTS)
    first = len(TEXTS) - len(CHAINS) - 2
    (span,) = got[first]["base"]
    assert (span["kind"], span["start"], span["end"]) == ("email", 5, 2_000_008)
    assert not any(got[k]["base"] for k in range(first))
    out = {r["page_id"]: r for r in lines.dedup_lines(hostile, "doc_id", "source", "text", min_pages=10**6).collect()}
    assert out[first + 7]["n_lines"] == 0  # a comment that is not closed
    assert out[first + 8]["kept_text"] == "<p" * LONG  # tags that are not closed
    assert out[first + 9]["n_lines"] == 0
    assert out[len(TEXTS) - 1]["kept_text"] == TEXTS[-1]


def test_pipeline_on_hostile_texts(spark, hostile, tmp_path):
    import corpus_pipeline

    at = str(tmp_path)
    hostile.write.parquet(f"{at}/documents.parquet")
    _items(spark).write.parquet(f"{at}/benchmark.parquet")
    began = time.time()
    out = corpus_pipeline.run(spark, at)
    assert out.columns == [*hostile.columns, "shard", "slot"] and out.count() <= 3 * len(TEXTS)
    assert time.time() - began < 300


def test_page_stripping_is_linear(spark):
    """Twice the mark-up takes about twice the time; half a million openers end in seconds."""
    pages = [(k, "http://x.org/", part * n + "end > tail < open") for k, (part, n) in enumerate([("<!--", 500_000), ("<p", 500_000), ("<", 2_000_000), ("<script", 300_000), ("<style>a", 300_000), ("</p", 500_000)])]
    began = time.time()
    got = {r["page_id"]: r["kept_text"] for r in lines.dedup_lines(spark.createDataFrame(pages, "page_id bigint, url string, html string"), min_pages=10).collect()}
    assert time.time() - began < 60
    assert got == {0: "", 1: "tail < open", 2: "tail < open", 3: "", 4: "", 5: "tail < open"}


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse_words_stay_apart(spark, n):
    """Runs that agree under every odd base modulo 2**64, as bytes and as words."""
    a, b = thue_morse(n), thue_morse(n, True)
    for which in (0, 1):
        for kind in (np.uint8, np.uint64):
            v = np.frombuffer((a + b).encode(), np.uint8).astype(kind)
            one, other = W.run_hashes(v, np.array([0, n]), np.array([n, 2 * n]), which)
            assert one != other
    filler = [f"word{k}" for k in range(60)]
    texts = [(1, " ".join([*filler[:30], a, *filler[30:]])), (2, " ".join([*filler[:30], b, *filler[30:]])), (3, " ".join([a] * 3 + ["x"])), (4, " ".join([b] * 3 + ["x"])), (5, " ".join(a[:60])), (6, " ".join(b[:60])), (7, " ".join(a)), (8, " ".join(b))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    parts = brute.near_components(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, size=2, threshold=80).collect()} == {i: c for i, (_, c) in parts.items()}
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(docs, n_batches=1).collect()}
    assert got == {i: x[1] for i, x in brute.substring(texts, 50).items()} and got[1] == got[2] == 0


def test_run_hashes_against_plain_arithmetic(monkeypatch):
    rng = np.random.default_rng(4)
    for kind in (np.uint8, np.uint64):
        values = rng.integers(0, 255 if kind == np.uint8 else 1 << 63, 5000).astype(kind) * kind(1 if kind == np.uint8 else 2) + kind(1)
        starts = np.sort(rng.integers(0, 4900, 400))
        ends = np.sort(starts + rng.integers(0, 100, 400))
        ends = np.maximum(ends, starts)
        base = int.from_bytes(W.hashlib.sha256(f"{W.SEED}:1".encode()).digest(), "big") % (W.PRIME - 2) + 2
        plus = 1 if kind == np.uint8 else 0
        want = np.array([sum((int(v) + plus) * pow(base, k, W.PRIME) for k, v in enumerate(values[s:e])) % W.PRIME for s, e in zip(starts, ends)], np.uint64)
        want = W.mix(want ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        assert (W.run_hashes(values, starts, ends, 1) == want).all()
        monkeypatch.setattr(W, "CHUNK_BYTES", 100)
        assert (W.run_hashes(values, starts, ends, 1) == want).all()
        monkeypatch.undo()


def test_products_modulo_the_prime():
    rng = np.random.default_rng(9)
    a, b = (np.append(rng.integers(0, W.PRIME, 3000).astype(np.uint64), np.uint64(x)) for x in (W.PRIME - 1, W.PRIME - 1))
    assert W.times(a, b).tolist() == [int(x) * int(y) % W.PRIME for x, y in zip(a, b)]
