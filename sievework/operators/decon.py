"""Exact, prefix and n-gram decontamination. Grams travel as hashes; the evaluation side is pruned first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, let


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast only for a side of a checked size; above it Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def norm_words(t: Column) -> Column:
    return F.array_remove(F.split(collapse(t), " "), "")


def hashed_grams(words: Column, n: int) -> Column:
    """Hashes of all n-word runs: hashes of 1, 2, 4, ... words are combined pairwise, so a run costs a few hash steps
    however long it is."""

    def joined(a: Column, b: Column, shift: int) -> Column:
        m = F.greatest(F.lit(0), F.size(b) - shift)
        return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(shift + 1), m), lambda p, q: F.xxhash64(p, q))

    def build(h: Column, size: int, left: int, done: Column | None, have: int) -> Column:
        """done: hashes of ``have`` words already joined; h: hashes of ``size`` words; left: words still to join."""
        if left & size:
            done = h if done is None else let(F.struct(done.alias("d"), h.alias("h")), lambda x, k=have: joined(x["d"], x["h"], k))
            have, left = have + size, left - size
        return done if not left else let(h, lambda x: build(joined(x, x, size), size * 2, left, done, have))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: build(h, 1, n, None, 0))


def gram_hashes(df: DataFrame, text: str, n: int, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array_distinct(hashed_grams(norm_words(F.col(text)), n))).alias("_h"))


def ngram_hits(df: DataFrame, other: DataFrame, key: str, text: str = "text", n: int = 8, max_grams: int = 500_000) -> DataFrame:  # J05
    """Distinct keys of rows that share any n-gram with ``other``."""
    grams = gram_hashes(other, text, n).distinct()
    return gram_hashes(df, text, n, key).join(bounded_broadcast(grams, max_grams), "_h", "left_semi").select(key).distinct()


def decontaminate(df: DataFrame, other: DataFrame, key: str = "doc_id", text: str = "text", n: int = 8) -> DataFrame:  # D11
    """Each row with a reason: 'duplicate' (not the first of its normalised text), 'exact', 'ngram' or 'kept'."""
    rows = df.select(F.col(key), F.xxhash64(collapse(F.col(text))).alias("_q"))
    first = rows.groupBy("_q").agg(F.min(key).alias("_first"))
    exact = bounded_broadcast(other.select(F.xxhash64(collapse(F.col(text))).alias("_q")).distinct().withColumn("_exact", F.lit(True)), 1_000_000)
    hits = ngram_hits(df, other, key, text, n).withColumn("_gram", F.lit(True))
    tagged = rows.join(first, "_q").join(exact, "_q", "left").join(hits, key, "left")
    reason = F.when(F.col(key) != F.col("_first"), "duplicate").when(F.col("_exact"), "exact").when(F.col("_gram"), "ngram").otherwise("kept")
    return tagged.select(key, reason.alias("reason"))


def overlap(train: DataFrame, evaluation: DataFrame, key: Column) -> DataFrame:  # J04, D06, D08
    """Distinct evaluation keys, how many occur in training, the share, and a status."""
    e = evaluation.select(key.alias("_k")).distinct()
    t = train.select(key.alias("_k")).distinct().withColumn("_in", F.lit(1))
    out = e.join(t, "_k", "left").agg(F.count(F.lit(1)).alias("n_eval"), F.count("_in").alias("n_overlap"))
    pct = F.round(100.0 * F.col("n_overlap") / F.col("n_eval"), 6)
    return out.select("*", pct.alias("pct"), F.when(F.col("n_overlap") == 0, "CLEAN").when(pct < 5, "PARTIAL").otherwise("LEAK").alias("status"))
