"""How queries are registered, and the views that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


class Plan:
    """Collects queries of one module with their SQL (None where SQL cannot express them)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            if f.__name__ in self.queries:
                raise ValueError(f"registered twice: {f.__name__}")
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unit(prefix: str, key: str):
    """A number in [0, 1) from a digest of the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(prefix), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def four(c):
    """Four decimals, by the same arithmetic in every engine."""
    return F.floor(c * 10000 + 0.5) / 10000.0


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels with two deterministic scores: the view on which metrics run in the absence of a model."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    y = F.col("toxic").cast("double")
    return j.select(F.col("doc_id").alias("item_id"), "source", "lang", "n_chars", "quality", F.col("toxic").alias("label"), four(y * 0.35 + unit("", "doc_id") * 0.65).alias("prob"), four(y * 0.3 + unit("b", "doc_id") * 0.7).alias("prob_b"))


SCORED = """
scored AS (
  SELECT d.doc_id AS item_id, source, lang, n_chars, quality, toxic AS label,
         floor((toxic::DOUBLE * 0.35::DOUBLE + (('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) * 0.65::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS prob,
         floor((toxic::DOUBLE * 0.3::DOUBLE + (('0x' || substr(md5('b' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) * 0.7::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS prob_b
  FROM documents d JOIN labels l USING (doc_id))
"""
CELLS = "count(*) FILTER (label = 1 AND prob >= 0.5::DOUBLE) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5::DOUBLE) AS fp, count(*) FILTER (label = 0 AND prob < 0.5::DOUBLE) AS tn, count(*) FILTER (label = 1 AND prob < 0.5::DOUBLE) AS fn"
DERIVED = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr"
NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
HASH32 = "('0x' || substr(md5('42:' || {0}::VARCHAR), 1, 8))::BIGINT"
