"""What the operators share: reading tables, durable intermediate tables and row keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, remove, scratch_path

#: One word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; only Spark's readers touch the path, so any store will do."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Removes a durable table that no DataFrame still to be run reads."""
    remove(spark, path)


def durable(df: DataFrame, name: str = "part", path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back. A lost executor then
    costs the tasks it ran, not the whole history. The table goes when the Python process ends."""
    spark = df.sparkSession
    path = path or durable_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use: Callable[[Column], Column] = lambda x: x) -> Column:
    """``use(value)`` with ``value`` computed once. Columns are expressions: one that a lambda mentions would be
    computed anew for every element, and one that many columns mention is copied into each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_id(doc_id: Column, text: Column) -> Column:
    """A key that rows share only if they hold the same doc_id and text. Operators that come back to a row use
    it, so that a doc_id given twice with different texts stays two documents and never multiplies rows."""
    return F.xxhash64(doc_id.cast("string"), text)


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the size check before a broadcast. ``df`` should be a durable table
    or cheap to run, since the check runs it."""
    return df.limit(rows + 1).count() <= rows


SALTS = 32


def salted_join(big: DataFrame, one: DataFrame, keys: list[str], place: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``one``, which holds each key once. The rows of a hot key go to ``salts`` tasks by their
    ``place``; each row of ``one`` goes to all of them."""
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = big.withColumn("_salt", F.pmod(F.xxhash64(place, F.lit(11)), F.lit(salts)).cast("int"))
    return out.join(spread, [*keys, "_salt"], how).drop("_salt")


#: A key is hot from total / `HOT_KEYS` rows on, and in any case from `HOT_ROWS` rows on.
HOT_KEYS, HOT_ROWS = 10_000, 1_000_000


def hot_limit(total: int) -> int:
    """The number of rows above which a key is hot. No more than max(`HOT_KEYS`, total / `HOT_ROWS`) keys can be: at
    10**12 rows a million keys, some tens of MB to broadcast, and no cold key has more than `HOT_ROWS` rows."""
    return max(1000, min(total // HOT_KEYS, HOT_ROWS))


def hot_join(big: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``big`` joined (inner) with ``one``, a durable table that holds each key once and in ``_n`` the number of its
    rows in ``big``. The number of hot keys is bounded (`hot_limit`), so they are broadcast and their rows stay where
    they are. All other keys are small and joined by shuffle."""
    limit = hot_limit(one.agg(F.sum("_n").alias("n")).first()["n"] or 0)
    hot = one.where(F.col("_n") > limit)
    if hot.isEmpty():
        return big.join(one.drop("_n"), keys)
    cold = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.where(F.col("_n") <= limit).drop("_n"), keys)
    met = big.join(F.broadcast(hot.drop("_n")), keys)
    return met.unionByName(cold)


def salt_hot(big: DataFrame, counts: DataFrame, key: str | list[str], place: Column) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``big`` with a ``_salt``, and a function that spreads a table of unique keys over the salts, for a join on both.
    ``counts``: durable (key, _n). The rows of a hot key (see `hot_limit`) are dealt by their ``place`` over as many
    salts as it is times too large, so that the copies of hot keys number at most twice the hot keys there can be."""
    key = [key] if isinstance(key, str) else key
    limit = hot_limit(counts.agg(F.sum("_n").alias("n")).first()["n"] or 0)
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(*key, F.ceil(F.col("_n") / limit).cast("int").alias("_k")))
    k = F.coalesce("_k", F.lit(1))
    salted = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(place, F.lit(13)), k).cast("int")).drop("_k")
    return salted, lambda one: one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), k - 1))).drop("_k")


def lookup(big: DataFrame, one: DataFrame, keys: list[str], place: Column, rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``one`` (durable, each key once): broadcast within the bound, otherwise salted."""
    return big.join(F.broadcast(one), keys, how) if small(one, rows) else salted_join(big, one, keys, place, how)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only within the bound; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if small(df, rows) else df
