"""Deterministic sampling and leakage-safe splits by hash rank. The hash is a digest any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def hash32(key: Column, seed: int = 42) -> Column:
    """A number below 2**32 from the first digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


#: A hash below 2**32 loses so many bits to give 65,536 bins: at 10**11 rows a bin holds 1.5 million.
BIN_BITS = 16


def ranked_by(df: DataFrame, order: list[Column], bin_: Column | None, *by: str) -> DataFrame:
    """_rn and _n: the place of a row within its stratum and the stratum's size. ``bin_`` must ascend with ``order``
    (None: ``df`` has its ``_bin``): places within a stratum and bin are counted by a window, the rows of the bins before are
    added. So no stratum is sorted in one task."""
    rows = df if bin_ is None else df.withColumn("_bin", bin_)
    per = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bin").alias("_by__bin"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    on = same(("_bin", *by), "_by_")
    placed = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(*order))).join(per, on)
    return placed.withColumn("_rn", (F.col("_rn") + F.col("_before")).cast("long")).drop("_bin", "_by__bin", "_before", *[f"_by_{c}" for c in by])


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` with a ``_bin`` that ascends with the order: the partition of a range sort. There are as many bins as Spark makes
    shuffle partitions, so a bin stays as large as a partition may be, whatever the size of the table or of a stratum. The
    table is written once, since a second sort could cut elsewhere."""
    return durable(df.repartitionByRange(*order).withColumn("_bin", F.spark_partition_id()), "ranged")


def same(by: tuple[str, ...], prefix: str) -> Column:
    """Equality of each column with its prefixed twin, nulls included. It is null-safe for bins, too, which hold none:
    from a plain equality the optimiser infers a filter on the bin's expression, in a plan that lacks its key."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(prefix + c))
    return on


def running(df: DataFrame, key: str, sums: dict[str, str], *by: str, descending: bool = False) -> DataFrame:
    """``df`` with the running sum of each column of ``sums`` (new name: column) in the order of a numeric key, and its
    total as ``<new name>_all``, per stratum. Rows are summed within bins of the key, bins over bins, so no stratum is
    sorted in one task. Keys are unique within a stratum."""
    way = F.desc if descending else F.asc
    rows = ranged(df, [*by, way(key)])
    per = rows.groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in sums.values()])
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{new}") for new, c in sums.items()]
    totals = [F.sum(c).over(Window.partitionBy(*by)).alias(f"{new}_all") for new, c in sums.items()]
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bin").alias("_by__bin"), *earlier, *totals)
    within = Window.partitionBy(*by, "_bin").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(c).over(within).alias(f"_in_{new}") for new, c in sums.items()])
    out = summed.join(per, same(("_bin", *by), "_by_"))
    return out.select(*df.columns, *[(F.col(f"_in_{new}") + F.col(f"_before_{new}")).alias(new) for new in sums], *[f"{new}_all" for new in sums])


def numbered(df: DataFrame, key: str, *by: str) -> DataFrame:
    """`ranked_by` in the order of a numeric key."""
    return ranked_by(ranged(df, [*by, key]), [F.col(key)], None, *by)


def ranked(df: DataFrame, key: str, *by: str, seed: int = 42) -> DataFrame:
    """_rn and _n: the rank of a row by hash within its stratum, and the stratum's size. Bins are the hash's first
    bits."""
    h = hash32(F.col(key), seed)
    return ranked_by(df, [h, F.col(key)], F.shiftright(h, BIN_BITS), *by)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:  # T07
    """Seeded sample of n rows: a top-k by hash, which Spark runs without a full sort."""
    return df.orderBy(hash32(F.col(key), seed), key).limit(n)


def per_stratum(df: DataFrame, key: str, quota: Column, *by: str, seed: int = 42) -> DataFrame:  # T08-T12
    return ranked(df, key, *by, seed=seed).where(F.col("_rn") <= quota).drop("_rn", "_n")


GOLDEN = 0.6180339887498949


def group_split(df: DataFrame, group: Column, stratum: str, ratios: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:  # D12
    """train / val / test by group: no group crosses splits, and each stratum keeps its share in all of them.

    A group may hold rows of several strata, so it is placed by its whole vector of counts. Groups are numbered in the
    order of these vectors, alike ones by hash, and number i goes where the fraction of i times the golden ratio falls: of
    any stretch of that order, and so of any kind of group, each split gets its share to within a few groups."""
    from ..sources.ordered import numbered

    tagged = df.withColumn("_g", group)
    per = tagged.groupBy("_g", F.col(stratum).cast("string").alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    counts = F.array_sort(F.collect_list(F.concat(F.coalesce("_s", F.lit("")), F.lit(":"), F.lpad(F.col("_c").cast("string"), 12, "0"))))  # one a stratum
    groups = per.groupBy("_g").agg(F.array_join(counts, ",").alias("_v")).withColumn("_h", hash32(F.col("_g"), seed))
    placed = numbered(groups, ["_v", "_h", "_g"], "_i")
    at = F.col("_i") * F.lit(GOLDEN) - F.floor(F.col("_i") * F.lit(GOLDEN))
    split = F.when(at < ratios[0], "train").when(at < ratios[0] + ratios[1], "val").otherwise("test")
    return tagged.join(placed.select(F.col("_g").alias("_to"), split.alias("split")), F.col("_g").eqNullSafe(F.col("_to"))).drop("_g", "_to")


def first_per_key(df: DataFrame, key: Column, *order: str) -> DataFrame:  # W07
    """The first row of each key: an aggregate with a map-side combine rather than a sorted window."""
    cols = df.columns
    one = df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return one.select("_r.*")
