"""Classifier metrics as DataFrame operators over (label, prob): one pass or one window each, never per threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .splits import running, same


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cells(pred: Column) -> dict[str, Column]:
    y = F.col("label")
    count = lambda c: F.count(F.when(c, 1))
    return {"tp": count((y == 1) & (pred == 1)), "fp": count((y == 0) & (pred == 1)), "tn": count((y == 0) & (pred == 0)), "fn": count((y == 1) & (pred == 0))}


def confusion(df: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:  # A03
    pred = (F.col("prob") >= threshold).cast("int")
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in cells(pred).items()])


def derived(df: DataFrame) -> DataFrame:  # A04
    """Precision, recall, F1, accuracy and FPR of counts; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    z = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    return df.select("*", z(ratio(tp, tp + fp)).alias("precision"), z(ratio(tp, tp + fn)).alias("recall"), z(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), z(ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"), z(ratio(fp, fp + tn)).alias("fpr"))


def sweep(df: DataFrame, thresholds: list[float], *by: str) -> DataFrame:  # A09
    """Counts at each threshold from a histogram over the grid and a reverse running sum: the data are read once and
    only (thresholds x groups) rows move."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    k = let(F.col("prob"), lambda p: F.size(F.filter(grid, lambda t: p >= t)))
    hist = df.groupBy(*by, k.alias("k")).agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("q"))
    totals = hist.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.collect_list(F.struct("k", "p", "q")).alias("h"))
    rows = totals.select(*by, "pos", "neg", "h", F.posexplode(grid).alias("i", "threshold"))
    total = lambda c: F.aggregate(F.filter("h", lambda x: x["k"] > F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    return rows.select(*by, "threshold", total("p").alias("tp"), total("q").alias("fp"), "pos", "neg").select(*by, "threshold", "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"))


def curve(df: DataFrame, *by: str) -> DataFrame:  # W01
    """tp and fp at or above each distinct score, and all positives and negatives. Aggregated by score first, so only
    distinct scores are ordered."""
    per = df.where("prob IS NOT NULL").groupBy(*by, "prob").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    return running(per, "prob", {"tp": "p", "fp": "q"}, *by, descending=True).withColumnsRenamed({"tp_all": "pos", "fp_all": "neg"})


def with_quantiles(aggregated: DataFrame, df: DataFrame, col: str, quantiles: dict[str, float], *by: str) -> DataFrame:
    """Adds exact quantiles of ``col`` (interpolated between neighbours; nulls left out) to a table with a row per group.
    They are read off the running counts of distinct values: no group's values meet in one buffer."""
    per = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(per, "_v", {"_upto": "_c"}, *by)

    def at(q: float) -> Column:
        place = F.lit(q) * (F.col("_upto_all") - 1)
        value = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
        low, high, part = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        return r6(low + (high - low) * part)

    found = placed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*[at(q).alias(name) for name, q in quantiles.items()])
    return aggregated.join(found, same(by, "_by_"), "left").drop(*[f"_by_{c}" for c in by])


def curve_metrics(df: DataFrame, target: float, *by: str) -> DataFrame:  # A10-A12
    """All from one curve. auroc, tie-correct: each positive beats the negatives below and half of those that tie.
    ap: sum of precision times the step of recall. tpr: the best within a false positive rate of ``target``."""
    p, q, tp, fp, pos, neg = (F.col(c) for c in ("p", "q", "tp", "fp", "pos", "neg"))
    won = F.sum(p * ((neg - fp) + 0.5 * q))
    within = F.max(F.when(ratio(fp, neg) <= target, ratio(tp, pos)))
    return curve(df, *by).groupBy(*by).agg(r6(ratio(won, F.max(pos) * F.max(neg))).alias("auroc"), r6(F.sum(ratio(p, pos) * tp / (tp + fp))).alias("ap"), r6(F.coalesce(within, F.lit(0.0))).alias("tpr"))


def auroc(df: DataFrame, *by: str) -> DataFrame:
    return curve_metrics(df, 0.0, *by).select(*by, "auroc")


def average_precision(df: DataFrame, *by: str) -> DataFrame:
    return curve_metrics(df, 0.0, *by).select(*by, "ap")


def tpr_at_fpr(df: DataFrame, target: float, *by: str) -> DataFrame:
    return curve_metrics(df, target, *by).select(*by, "tpr")


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:  # A23
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return r6(F.greatest(F.lit(0.0), mid - half)), r6(F.least(F.lit(1.0), mid + half))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:  # A16
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = let(F.col("prob"), lambda p: F.size(F.filter(edges, lambda e: p >= e)))
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("p"), F.avg(F.col("label").cast("double")).alias("y"))
    return per.agg(r6(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:  # W02
    per = running(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")), col, {"_upto": "_c"})
    return df.join(per.select(F.col(col), (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out)), col)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:  # A29
    ranked = average_ranks(average_ranks(df, a, "_ra"), b, "_rb")
    return ranked.agg(r6(F.corr("_ra", "_rb")).alias("rho"))


def gated(candidates: DataFrame, gates: dict[str, Column]) -> DataFrame:  # M19, F18
    """``candidates`` (one row each) with a column a gate, null where what it asks about is missing; how many are missing;
    whether all known ones pass (none known: no)."""
    out = candidates.select("*", *[g.alias(name) for name, g in gates.items()])
    known = F.array_compact(F.array(*gates))
    return out.withColumn("missing", (F.lit(len(gates)) - F.size(known)).cast("long")).withColumn("passes", (F.size(known) > 0) & F.forall(known, lambda g: g))


def mixtures(df: DataFrame, a: str, b: str, shares: list[float]) -> DataFrame:
    """Rows once a share: ``share`` and ``prob``, the first score by one less the share and the second by the share."""
    each = F.array(*[F.struct(F.lit(x).alias("share"), (F.lit(1 - x) * F.col(a) + F.lit(x) * F.col(b)).alias("prob")) for x in shares])
    return df.select(*[c for c in df.columns if c not in (a, b)], F.inline(each))


def best_of(df: DataFrame, *order: Column) -> Column:
    """Whether a row of a table of few rows comes first in an order among those that pass."""
    from pyspark.sql import Window

    return F.col("passes") & (F.row_number().over(Window.orderBy(F.col("passes").desc(), *order)) == 1)
