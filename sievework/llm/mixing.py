"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / w of a seeded uniform u and its quality weight w; the smallest keys of
a source come first. A source's target is cut into complete epochs of all its documents and a fraction; the fraction
takes documents in key order until their prefix sum reaches the rest of the budget.

A prefix in key order is settled by one number per source: the key at the cut. To find it without sorting a source in
one task, keys fall into bins; sums per bin are added up and only the bin that holds the cut is ordered. No bin, hot
source or copy group gathers in one task, and the documents themselves are not shuffled.

Defined results: null texts have size 0 and are taken 0 words; a null source is a source of its own, last in order; a
null doc_id draws a key like any other value; rows with equal key and doc_id (repeated rows) are taken or left
together; an empty table gives an empty result; columns with clashing names are left alone. A very long text is taken or
left whole, so a source ends within half of its last document of its target; measuring it costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, maybe_broadcast, n_words

BINS = 1024


def uniform(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1] from 48 bits of a digest: the same in every engine and on every rerun."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)


def quality_weight(text: Column) -> Column:
    """1 for prose, falling to about a third where symbols are as frequent as one in ten characters."""
    n = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    symbols = F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>", ""))
    return 1.0 / (1.0 + 20.0 * symbols.cast("double") / n.cast("double"))


def sources_with_targets(rows: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, target). Weights repeat over the sources in code point order, null last. The targets
    share the sum of all sizes by weight; a target above ``max_epochs`` times its source's size stops there and the
    excess is shared again. With sources ordered by capacity / weight, those that stop are a prefix."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("rank") % len(weights) + 1)
    per = per.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w)
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("stops"), F.struct("cap", "rank", "level"))).over(everything)
    final = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("stops") | free.isNull(), F.col("cap")).otherwise(final * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_id): a document belongs to the fraction if its (key, id)
    is at most the cut. The cut is the place whose prefix sum is nearest to the rest of the budget."""
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    binned = rows.withColumn("bin", F.floor((1.0 - F.exp(-F.col("key"))) * BINS))
    by_bin = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("source").orderBy("bin")
    by_bin = by_bin.withColumn("above", F.sum("bin_size").over(run)).withColumn("below", F.col("above") - F.col("bin_size"))
    named = targets.select(F.col("source").alias("_s"), "rest")
    edge = by_bin.join(named, F.col("source").eqNullSafe(F.col("_s"))).where((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("above"))).select("_s", F.col("bin").alias("_b"), "below", "rest")
    inside = binned.join(F.broadcast(edge) if edge.count() <= 100_000 else edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    ordered = Window.partitionBy("source").orderBy("key", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = inside.withColumn("upto", F.col("below") + F.sum("size").over(ordered)).withColumn("off", F.abs(F.col("upto") - F.col("rest")))
    none = edge.select(F.col("_s").alias("source"), F.abs(F.col("below") - F.col("rest")).alias("off"), (-F.log(1.0 - F.col("_b") / BINS)).alias("key"), F.lit("").alias("id"))
    best = place.select("source", "off", "key", "id").unionByName(none).groupBy("source").agg(F.min(F.struct("off", "key", "id")).alias("cut"))
    best = best.select(F.col("source").alias("_s"), F.col("cut.key").alias("cut_key"), F.col("cut.id").alias("cut_id"))
    return targets.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``, how often the mix holds the document."""
    key = -F.log(uniform(F.col(id_col), seed)) / quality_weight(F.col(text_col))
    sized = docs.withColumn("_size", n_words(F.col(text_col))).withColumn("_key", key).withColumn("_id", F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    rows = durable(sized.select(F.col(source_col).alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key"), F.col("_id").alias("id")), "mix-keys")
    targets = durable(sources_with_targets(rows, weights, max_epochs), "mix-targets")
    cuts = durable(_cuts(rows, targets), "mix-cuts")
    cuts = cuts.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "epochs", "cut_key", "cut_id")
    joined = sized.join(maybe_broadcast(cuts, 100_000), F.col(source_col).eqNullSafe(F.col("_s")), "left")
    more = F.coalesce((F.col("_key") < F.col("cut_key")) | (F.col("_key") == F.col("cut_key")) & (F.col("_id") <= F.col("cut_id")), F.lit(False))
    copies = F.least(F.col("epochs") + more.cast("int"), F.lit(max_epochs)).cast("int")
    return joined.withColumn("_copies", copies).select(*docs.columns, "_size", "_source_size", "_target", "_copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **options).where("_copies > 0")
    return taken.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
