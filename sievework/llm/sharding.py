"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two shuffles each bucket in
memory (Fisher-Yates, seeded by the bucket) and writes it. The buckets one after the other are a uniform random order
of all rows; shards are consecutive runs of it, so their row counts differ by one at most (law ``rows``) and their
slots have no gaps. Whole records move once, through one exchange of as many partitions as buckets; a task holds one
bucket, whatever the session's number of shuffle partitions. At very large sizes raise ``bucket_bytes`` to what a task's
memory holds, so that the buckets don't become too many.

Defined results: null and empty texts have size 16; a null doc_id hashes like any value; rows equal in doc_id and text
lie in one bucket; an empty table gives an empty result; all columns stay, whatever their names, except ``shard`` and
``slot``, which are replaced. A very long text makes its bucket larger by its own size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, maybe_broadcast

BUCKET_BYTES = 32 << 20
BATCH_ROWS = 512


def record_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 16


def _shuffle_buckets(seed: int):
    """Rows arrive by bucket. A bucket is gathered, permuted and sent on in small batches with its places."""

    def emit(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        order = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # Fisher-Yates
        for lo in range(0, len(order), BATCH_ROWS):
            rows = table.take(pa.array(order[lo : lo + BATCH_ROWS])).combine_chunks()
            columns = [rows.column(k).combine_chunks() for k in range(rows.num_columns)]
            place = pa.array(np.arange(lo, lo + rows.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], place], [*table.column_names, "_place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = batch.column("_bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if current is not None and ids[lo] != current:
                    yield from emit(held, current)
                    held = []
                current = int(ids[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from emit(held, current)

    return run


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot``. Memory of a task: about ``bucket_bytes`` and a
    permuted batch. The buckets' row counts, one number each, place every bucket in the global order."""
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.sum(record_size(F.col(text_col))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n_buckets = max(n_shards, math.ceil((total["b"] or 0) / bucket_bytes))
    # the number of buckets depends on the data, so a bucket is a hash taken modulo it
    digest = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))
    keyed = docs.withColumn("_bucket", F.pmod(digest, F.lit(n_buckets)).cast("int")).withColumn("_order", F.xxhash64(F.lit(seed + 1), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col)))
    sizes = durable(keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")), "shard-sizes")
    first = _offsets(sizes, n_buckets)
    rows = keyed.repartitionById(n_buckets, F.col("_bucket")).sortWithinPartitions("_bucket", "_order").drop("_order")
    schema = T.StructType([*rows.schema.fields, T.StructField("_place", T.LongType())])
    placed = rows.mapInArrow(_shuffle_buckets(seed), schema).join(maybe_broadcast(first, 500_000), "_bucket")
    n = F.lit(int(total["n"]))
    at = F.col("_first") + F.col("_place")
    # shard s holds the places from floor(s * n / n_shards) on
    s = F.floor(((at + 1) * n_shards - 1) / F.greatest(n, F.lit(1))).cast("long")
    begins = lambda x: F.expr(f"({x} * {int(total['n'])}) div {n_shards}")
    out = placed.withColumn("_at", at).withColumn("_s", s)
    out = out.withColumn("_s", F.when(begins("_s") > F.col("_at"), F.col("_s") - 1).when(begins("(_s + 1)") <= F.col("_at"), F.col("_s") + 1).otherwise(F.col("_s")))
    return out.select(*docs.columns, F.col("_s").cast("int").alias("shard"), (F.col("_at") - begins("_s")).alias("slot"))


def _offsets(sizes: DataFrame, n_buckets: int, block: int = 4096) -> DataFrame:
    """(_bucket, _first): rows in all earlier buckets, by running sums in blocks and over blocks."""
    from pyspark.sql import Window

    sizes = sizes.withColumn("_block", F.floor(F.col("_bucket") / block))
    blocks = sizes.groupBy("_block").agg(F.sum("_rows").alias("_n"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    within = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("_in", F.coalesce(F.sum("_rows").over(within), F.lit(0))).join(F.broadcast(blocks) if n_buckets <= block * 10_000 else blocks, "_block")
    return out.select("_bucket", (F.col("_before") + F.col("_in")).cast("long").alias("_first"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards as Parquet, one folder each; rows of a file are in slot order. A bucket spans few shards,
    so a task writes few files."""
    shard(docs, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
