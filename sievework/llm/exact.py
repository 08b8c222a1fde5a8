"""Exact de-duplication by a tree-merge of sorted digest runs (DataFrame functions only).

Texts are equal if they are identical without their ASCII white space. One narrow pass leaves a row of digests for each
document; the texts are never shuffled. Each input partition is a leaf of the tree. In a round, ``fanout`` neighbouring
runs merge into one: every task sorts its rows by digest and folds equal ones before they move (its run), runs of one
parent meet in the exchange, range after range of digests, and are merged again. After log(leaves) rounds a single run,
spread over many tasks by digest, holds each different text once.

A run is ordered by a 64-bit digest. Rows with one digest merge only if they are verified: SHA-256 and the length of the
text without white space must agree as well. At every level an entry holds the row that stays so far: the one with the
most code points in the original text, then the smallest doc_id, then the first row read.

Every task folds a hot text before each exchange, so it costs a row per task and round. Coming back to the documents,
rows of texts held more than once meet their entry; hot ones are spread over many tasks (see `salt_hot`).

Defined results: a null text counts as empty, and empty texts (or white space only) are one group like any other; a null
doc_id comes after all others; of rows equal in doc_id and text the first read stays, so one row of a group stays
whatever repeats; doc_id may be of any type that can be ordered; an empty table gives an empty result; other columns are
ignored. A very long text costs time in proportion to its length, and its digests are no larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, durable, durable_path, maybe_broadcast, salt_hot

BLANKS = " \t\n\x0b\x0c\r"
SAME = ["digest", "sha", "size"]


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """doc_id, digests of the text without white space, code points of the text, the row's number and its leaf."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(bare).alias("digest"), F.unhex(F.sha2(bare, 256)).alias("sha"), F.length(bare).alias("size"),
        F.length(text).alias("chars"), row.alias("row"), F.spark_partition_id().alias("leaf"),
    )


def merge_runs(runs: DataFrame, fanout: int) -> DataFrame:
    """One round: runs ``fanout * k`` up to ``fanout * (k + 1) - 1`` become run ``k``. The minimum of a struct makes Spark
    aggregate by sorting on both sides of the exchange: sorted runs go in and come out."""
    parent = F.floor(F.col("run") / F.lit(fanout)).cast("int").alias("run")
    return runs.groupBy(parent, *SAME).agg(F.min("best").alias("best"), F.sum("copies").alias("copies")).sortWithinPartitions("run", *SAME)


def merge_tree(rows: DataFrame, fanout: int = 16) -> DataFrame:
    """The root run: each text once, with the row that stays (best) and the number of its copies. ``rows``: durable."""
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row").alias("best")
    runs = rows.select(F.col("leaf").alias("run"), *SAME, best, F.lit(1).cast("long").alias("copies"))
    left, last = (rows.agg(F.max("leaf").alias("m")).first()["m"] or 0) + 1, None
    while True:
        left, path = -(-left // fanout), durable_path(rows.sparkSession, "exact-runs")
        runs = durable(merge_runs(runs, fanout), path=path)
        if last:
            discard(rows.sparkSession, last)
        last = path
        if left <= 1:
            return runs


def _decided(rows: DataFrame, fanout: int) -> DataFrame:
    """``rows`` with keep_id, keep_row and copies; the last two null for texts that occur once."""
    groups = merge_tree(rows, fanout).where("copies > 1").select(*SAME, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("copies").alias("_n"))
    groups = durable(groups, "exact-groups")
    tagged, spread = salt_hot(rows, groups, SAME, F.col("row"))
    return tagged.join(spread(groups), [*SAME, "_salt"], "left").withColumnRenamed("_n", "copies")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fanout: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = durable(digests(docs, id_col, text_col), "exact-digests")
    own = F.col("keep_row").isNull()
    return _decided(rows, fanout).select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fanout: int = 16) -> DataFrame:
    """The row of each group that stays; the columns of ``docs`` unchanged. The rows are numbered once, in a table, so
    that the number means the same row in both passes."""
    numbered = durable(docs.withColumn("_exact_row", F.monotonically_increasing_id()), "exact-docs")
    rows = durable(digests(numbered, id_col, text_col, F.col("_exact_row")), "exact-digests")
    gone = durable(_decided(rows, fanout).where("row <> keep_row").select(F.col("row").alias("_exact_row")), "exact-gone")
    return numbered.join(maybe_broadcast(gone, 1_000_000), "_exact_row", "left_anti").select(*docs.columns)
