"""Lines of text files in file order, without sorting a line: numbers from block counts.

Spark reads a file in blocks, each by one task, and tells for every row its file and the block's first byte. One light
pass counts the lines of each block; sums over blocks in the order of files and bytes give where a block's lines begin. In
the pass that uses the lines a row's number is that beginning plus its place within the block, which Spark's running row ids
tell. A million blocks (100 TB in blocks of 128 MB) make a million rows to sum, never more.

Both passes must cut the files alike. Spark does while the session's settings and the files stay; if a line falls into
a block that was not counted, or outside it, the query fails rather than misnumber.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable

#: Blocks whose beginnings are broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST = 200_000


@dataclass
class Lines:
    """``rows``: file, line (from 1, within the file), number (from 0, over all files), value. ``count``: all lines."""

    rows: DataFrame
    count: int


def _name(path: str) -> str:
    return unquote(urlparse(path).path)


def lines(spark: SparkSession, paths: str | list[str]) -> Lines:
    """All lines of text files. Files come in the order of ``paths``; those that one path (a folder or a glob) stands for
    by name. Names are those that Spark reports; a path given twice is read once."""
    given = [paths] if isinstance(paths, str) else list(paths)
    scan = spark.read.text(given).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")
    blocks = scan.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    found = blocks.collect()  # a row a block, as the driver's own list of what to read
    place = {f: k for k, f in enumerate(_in_order(spark, given, sorted({r["_path"] for r in found})))}
    table, number, line = [], 0, {}
    for r in sorted(found, key=lambda r: (place[r["_path"]], r["_start"])):
        at = line.get(r["_path"], 0)
        table.append((r["_path"], r["_start"], r["first"], r["n"], number, at))
        number, line[r["_path"]] = number + r["n"], at + r["n"]
    starts = spark.createDataFrame(table, "_path string, _start bigint, _first bigint, _n bigint, _number bigint, _line bigint")
    joined = scan.join(F.broadcast(starts) if len(table) <= BROADCAST else starts, ["_path", "_start"], "left")
    inside = F.col("_id") - F.col("_first")
    sure = F.when(inside.between(0, F.col("_n") - 1), inside).otherwise(F.raise_error(F.concat(F.lit("a block was not cut as it was counted: "), "_path")).cast("bigint"))
    rows = joined.withColumn("_in", sure).select(F.col("_path").alias("file"), (F.col("_line") + F.col("_in") + 1).alias("line"), (F.col("_number") + F.col("_in")).alias("number"), "value")
    return Lines(rows, number)


def _in_order(spark: SparkSession, given: list[str], files: list[str]) -> list[str]:
    """Files by the first given path that leads to them, then by name."""
    left, out = set(files), []
    for path in given:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        roots = [_name(s.getPath().toString()) for s in fs.globStatus(at) or []]
        mine = sorted(f for f in left if any(_name(f) == r or _name(f).startswith(r.rstrip("/") + "/") for r in roots))
        out += mine
        left -= set(mine)
    return out + sorted(left)


@dataclass
class Parsed:
    """``rows``: file, line, number and the fields; ``bad``: file, line, value of what is no record."""

    rows: DataFrame
    bad: DataFrame


def jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> Parsed:  # S01, S03
    """JSON lines in file order, one file after the other. Blank lines are skipped (they count as lines); a line that is
    no JSON object of the schema is set aside with its file and line."""
    typed = T._parse_datatype_string(schema)
    read = lines(spark, paths).rows.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    parsed = read.withColumn("_r", F.from_json("value", T.StructType([*typed.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("_r").isNotNull() & F.col("_r._bad").isNull()
    return Parsed(parsed.where(good).select("file", "line", "number", *[F.col(f"_r.`{f.name}`").alias(f.name) for f in typed.fields]), parsed.where(~good).select("file", "line", "value"))


def zipped(left: Lines, right: Lines) -> DataFrame:  # J07
    """(number, left, right): the i-th line of one beside the i-th of the other. Lists of different length are refused."""
    if left.count != right.count:
        raise ValueError(f"{left.count} lines against {right.count}")
    a, b = (x.rows.select("number", F.col("value").alias(side)) for x, side in ((left, "left"), (right, "right")))
    return a.join(b, "number")


def first_lines(read: DataFrame, key: str | list[str]) -> DataFrame:  # W07
    """Of rows with a ``number`` the first of each key in file order: an aggregate with a map-side combine, so a key that
    is everywhere costs a row a task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in read.columns if c not in keys]
    return read.groupBy(*keys).agg(F.min_by(F.struct(*rest), "number").alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in read.columns])


def numbered(df: DataFrame, order: list, by: str = "number") -> DataFrame:
    """Numbers from 0 in an order given by columns, for tables that have no lines: a range sort, then numbers within its
    partitions on top of the sizes of the partitions before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    held = durable(ranged, "numbered")
    sizes = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("_p", "_first", before.alias("_before"))), "_p").withColumn(by, F.col("_before") + F.col("_id") - F.col("_first")).select(*df.columns, by)
