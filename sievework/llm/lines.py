"""Line de-duplication by site-relative frequency (DataFrame functions only).

Per host, the pages that hold a line are divided by the pages of the host; lines above a boilerplate ratio go. Lines
travel as 64-bit hashes. As the ratios of a host's lines sum to its mean number of different lines a page, at most
(mean lines a page / ratio) of them can exceed the ratio: the set kept per host is bounded by that. Counts are
pre-aggregated before the shuffle, so a line on every page of a hot host costs a row per task.

Defined results: a null URL counts as the empty host; a null text has no lines; hosts with fewer than ``min_pages``
pages lose nothing; repeated rows count as pages; an empty table gives an empty result; other columns are ignored. A very
long page costs time and memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, let, maybe_broadcast
from .url_filter import split_url

_BLOCK = r"(?i)<(?:br|/?(?:p|div|li|ul|ol|nav|article|header|footer|section|h[1-6]|tr|td|th|table|title|head|body|html|aside|main|blockquote|pre))\b[^>]*>"


def html_lines(html: Column) -> Column:
    """Visible lines of a web page: scripts, styles and comments go (one that is not closed ends with the page), block
    elements and line feeds break lines. Linear in the page's length, whatever it holds."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)", " ")
    return text_lines(let(t, lambda t: let(F.struct(t.alias("all"), F.substring_index(t, ">", -1).alias("tail")), _untagged)))


def _untagged(x: Column) -> Column:
    """Without a > after it nothing is a tag, and looking for one from every < would take quadratic time: what follows
    the last > stays as it is."""
    tagged = F.left(x["all"], F.length(x["all"]) - F.length(x["tail"]))
    return F.concat(F.regexp_replace(F.regexp_replace(tagged, _BLOCK, "\n"), r"<[^>]*>", ""), x["tail"])


def text_lines(text: Column) -> Column:
    each = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.array_remove(each, "")


def boilerplate(rows: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, drop): hashes of the lines on more than ``ratio`` of the host's pages. ``rows``: host, hashes."""
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    held = rows.select("host", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    over = held.join(maybe_broadcast(totals, 200_000), "host").where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_set("h").alias("drop"))


def dedup_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", html: bool = True, ratio: float = 0.3, min_pages: int = 5) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, kept_text (lines joined by line feeds)."""
    host, _ = split_url(F.col(url_col))
    lines = html_lines(F.col(text_col)) if html else text_lines(F.col(text_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), lines.alias("lines"))
    rows = durable(rows.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))), "lines")
    drop = maybe_broadcast(boilerplate(rows.select("host", "hashes"), ratio, min_pages), 20_000)
    none = F.array().cast("array<bigint>")
    joined = rows.join(drop, "host", "left").withColumn("drop", F.coalesce("drop", none))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("drop", F.get(F.col("hashes"), i)))
    out = joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
