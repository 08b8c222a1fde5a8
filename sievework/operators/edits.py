"""Random character edits of texts, for measuring what a scorer or a normaliser withstands (P02).

Places are drawn by a digest of the row's key and the place, so reruns agree; as many are drawn as the rate says, namely those
with the smallest numbers among the characters that an edit can change. All edits of a text come from one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HOMOGLYPHS, LOWER, UPPER, let

#: What becomes of letters: look-alikes, digits. Either case gives the same.
LOOKALIKE = (HOMOGLYPHS[1] + HOMOGLYPHS[1].upper(), HOMOGLYPHS[0] * 2)
DIGIT = ("aeiostAEIOST", "431057" * 2)
# Characters of no width that are put between others.
MARKS = "\u200b\u200c\u200d\ufeff"


def characters(t: Column) -> Column:
    """The code points of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("(?s)."), F.lit(0))


def _bound(numbers: Column, k: Column) -> Column:
    """The k-th smallest of the numbers, or the largest where there are fewer; nulls are none of them."""
    return let(F.sort_array(F.filter(numbers, lambda v: v.isNotNull())), lambda v: F.get(v, F.least(k, F.size(v)) - 1))


def _at_least_one(n: Column, rate: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(rate)).cast("int"))


def random_edits(df: DataFrame, text: str, key: Column, lookalikes: float = 0.15, digits: float = 0.3, typos: float = 0.05, marks: int = 5) -> DataFrame:
    """``df`` with ``edits``: array of (edit, changed). ``lookalike``: letters of that share of the text are replaced; ``digit``: that
    share of the letters that have one; ``typo``: characters of that share are left out or swapped with the next; ``case``: each
    ASCII letter gets either case; ``mark``: so many characters are followed by one of no width. ``key``: string, one a row."""
    rows = df.withColumn("_c", characters(F.col(text))).withColumn("_n", F.size("_c"))
    places = F.slice(F.sequence(F.lit(0), F.col("_n")), F.lit(1), F.col("_n"))
    rows = rows.withColumn("_d", F.transform(places, lambda i: F.md5(F.concat(key, F.lit(":"), i.cast("string")))))
    number = lambda part: F.transform("_d", lambda v: F.conv(F.substring(v, 1 + 8 * part, 8), 16, 10).cast("long"))
    rows = rows.select(*df.columns, "_c", "_n", *[number(p).alias(f"_h{p}") for p in range(4)])
    open_to = lambda pair, h: F.zip_with("_c", h, lambda c, v: F.when(F.translate(c, *pair) != c, v))
    can_digit = open_to(DIGIT, "_h1")
    rows = rows.select(
        "*", _bound(open_to(LOOKALIKE, "_h0"), _at_least_one(F.col("_n"), lookalikes)).alias("_b0"),
        let(can_digit, lambda v: _bound(v, _at_least_one(F.size(F.filter(v, lambda x: x.isNotNull())), digits))).alias("_b1"),
        _bound(F.col("_h2"), _at_least_one(F.col("_n"), typos)).alias("_b2"), _bound(F.col("_h3"), F.lit(marks)).alias("_b3"),
    )
    mark = lambda v: F.substring(F.lit(MARKS), (v % len(MARKS) + 1).cast("int"), F.lit(1))

    def changed(r: Column) -> Column:
        def typo(c: Column, i: Column) -> Column:
            own, after, before = (F.get(r["_h2"], i + k) for k in (0, 1, -1))
            swapped = (own % 2 == 1) & (after > r["_b2"])  # one that is drawn itself does not move
            moved = (before <= r["_b2"]) & (before % 2 == 1)
            return F.when(own <= r["_b2"], F.when(swapped, F.concat(F.get(r["_c"], i + 1), c)).otherwise("")).when(moved, "").otherwise(c)

        each = {
            "lookalike": F.zip_with(r["_c"], r["_h0"], lambda c, v: F.when(v <= r["_b0"], F.translate(c, *LOOKALIKE)).otherwise(c)),
            "digit": F.zip_with(r["_c"], r["_h1"], lambda c, v: F.when(v <= r["_b1"], F.translate(c, *DIGIT)).otherwise(c)),
            "typo": F.transform(r["_c"], typo),
            "case": F.zip_with(r["_c"], r["_h3"], lambda c, v: F.when(v % 2 == 1, F.translate(c, LOWER, UPPER)).otherwise(F.translate(c, UPPER, LOWER))),
            "mark": F.zip_with(r["_c"], r["_h3"], lambda c, v: F.when(v <= r["_b3"], F.concat(c, mark(v))).otherwise(c)),
        }
        return F.array(*[F.struct(F.lit(k).alias("edit"), F.array_join(v, "").alias("changed")) for k, v in each.items()])

    # in one struct, computed once: the optimiser would put the bounds into the lambdas
    once = F.struct("_c", *[f"_h{k}" for k in range(4)], *[f"_b{k}" for k in range(4)])
    return rows.select(*df.columns, let(once, changed).alias("edits"))
