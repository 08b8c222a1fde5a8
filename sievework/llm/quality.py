"""Quality rules as weak supervision (DataFrame functions only).

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the table of vote patterns, at most
three to the power of the number of rules rows, estimates how each rule votes on good and on bad documents; the
posterior probability of quality replaces all-must-pass filtering.

Texts never leave the task that reads them. The EM works on counts of vote patterns of all documents; a round is
one small aggregate whose single row of sums comes to the driver.

Defined results: a null text is an empty one (no words, so it fails the base rule); a null doc_id stays null; equal
rows get equal results; an empty table gives an empty result; ties of the posterior (0.5) are kept. Columns of any names may
come along; only ``_f``, ``_quality`` and ``_kept`` are replaced by `judge`. A very long text costs time and memory in proportion to
its words, in the task that reads it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, durable, let

WINDOW = 8
VOTES = (-1, 0, 1)


def repeat_words(ws: Column) -> Column:
    """Words that lie in an eight-word window found twice or more in the text, the first find included."""
    n = WINDOW

    def pairwise(h: Column, step: int) -> Column:
        return let(h, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - step), F.slice(x, F.lit(step + 1), F.size(x) - step), lambda a, b: F.xxhash64(a, b)))

    def windows(hashed: Column) -> Column:
        for step in (1, 2, 4):  # hashes of two, four, eight words
            hashed = pairwise(hashed, step)
        return hashed

    def union(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
        marked = F.transform(pairs, lambda p, j: F.when(F.when(j > 0, same(j, j - 1)).otherwise(False) | same(j, j + 1), p["i"]))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i + n - acc["end"])).alias("n"), (i + n).alias("end"))
        return F.aggregate(F.sort_array(F.array_compact(marked)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(F.sort_array(pairs), union))

    counted = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hashed: let(windows(hashed), count))
    return F.when(F.size(ws) > n, counted).otherwise(0).cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_f`` of measurements of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        count("[A-Z]").alias("n_upper"),
        count(r"[#*$%&|<>!]{2,}").alias("n_marks"),
        count(r"[.!?](?=[\x20\x09-\x0D]|$)").alias("n_ends"),
    )
    return docs.withColumn("_t", text).withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("_f", let(measured)).drop("_t", "_w")


def rules(f: str = "_f") -> dict[str, Column]:
    """The votes. Each rule speaks about one symptom; most can only accuse, and abstain otherwise, since signs of
    good writing come together and would outvote a single flaw."""
    c = lambda name: F.col(f"{f}.{name}")
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    vote = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0)
    n = c("n_words")
    return {
        "length": vote(n < 5),
        "symbols": vote(per("n_symbols", "n_words") > 0.1, per("n_symbols", "n_words") < 0.02),
        "marks": vote(per("n_marks", "n_words") > 0.2),
        "word_length": vote((per("word_chars", "n_words") > 14) | (per("word_chars", "n_words") < 2.5)),
        "dup_lines": vote(per("n_dup_lines", "n_lines") > 0.5),
        "repeats": vote(per("n_repeat_words", "n_words") > 0.15),
        "shouting": vote((n >= 5) & (c("n_upper") > 0.35 * c("word_chars"))),
        "vocabulary": vote((n >= 30) & (c("n_distinct") * F.greatest(F.lit(1.0), F.log10(n + 10) - 1) < 0.2 * n)),
        "prose": vote(F.lit(False), per("n_ends", "n_words").between(0.01, 0.35) & (per("n_symbols", "n_words") < 0.05) & (c("n_upper") < 0.2 * c("word_chars")) & (per("n_dup_lines", "n_lines") < 0.1)),
    }


def _initial(n_rules: int) -> dict:
    """Beliefs before any data: most documents are good; a rule that accuses does so mostly on bad ones."""
    return {"prior": 0.8, "rules": [{1: {-1: 0.02, 0: 0.38, 1: 0.6}, 0: {-1: 0.35, 0: 0.4, 1: 0.25}}] * n_rules}


def posterior(votes: Column, model: dict) -> Column:
    """P(good | votes) for an array of votes in the order of the rules. The coefficients are one array literal, so
    that Spark compiles the same code for every round."""
    coefficients = [math.log(model["prior"] / (1 - model["prior"]))] + [math.log(r[1][x] / r[0][x]) for r in model["rules"] for x in VOTES]
    table = F.array(*[F.lit(float(x)) for x in coefficients])
    each = F.transform(votes, lambda v, k: F.get(table, v + k * 3 + 2))
    return 1 / (1 + F.exp(-F.aggregate(each, F.get(table, F.lit(0)), lambda a, x: a + x)))


def fit(patterns: DataFrame, n_rules: int, rounds: int = 12, strength: float = 0.1) -> dict:
    """EM over (v: array of votes, n). ``strength``: weight of the initial beliefs as a share of all documents, so
    that the fit acts alike at every size. An empty table leaves the initial beliefs."""
    start = model = _initial(n_rules)
    for _ in range(rounds):
        rows = patterns.withColumn("_p", posterior(F.col("v"), model)).select(F.col("n").cast("double").alias("n"), "_p", F.posexplode("v").alias("j", "vote"))
        sums = {(r["j"], r["vote"]): (r["good"], r["bad"]) for r in rows.groupBy("j", "vote").agg(F.sum(F.col("n") * F.col("_p")).alias("good"), F.sum(F.col("n") * (1 - F.col("_p"))).alias("bad")).collect()}
        if not sums:
            return start
        good, bad = (sum(x[k] for (j, _), x in sums.items() if j == 0) for k in (0, 1))
        weight = strength * (good + bad)
        new: dict = {"prior": min(0.99, max(0.05, (good + weight * start["prior"]) / (good + bad + weight))), "rules": []}
        for j in range(n_rules):
            learnt = {}
            for y, k in ((1, 0), (0, 1)):
                mass = {v: sums.get((j, v), (0.0, 0.0))[k] + weight * start["rules"][j][y][v] for v in VOTES}
                learnt[y] = {v: max(1e-4, mass[v] / sum(mass.values())) for v in VOTES}
            new["rules"].append(learnt)
        moved = abs(new["prior"] - model["prior"])
        model = new
        if moved < 1e-5:
            break
    return model


def vote_patterns(measured: DataFrame) -> tuple[DataFrame, Column, int]:
    """The counted vote patterns, the array of votes and the number of rules."""
    votes = F.array(*rules().values())
    counted = measured.groupBy(votes.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return durable(counted, "quality-votes"), votes, len(rules())


def base_failed(f: str = "_f") -> Column:
    n = F.col(f"{f}.n_words")
    return (n < 20) | (100 * F.col(f"{f}.n_repeat_words") > 30 * n)


def judge(docs: DataFrame, text_col: str = "text", min_quality: float = 0.5) -> DataFrame:
    """``docs`` with ``_f`` (measurements), ``_quality`` (posterior) and ``_kept``. Columns of ``docs`` of these
    names would be replaced. The measured documents are kept in the shared folder: a filter on the verdict would
    otherwise be pushed below the measurements and copy them into every term of the verdict."""
    measured = durable(features(docs, text_col), "quality-measured")
    patterns, votes, n_rules = vote_patterns(measured)
    model = fit(patterns, n_rules)
    scored = measured.withColumn("_quality", posterior(votes, model))
    return scored.withColumn("_kept", ~base_failed() & (F.col("_quality") >= min_quality))


def filter_quality(docs: DataFrame, text_col: str = "text", min_quality: float = 0.5) -> DataFrame:
    """The documents whose posterior probability of quality is at least ``min_quality``; their columns unchanged."""
    return judge(docs, text_col, min_quality).where("_kept").select(*docs.columns)


def judge_narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_quality: float = 0.5) -> DataFrame:
    """As `judge`, but with the id alone instead of all columns: texts are measured once, and the measurements, a few
    numbers a document, are kept in the shared folder between the fit and the verdicts."""
    measured = durable(features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_f"), "quality-features")
    patterns, votes, n_rules = vote_patterns(measured)
    scored = measured.withColumn("_quality", posterior(votes, fit(patterns, n_rules)))
    return scored.withColumn("_kept", ~base_failed() & (F.col("_quality") >= min_quality))
