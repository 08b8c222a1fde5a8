"""Queries A27, M01, M03, M06-M08, M10, M11, M13, M16, W14: fitted models and what is measured on their held-out scores, resampled
metrics, contrastive loss, batches of whole groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, calibration, contrast, metrics, ml, model, probes, resampled, scoring, splits
from ..session import durable
from ._base import HASH32, Plan, scored, table

query = Plan()


@query()
def a27_bootstrap_metrics(spark, d):
    """Seven metrics of two scores and of their difference, with intervals from 1,000 paired resamples."""
    out = resampled.intervals(scored(spark, d), "item_id", "label", ["prob", "prob_b"])
    return out.select("score", "metric", *[F.round(c, 6).alias(c) for c in ("point", "low", "high", "p_not_above")], "n_valid")


NEXT_FIT = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN conv_id::VARCHAR END AS g, conv_id * 1000 + turn AS key FROM conversations),
o AS (SELECT g, n, row_number() OVER (ORDER BY {HASH32.format("g")}, g) AS i FROM (SELECT g, count(*) AS n FROM t WHERE g IS NOT NULL GROUP BY g HAVING count(*) <= 32)),
walk(i, g, batch, level) AS (
  SELECT i, g, 0::BIGINT, n FROM o WHERE i = 1
  UNION ALL
  SELECT o.i, o.g, CASE WHEN w.level + o.n > 32 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.level + o.n > 32 THEN o.n ELSE w.level + o.n END FROM walk w JOIN o ON o.i = w.i + 1),
fill AS (SELECT batch, max(level) AS level FROM walk GROUP BY batch),
shut AS (SELECT batch, 32 - level AS room, sum(32 - level) OVER (ORDER BY batch) - (32 - level) AS before FROM fill WHERE batch < (SELECT max(batch) FROM fill)),
open AS (SELECT coalesce(max(batch), 0) AS batch, coalesce(arg_max(level, batch), 0) AS level, (SELECT coalesce(sum(room), 0) FROM shut) AS before FROM fill),
alone AS (SELECT conv_id, turn, row_number() OVER (ORDER BY {HASH32.format("key")}, key) - 1 AS k FROM t WHERE g IS NULL)
SELECT conv_id, turn, batch FROM t LEFT JOIN walk USING (g) WHERE g IS NOT NULL
UNION ALL
SELECT conv_id, turn, coalesce(shut.batch, open.batch + floor((k - open.before + open.level) / 32))::BIGINT
FROM alone CROSS JOIN open LEFT JOIN shut ON k >= shut.before AND k < shut.before + shut.room
"""


@query(NEXT_FIT)
def w14_group_batches(spark, d):
    """Conversations packed whole into batches of at most 32 turns; system turns stand alone and fill the gaps."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("key"))
    return batches.pack(t, F.when(F.col("role") != "system", F.col("conv_id")), "key", 32).select("conv_id", "turn", "batch")


@query("""
WITH e AS (SELECT vec_id, label, vec_id % 20 AS g, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 > 0),
p AS (SELECT a.vec_id, a.g, a.label = b.label AS near, exp(list_cosine_similarity(a.v, b.v) / 0.1::DOUBLE - 10) AS x FROM e a JOIN e b ON a.g = b.g AND a.vec_id <> b.vec_id),
l AS (SELECT vec_id, g, ln(sum(x)) - ln(sum(x) FILTER (near)) AS loss FROM p GROUP BY vec_id, g HAVING bool_or(near))
SELECT g::VARCHAR AS "group", count(*) AS anchors, round(avg(loss), 6) AS loss FROM l GROUP BY g
""")
def m06_contrastive_loss(spark, d):
    """NT-Xent of whole vectors in twenty groups, of which the first stands for rows of no group."""
    g = F.when(F.col("vec_id") % 20 > 0, F.col("vec_id") % 20)
    return contrast.group_losses(table(spark, d, "embeddings"), "vec_id", "embedding", g, "label").withColumn("loss", F.round("loss", 6))


def model_scores(spark, d):
    """Documents outside the training split with the probability of a model fitted on that split."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return durable(model.held_out(t, "doc_id", "text", "label").select(F.col("doc_id").alias("item_id"), "source", "lang", "label", "prob"), "held-out")


@query()
def m03_model_scores(spark, d):
    """Held-out probabilities of the fitted model."""
    return model_scores(spark, d)


@query()
def m03_model_all_scores(spark, d):
    """The model, fitted on the training split of the labelled documents, over all documents."""
    t = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    fitted = model.Model.of(model.fit(t.where(model.train_part(F.col("doc_id"))), "text", "label"))
    p = fitted.probability(F.col("text"))
    return table(spark, d, "documents").select("doc_id", p.alias("prob"), (p >= 0.5).cast("int").alias("label"))


@query()
def a05_model_metrics(spark, d):
    """The metric block of the model on held-out documents, overall and by language."""
    s = model_scores(spark, d)
    every = s.withColumn("lang", F.lit("all")).unionByName(s)
    counts = metrics.derived(metrics.confusion(every, "lang"))
    return counts.join(metrics.curve_metrics(every, 0.01, "lang"), "lang").select("lang", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr", "auroc", "ap", F.col("tpr").alias("tpr_at_1pct"))


@query()
def a27_model_intervals(spark, d):
    """Seven metrics of the model on held-out documents with intervals."""
    out = resampled.intervals(model_scores(spark, d), "item_id", "label", ["prob"])
    return out.select("score", "metric", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")], "n_valid")


@query()
def w01_model_curve(spark, d):
    """True and false positives of the model down its held-out scores."""
    return metrics.curve(model_scores(spark, d)).select("prob", "tp", "fp", "pos", "neg")


@query()
def m11_temperature(spark, d):
    """The model's temperature, fitted on one half of its held-out scores, and loss, Brier and ECE of the other half."""
    out = calibration.calibration_report(model_scores(spark, d), "item_id", "prob", "label")
    return out.select("score", "n", *[F.round(c, 6).alias(c) for c in ("temperature", "nll", "brier", "ece")])


@query()
def m13_conformal_bound(spark, d):
    """Thresholds whose false-alarm rate is bounded by calibration on half of the clean held-out documents, and what the
    other half and the toxic ones show."""
    out = calibration.conformal(model_scores(spark, d), "item_id", [0.05, 0.1, 0.15, 0.2, 0.4])
    return out.select("alpha", "n_calibration", "n_test", *[F.round(c, 6).alias(c) for c in ("tau", "bound", "test_rate", "recall")])


@query()
def m10_ensemble_gate(spark, d):
    """The word scorer, the fitted model and their weighted ensemble on held-out documents, for eleven weights: errors, how
    far the two complement each other, and whether the ensemble is no worse than the better one."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), scoring.score(F.col("text")).alias("a"))
    s = t.join(model_scores(spark, d).select("item_id", "label", F.col("prob").alias("b")), "item_id")
    wrong = lambda p: (p >= 0.5).cast("int") != F.col("label")
    n = lambda c: F.count(F.when(c, 1))
    each = s.select(wrong(F.col("a")).alias("wa"), wrong(F.col("b")).alias("wb"), F.inline(F.array(*[F.struct(F.lit(k / 10).alias("weight"), wrong(F.lit(k / 10) * F.col("a") + F.lit(1 - k / 10) * F.col("b")).alias("we")) for k in range(11)])))
    c = each.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), n(F.col("wa")).alias("errors_a"), n(F.col("wb")).alias("errors_b"), n(F.col("we")).alias("errors_ensemble"), n(F.col("wa") & F.col("wb")).alias("both"), n(F.col("wa") != F.col("wb")).alias("one"))
    return c.select("weight", "n", "errors_a", "errors_b", "errors_ensemble", "both", F.round(metrics.ratio(F.col("one"), F.col("one") + F.col("both")), 6).alias("complementarity"), (F.col("errors_ensemble") <= F.least("errors_a", "errors_b")).alias("gate"))


def choices_of(scores):
    """Questions of four choices out of scored items: within a language the k-th positive by hash with the three negatives
    from the 3 k-th on. Rows: lang, question, label, prob."""
    order = splits.ranked(scores, "item_id", "lang", "label")
    place = F.col("_rn") - 1
    question = F.when(F.col("label") == 1, place).otherwise(F.floor(place / 3)).cast("long")
    rows = order.select("lang", question.alias("question"), "label", "prob")
    whole = rows.groupBy("lang", "question").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).where("n = 4 AND y = 1")
    return rows.join(whole.select("lang", "question"), ["lang", "question"], "left_semi")


@query()
def m16_mcq_deltas(spark, d):
    """Multiple choice on held-out documents: by language how often the right choice is flagged at two thresholds and scored
    highest, average precision over all choices, and the differences to the home language."""
    rows = choices_of(model_scores(spark, d))
    right = F.max(F.when(F.col("label") == 1, F.col("prob")))
    per = rows.groupBy("lang", "question").agg(right.alias("right"), F.max(F.when(F.col("label") == 0, F.col("prob"))).alias("rival"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    hits = per.groupBy("lang").agg(F.count(F.lit(1)).alias("questions"), share(F.col("right") >= 0.5).alias("hit"), share(F.col("right") >= 0.65).alias("hit_strict"), share(F.col("right") > F.col("rival")).alias("top"))
    out = hits.join(metrics.average_precision(rows, "lang"), "lang")
    home = out.where("lang = 'en'").select(*[F.col(c).alias(f"home_{c}") for c in ("hit", "top", "ap")])
    return out.join(F.broadcast(home), how="left").select("lang", "questions", "hit", "hit_strict", "top", "ap", *[F.round(F.col(c) - F.col(f"home_{c}"), 6).alias(f"{c}_delta") for c in ("hit", "top", "ap")])


@query()
def m01_bow_auroc(spark, d):
    """How well a bag of words tells toxic documents out of fold, and how many it tells with confidence."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    return ml.predictability(t, "doc_id", "text", "label")


def embedded(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"), (F.col("label") % 2).cast("int").alias("concept"))


@query()
def m07_concept_rounds(spark, d):
    """Directions of a concept that leave the task's alone: what a linear fit still explains of either, round by round."""
    m = probes.centred(probes.moments(embedded(spark, d), "embedding", ["concept", "y"], 64), 64)
    found = probes.deflate(*m)
    return spark.createDataFrame([(k, round(c, 6), round(t, 6)) for k, (c, t) in enumerate(zip(found.concept, found.task))], "round int, concept double, task double")


@query()
def m07_concept_projector(spark, d):
    """Embeddings without these directions: the longest part left along any of them, which is none."""
    e = embedded(spark, d)
    found = probes.deflate(*probes.centred(probes.moments(e, "embedding", ["concept", "y"], 64), 64))
    p = probes.project(e, "embedding", found.directions, "projected")
    along = [F.abs(F.aggregate(F.zip_with("projected", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)) for w in found.directions]
    return p.select("vec_id", F.round(F.array_max(F.array(F.lit(0.0), *along)), 6).alias("along"))


@query()
def m08_linear_probe(spark, d):
    """Ten penalties over five folds: mean step-wise average precision, and which one is chosen."""
    found = probes.grid_search(embedded(spark, d), "vec_id", "embedding", "y")
    return spark.createDataFrame([(round(c, 6), round(v, 6), c == found.best) for c, v in found.table], "c double, mean_ap double, chosen boolean")


@query()
def m08_held_out_probe(spark, d):
    """A probe fitted on 70 % of each class, and its scores of the rest."""
    return probes.held_out_probe(embedded(spark, d), "vec_id", "embedding", "y", 1.0).withColumn("prob", F.round("prob", 6))


QUERIES, SQL = query.queries, query.sql
