"""Queries A*, W*, M*, T02-T05: metrics, curves, intervals, operating points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import stats
from ._base import CELLS, DERIVED, SCORED, Plan, scored, table

query = Plan()
r6 = m.r6
flag_a = lambda: (F.col("prob") >= 0.5).cast("int")
flag_b = lambda: (F.col("prob_b") >= 0.5).cast("int")
count_if = lambda c: F.count(F.when(c, 1))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def a01_count_top(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT lang, source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct_group, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct_total FROM documents GROUP BY lang, source")
def a02_two_level_counts(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_t"))
    return c.crossJoin(F.broadcast(total)).select("lang", "source", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("pct_group"), r6(100.0 * F.col("n") / F.col("_t")).alias("pct_total"))


@query(f"WITH {SCORED} SELECT {CELLS} FROM scored")
def a03_confusion(spark, d):
    return m.confusion(scored(spark, d))


@query(f"WITH {SCORED}, c AS (SELECT {CELLS} FROM scored) SELECT *, {DERIVED} FROM c")
def a04_prf(spark, d):
    return m.derived(m.confusion(scored(spark, d)))


@query(f"WITH {SCORED}, c AS (SELECT source, {CELLS} FROM scored GROUP BY source) SELECT *, {DERIVED} FROM c")
def a07_prf_by_group(spark, d):
    return m.derived(m.confusion(scored(spark, d), "source"))


CURVE = f"""{SCORED}, g AS (SELECT prob, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY prob),
c AS (SELECT prob, p, q, sum(p) OVER (ORDER BY prob DESC) AS tp, sum(q) OVER (ORDER BY prob DESC) AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM g)"""
AUROC = "round(sum(p * ((neg - fp) + 0.5::DOUBLE * q)) / (max(pos) * max(neg)), 6)"
AP = "round(sum(p::DOUBLE / pos * tp / (tp + fp)), 6)"
TPR = "round(coalesce(max(tp::DOUBLE / pos) FILTER (fp::DOUBLE / neg <= 0.01::DOUBLE), 0), 6)"


@query(f"WITH {CURVE}, a AS (SELECT {AUROC} AS auroc, {AP} AS ap, {TPR} AS tpr_at_1pct FROM c), k AS (SELECT {CELLS}, count(*) AS n, sum(label) AS n_positive FROM scored) SELECT k.*, {DERIVED}, auroc, ap, tpr_at_1pct FROM k, a")
def a05_full_metrics(spark, d):
    s = scored(spark, d)
    counts = s.agg(*[c.alias(k) for k, c in m.cells(flag_a()).items()], F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"))
    return m.derived(counts).crossJoin(F.broadcast(m.curve_metrics(s, 0.01).withColumnRenamed("tpr", "tpr_at_1pct")))


@query(f"WITH {SCORED}, c AS (SELECT lang, CASE WHEN min(label) = max(label) THEN CASE WHEN min(label) = 0 THEN 'all_safe' ELSE 'all_unsafe' END ELSE 'mixed' END AS assumption, {CELLS}, round(avg(power(prob - label, 2)), 6) AS brier FROM scored GROUP BY lang) SELECT lang, assumption, brier, CASE WHEN assumption <> 'all_unsafe' THEN round(fp::DOUBLE / nullif(fp + tn, 0), 6) END AS fpr, CASE WHEN assumption <> 'all_safe' THEN round(tp::DOUBLE / nullif(tp + fn, 0), 6) END AS recall FROM c")
def a06_assumption_metrics(spark, d):
    c = scored(spark, d).groupBy("lang").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *[x.alias(k) for k, x in m.cells(flag_a()).items()], r6(F.avg(F.pow(F.col("prob") - F.col("label"), 2))).alias("brier"))
    kind = F.when(F.col("lo") != F.col("hi"), "mixed").when(F.col("lo") == 0, "all_safe").otherwise("all_unsafe")
    c = c.withColumn("assumption", kind)
    return c.select("lang", "assumption", "brier", F.when(kind != "all_unsafe", r6(m.ratio(F.col("fp"), F.col("fp") + F.col("tn")))).alias("fpr"), F.when(kind != "all_safe", r6(m.ratio(F.col("tp"), F.col("tp") + F.col("fn")))).alias("recall"))


@query(f"WITH {SCORED}, c AS (SELECT source, {CELLS} FROM scored GROUP BY source) SELECT source, fp, fn, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr, round(fn::DOUBLE / nullif(tp + fn, 0), 6) AS fnr FROM c ORDER BY fp + fn DESC, source")
def a08_subgroup_errors(spark, d):
    c = m.confusion(scored(spark, d), "source")
    return c.select("source", "fp", "fn", r6(m.ratio(F.col("fp"), F.col("fp") + F.col("tn"))).alias("fpr"), r6(m.ratio(F.col("fn"), F.col("tp") + F.col("fn"))).alias("fnr")).orderBy(F.desc(F.col("fp") + F.col("fn")), "source")


GRID = [i / 100 for i in range(10, 91)]
SWEEP = f"{SCORED}, t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 91) r(i)), c AS (SELECT threshold, count(*) FILTER (label = 1 AND prob >= threshold) AS tp, count(*) FILTER (label = 0 AND prob >= threshold) AS fp, count(*) FILTER (label = 0 AND prob < threshold) AS tn, count(*) FILTER (label = 1 AND prob < threshold) AS fn FROM scored, t GROUP BY threshold)"


@query(f"WITH {SWEEP} SELECT *, {DERIVED}, round((tp + fp)::DOUBLE / (tp + fp + tn + fn), 6) AS flag_rate, round(fn::DOUBLE / nullif(tp + fn, 0), 6) AS fnr FROM c")
def a09_threshold_sweep(spark, d):
    c = m.derived(m.sweep(scored(spark, d), GRID))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return c.select("*", r6((F.col("tp") + F.col("fp")) / n).alias("flag_rate"), r6(m.ratio(F.col("fn"), F.col("tp") + F.col("fn"))).alias("fnr"))


@query(f"WITH {CURVE} SELECT {AUROC} AS auroc FROM c")
def a10_auroc(spark, d):
    return m.auroc(scored(spark, d))


@query(f"WITH {CURVE} SELECT {AP} AS ap FROM c")
def a11_average_precision(spark, d):
    return m.average_precision(scored(spark, d))


@query(f"WITH {CURVE} SELECT {TPR} AS tpr FROM c")
def a12_tpr_at_fpr(spark, d):
    return m.tpr_at_fpr(scored(spark, d), 0.01)


@query(f"WITH {SWEEP}, p AS (SELECT threshold, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p FROM c), s AS (SELECT (r - lag(r) OVER (ORDER BY r, threshold DESC)) * (p + lag(p) OVER (ORDER BY r, threshold DESC)) / 2 AS a, r FROM p) SELECT CASE WHEN max(r) - min(r) < 0.5::DOUBLE THEN NULL ELSE round(sum(a), 6) END AS au_prc FROM s")
def a13_pr_trapezoid(spark, d):
    c = m.sweep(scored(spark, d), GRID)
    z = lambda a, b: F.coalesce(m.ratio(a, b), F.lit(0.0))
    p = c.select("threshold", z(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"), z(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"))
    w = Window.orderBy("r", F.desc("threshold"))
    s = p.select("r", ((F.col("r") - F.lag("r").over(w)) * (F.col("p") + F.lag("p").over(w)) / 2).alias("a"))
    return s.agg(F.when(F.max("r") - F.min("r") >= 0.5, r6(F.sum("a"))).alias("au_prc"))


@query(f"WITH {SCORED}, c AS (SELECT {CELLS} FROM scored), k AS (SELECT (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS po, ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / power(tp + fp + tn + fn, 2) AS pe FROM c) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM k")
def a14_kappa(spark, d):
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = (tp + fp + tn + fn).cast("double")
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return m.confusion(scored(spark, d)).select(r6(m.ratio(po - pe, 1 - pe)).alias("kappa"))


@query(f"WITH {SCORED} SELECT round(avg(power(prob - label, 2)), 6) AS brier FROM scored")
def a15_brier(spark, d):
    return scored(spark, d).agg(r6(F.avg(F.pow(F.col("prob") - F.col("label"), 2))).alias("brier"))


@query(f"WITH {SCORED}, b AS (SELECT len(list_filter([i / 10.0::DOUBLE for i in range(1, 10)], lambda e: prob >= e)) AS bin, count(*) AS n, avg(prob) AS p, avg(label::DOUBLE) AS y FROM scored GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def a16_ece(spark, d):
    return m.ece(scored(spark, d))


@query(f"WITH {SCORED} SELECT label, round(avg(prob), 6) AS mean, round(quantile_cont(prob, 0.05), 6) AS p05, round(quantile_cont(prob, 0.5), 6) AS p50, round(quantile_cont(prob, 0.95), 6) AS p95 FROM scored GROUP BY GROUPING SETS ((), (label))")
def a17_score_distribution(spark, d):
    s, q = scored(spark, d), {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    mean = r6(F.avg("prob")).alias("mean")
    every = m.with_quantiles(s.agg(mean), s, "prob", q).withColumn("label", F.lit(None).cast(s.schema["label"].dataType))
    return m.with_quantiles(s.groupBy("label").agg(mean), s, "prob", q, "label").unionByName(every)


@query(f"WITH {SCORED} SELECT least(floor(prob * 40), 39)::INTEGER AS bin, count(*) AS n FROM scored GROUP BY 1")
def a18_histogram(spark, d):
    return scored(spark, d).groupBy(F.least(F.floor(F.col("prob") * 40), F.lit(39)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


WILSON = "greatest(0, (k / n + 3.841458881296::DOUBLE / (2 * n)) / (1 + 3.841458881296::DOUBLE / n) - 1.959964::DOUBLE / (1 + 3.841458881296::DOUBLE / n) * sqrt(k / n * (1 - k / n) / n + 3.841458881296::DOUBLE / (4 * n * n)))"


@query(f"WITH {SCORED}, g AS (SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (prob >= 0.5::DOUBLE))::DOUBLE AS k, avg(prob) AS p FROM scored GROUP BY source) SELECT source, n::BIGINT AS n, round(k / n, 6) AS rate, round({WILSON}, 6) AS low, round(least(1, {WILSON.replace('greatest(0, ', '(').replace('::DOUBLE / n) - 1.959964', '::DOUBLE / n) + 1.959964')}), 6) AS high, round(p, 6) AS mean_prob, n < 20 AS descriptive_only FROM g")
def a19_wilson_strata(spark, d):
    g = scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), count_if(flag_a() == 1).cast("double").alias("k"), F.avg("prob").alias("p"))
    low, high = m.wilson(F.col("k"), F.col("n"))
    return g.select("source", F.col("n").cast("long").alias("n"), r6(F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"), r6("p").alias("mean_prob"), (F.col("n") < 20).alias("descriptive_only"))


@query(f"WITH {SCORED}, g AS (SELECT source, avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (quality = 1) AS a, avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (quality = 0) AS b FROM scored GROUP BY source) SELECT source, round(a, 6) AS good, round(b, 6) AS bad, round(a - b, 6) AS delta FROM g")
def a20_interaction(spark, d):
    g = scored(spark, d).withColumn("pred", flag_a()).groupBy("source").pivot("quality", [1, 0]).agg(F.avg("pred"))
    return g.select("source", r6("1").alias("good"), r6("0").alias("bad"), r6(F.col("1") - F.col("0")).alias("delta"))


@query(f"WITH {SCORED} SELECT source, label, count(*) AS n FROM scored WHERE prob >= 0.9::DOUBLE GROUP BY GROUPING SETS ((source), (label), ())")
def a21_high_confidence(spark, d):
    return scored(spark, d).where("prob >= 0.9D").groupingSets([["source"], ["label"], []], "source", "label").agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations), q AS (SELECT contains(lower(text), 'the') AS a, contains(lower(reply), 'the') AS b FROM p WHERE role = 'user' AND next_role = 'assistant') SELECT count(*) FILTER (a AND NOT b) AS prompt_only, count(*) FILTER (b AND NOT a) AS response_only, count(*) FILTER (a AND b) AS both_sides, count(*) AS n FROM q")
def a22_keyword_sides(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, d, "conversations").select("role", "text", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("next_role")).where("role = 'user' AND next_role = 'assistant'")
    a, b = F.contains(F.lower("text"), F.lit("the")), F.contains(F.lower("reply"), F.lit("the"))
    return p.agg(count_if(a & ~b).alias("prompt_only"), count_if(b & ~a).alias("response_only"), count_if(a & b).alias("both_sides"), F.count(F.lit(1)).alias("n"))


@query()
def a24_clopper_pearson(spark, d):
    g = scored(spark, d).groupBy("lang").agg(count_if(flag_a() == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    ci = g.withColumn("ci", stats.cp_interval("k", "n"))
    return ci.select("lang", "k", "n", r6("ci.low").alias("low"), r6("ci.high").alias("high"))


Z = "((a / na - b / nb) / sqrt((a + b) / (na + nb) * (1 - (a + b) / (na + nb)) * (1 / na + 1 / nb)))"


@query(f"WITH {SCORED}, g AS (SELECT (count(*) FILTER (prob >= 0.5::DOUBLE AND quality = 1))::DOUBLE AS a, (count(*) FILTER (quality = 1))::DOUBLE AS na, (count(*) FILTER (prob >= 0.5::DOUBLE AND quality = 0))::DOUBLE AS b, (count(*) FILTER (quality = 0))::DOUBLE AS nb FROM scored) SELECT a::BIGINT AS a, na::BIGINT AS na, b::BIGINT AS b, nb::BIGINT AS nb, round({Z}, 6) AS z FROM g")
def a25_two_proportion(spark, d):
    g = scored(spark, d).agg(count_if((flag_a() == 1) & (F.col("quality") == 1)).alias("a"), count_if(F.col("quality") == 1).alias("na"), count_if((flag_a() == 1) & (F.col("quality") == 0)).alias("b"), count_if(F.col("quality") == 0).alias("nb"))
    a, na, b, nb = (F.col(c).cast("double") for c in ("a", "na", "b", "nb"))
    p = (a + b) / (na + nb)
    return g.select("a", "na", "b", "nb", r6(m.ratio(a / na - b / nb, F.sqrt(p * (1 - p) * (1 / na + 1 / nb)))).alias("z"))


@query(f"WITH {SCORED} SELECT count(*) FILTER ((prob >= 0.5::DOUBLE)::INTEGER = label AND (prob_b >= 0.5::DOUBLE)::INTEGER <> label) AS a_only, count(*) FILTER ((prob >= 0.5::DOUBLE)::INTEGER <> label AND (prob_b >= 0.5::DOUBLE)::INTEGER = label) AS b_only FROM scored")
def a26_mcnemar_counts(spark, d):
    y = F.col("label")
    return scored(spark, d).agg(count_if((flag_a() == y) & (flag_b() != y)).alias("a_only"), count_if((flag_a() != y) & (flag_b() == y)).alias("b_only"))


@query()
def a26_mcnemar_exact(spark, d):
    return a26_mcnemar_counts(spark, d).select("a_only", "b_only", r6(stats.mcnemar_p("a_only", "b_only")).alias("p_value"))


@query()
def a27_bootstrap_f1(spark, d):
    return stats.bootstrap_f1(scored(spark, d))


@query()
def a28_paired_bootstrap(spark, d):
    return stats.paired_bootstrap(scored(spark, d))


RANKS = "{0}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS b FROM scored)"


@query(f"WITH {RANKS.format(SCORED)} SELECT round(corr(a, b), 6) AS rho FROM r")
def a29_spearman(spark, d):
    return m.spearman(scored(spark, d), "n_chars", "prob")


@query(f"WITH {SCORED} SELECT count(*) FILTER ((prob >= 0.5::DOUBLE)::INTEGER <> label AND (prob_b >= 0.5::DOUBLE)::INTEGER <> label) AS both_wrong, count(*) FILTER ((prob >= 0.5::DOUBLE)::INTEGER <> label AND (prob_b >= 0.5::DOUBLE)::INTEGER = label) AS a_only, count(*) FILTER ((prob >= 0.5::DOUBLE)::INTEGER = label AND (prob_b >= 0.5::DOUBLE)::INTEGER <> label) AS b_only FROM scored")
def a30_orthogonality(spark, d):
    a, b = flag_a() != F.col("label"), flag_b() != F.col("label")
    return scored(spark, d).agg(count_if(a & b).alias("both_wrong"), count_if(a & ~b).alias("a_only"), count_if(b & ~a).alias("b_only"))


@query(f"WITH {SCORED} SELECT lang, round(1 - avg(prob) FILTER (label = 0) + avg(prob) FILTER (label = 1) - 1, 6) AS youden FROM scored GROUP BY lang")
def a31_youden(spark, d):
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("prob")))
    return scored(spark, d).groupBy("lang").agg(r6(1 - mean(0) + mean(1) - 1).alias("youden"))


@query(f"WITH {SCORED} SELECT round(avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (label = 0), 6) AS fpr, round(1 - avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (label = 1), 6) AS fnr FROM scored")
def a32_ood_rates(spark, d):
    return scored(spark, d).agg(r6(F.avg(F.when(F.col("label") == 0, flag_a()))).alias("fpr"), r6(1 - F.avg(F.when(F.col("label") == 1, flag_a()))).alias("fnr"))


@query(f"WITH {SCORED}, g AS (SELECT source, avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (lang = 'en') AS a, avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (lang <> 'en') AS b FROM scored GROUP BY source) SELECT source, round(a, 6) AS inside, round(b, 6) AS outside, round(a / nullif(b, 0), 6) AS selectivity FROM g")
def a33_selectivity(spark, d):
    g = scored(spark, d).groupBy("source").agg(F.avg(F.when(F.col("lang") == "en", flag_a())).alias("a"), F.avg(F.when(F.col("lang") != "en", flag_a())).alias("b"))
    return g.select("source", r6("a").alias("inside"), r6("b").alias("outside"), r6(m.ratio(F.col("a"), F.col("b"))).alias("selectivity"))


@query(f"WITH {SCORED} SELECT source, count(*) FILTER (prob >= 0.5::DOUBLE) AS n_base, round((count(*) FILTER (prob >= 0.5::DOUBLE AND prob_b < 0.5::DOUBLE))::DOUBLE / nullif(count(*) FILTER (prob >= 0.5::DOUBLE), 0), 6) AS success_rate, round(avg(((prob >= 0.5::DOUBLE)::INTEGER = label)::INTEGER) - avg(((prob_b >= 0.5::DOUBLE)::INTEGER = label)::INTEGER), 6) AS degradation FROM scored GROUP BY source")
def a34_attack_success(spark, d):
    right = lambda p: F.avg((p == F.col("label")).cast("int"))
    return scored(spark, d).groupBy("source").agg(count_if(flag_a() == 1).alias("n_base"), r6(m.ratio(count_if((flag_a() == 1) & (flag_b() == 0)), count_if(flag_a() == 1))).alias("success_rate"), r6(right(flag_a()) - right(flag_b())).alias("degradation"))


@query(f"WITH {SCORED}, a AS (SELECT source, avg((prob >= 0.5::DOUBLE)::INTEGER) AS pre FROM scored GROUP BY source), b AS (SELECT source, avg((prob_b >= 0.5::DOUBLE)::INTEGER) AS post FROM scored GROUP BY source) SELECT source, round(pre, 6) AS pre, round(post, 6) AS post, CASE WHEN round(post - pre, 6) > 0.05::DOUBLE THEN 'worse' WHEN round(post - pre, 6) < -0.05::DOUBLE THEN 'better' WHEN pre = 0 THEN 'none' ELSE 'same' END AS contribution FROM a JOIN b USING (source)")
def a35_pre_post(spark, d):
    s = scored(spark, d)
    j = s.groupBy("source").agg(F.avg(flag_a()).alias("pre")).join(s.groupBy("source").agg(F.avg(flag_b()).alias("post")), "source")
    delta = r6(F.col("post") - F.col("pre"))
    return j.select("source", r6("pre").alias("pre"), r6("post").alias("post"), F.when(delta > 0.05, "worse").when(delta < -0.05, "better").when(F.col("pre") == 0, "none").otherwise("same").alias("contribution"))


PRIORS = [0.001, 0.01, 0.05, 0.1, 0.5]


@query(f"WITH {SWEEP}, p(prior) AS (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)) SELECT threshold, prior, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) * prior + coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) * (1 - prior), 6) AS rate FROM c, p")
def a36_escalation_table(spark, d):
    c = m.sweep(scored(spark, d), GRID).withColumn("prior", F.explode(F.array(*map(F.lit, PRIORS))))
    z = lambda a, b: F.coalesce(m.ratio(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return c.select("threshold", "prior", r6(z("tp", "fn") * F.col("prior") + z("fp", "tn") * (1 - F.col("prior"))).alias("rate"))


@query("SELECT toxic AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 6) AS weight FROM labels GROUP BY toxic")
def a37_class_weights(spark, d):
    c = table(spark, d, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(total)).select("label", "n", r6(F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


@query(f"WITH {SCORED} SELECT source, count(*) AS n, round(avg((prob >= 0.5::DOUBLE)::INTEGER), 6) AS fpr FROM scored WHERE label = 0 GROUP BY GROUPING SETS ((source), ())")
def a38_over_refusal(spark, d):
    return scored(spark, d).where("label = 0").groupingSets([["source"], []], "source").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(flag_a())).alias("fpr"))


@query("SELECT o_custkey AS question, bool_or(o_orderstatus = 'F' AND o_totalprice >= 100000) AS hit FROM orders GROUP BY 1")
def a39_question_hit(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("question")).agg(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000)).alias("hit"))


@query(f"WITH {SCORED} SELECT source, count(*) AS n, count(*) FILTER (prob >= 0.5::DOUBLE) AS n_flag, count(*) FILTER (prob < 0.5::DOUBLE) AS miss FROM scored WHERE label = 1 GROUP BY ROLLUP (source)")
def a40_miss_breakdown(spark, d):
    return scored(spark, d).where("label = 1").rollup("source").agg(F.count(F.lit(1)).alias("n"), count_if(flag_a() == 1).alias("n_flag"), count_if(flag_a() == 0).alias("miss"))


@query("SELECT role, count(*) AS n, count(DISTINCT text) AS n_distinct, round(count(DISTINCT text)::DOUBLE / count(*), 6) AS share FROM conversations GROUP BY role")
def a41_distinct_share(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_distinct"), r6(F.count_distinct("text") / F.count(F.lit(1))).alias("share"))


@query(f"WITH {SCORED}, t(cut) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) SELECT cut, count(*) FILTER (CASE WHEN label = 1 THEN prob ELSE 1 - prob END < cut) AS survivors, count(*) FILTER (label = 1 AND prob < cut) AS survivors_unsafe FROM scored, t GROUP BY cut")
def a42_confidence_sweep(spark, d):
    p = F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    cuts = [0.1, 0.3, 0.5, 0.7, 0.9]
    one = scored(spark, d).agg(F.array(*[F.struct(F.lit(c).alias("cut"), count_if(p < c).alias("survivors"), count_if((F.col("label") == 1) & (F.col("prob") < c)).alias("survivors_unsafe")) for c in cuts]).alias("x"))
    return one.select(F.inline("x"))


@query(r"SELECT 'email' AS pattern, sum(len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')))::BIGINT AS n FROM documents UNION ALL SELECT 'ip', sum(len(regexp_extract_all(text, '\d+\.\d+\.\d+\.\d+')))::BIGINT FROM documents UNION ALL SELECT 'token', sum(len(regexp_extract_all(text, 'token = ')))::BIGINT FROM documents")
def a43_sentinel_counts(spark, d):
    pats = {"email": r"[a-z0-9.]+@[a-z0-9.]+", "ip": r"\d+\.\d+\.\d+\.\d+", "token": "token = "}
    one = table(spark, d, "documents").agg(F.array(*[F.struct(F.lit(k).alias("pattern"), F.sum(F.regexp_count("text", F.lit(p)).cast("long")).alias("n")) for k, p in pats.items()]).alias("x"))
    return one.select(F.inline("x"))


@query(f"WITH {SCORED}, v AS (SELECT item_id, label, variant, (CASE variant WHEN 'original' THEN prob ELSE prob_b END >= 0.5::DOUBLE)::INTEGER AS pred, (prob >= 0.5::DOUBLE)::INTEGER AS base FROM scored, (VALUES ('original'), ('swapped')) t(variant)) SELECT variant, round(avg(pred), 6) AS flag_rate, round(avg(pred) FILTER (label = 1), 6) AS tpr, round(avg(pred) FILTER (label = 0), 6) AS fpr, round(avg((pred <> base)::INTEGER), 6) AS flip_rate FROM v GROUP BY variant")
def a45_template_invariance(spark, d):
    v = scored(spark, d).select("label", flag_a().alias("base"), F.inline(F.array(F.struct(F.lit("original").alias("variant"), flag_a().alias("pred")), F.struct(F.lit("swapped").alias("variant"), flag_b().alias("pred")))))
    return v.groupBy("variant").agg(r6(F.avg("pred")).alias("flag_rate"), r6(F.avg(F.when(F.col("label") == 1, F.col("pred")))).alias("tpr"), r6(F.avg(F.when(F.col("label") == 0, F.col("pred")))).alias("fpr"), r6(F.avg((F.col("pred") != F.col("base")).cast("int"))).alias("flip_rate"))


@query(f"WITH {SCORED} SELECT lang, round(avg(prob_b - prob), 6) AS mean_shift, count(*) FILTER ((prob >= 0.5::DOUBLE) <> (prob_b >= 0.5::DOUBLE)) AS n_changed FROM scored GROUP BY lang")
def a46_ablation_shift(spark, d):
    return scored(spark, d).groupBy("lang").agg(r6(F.avg(F.col("prob_b") - F.col("prob"))).alias("mean_shift"), count_if(flag_a() != flag_b()).alias("n_changed"))


@query(f"WITH {SCORED} SELECT round(avg((prob_b < 0.5::DOUBLE)::INTEGER) FILTER (label = 1 AND prob >= 0.5::DOUBLE), 6) AS evasion, avg((prob_b < 0.5::DOUBLE)::INTEGER) FILTER (label = 1 AND prob >= 0.5::DOUBLE) <= 0.2::DOUBLE AS passed FROM scored")
def a47_evasion(spark, d):
    e = F.avg(F.when((F.col("label") == 1) & (flag_a() == 1), 1 - flag_b()))
    return scored(spark, d).agg(r6(e).alias("evasion"), (e <= 0.2).alias("passed"))


@query(f"WITH {SCORED}, t(tau) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) SELECT tau, lang, quality, count(*) AS n, round(avg((prob >= tau)::INTEGER), 6) AS rate FROM scored, t WHERE label = 0 GROUP BY GROUPING SETS ((tau), (tau, lang), (tau, quality))")
def a49_rate_by_tau(spark, d):
    s = scored(spark, d).where("label = 0").withColumn("tau", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    return s.groupingSets([["tau"], ["tau", "lang"], ["tau", "quality"]], "tau", "lang", "quality").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("prob") >= F.col("tau")).cast("int"))).alias("rate"))


@query(f"WITH {SCORED} SELECT source, count(*) AS n, count(*) FILTER (prob > 0.9::DOUBLE) AS confident, count(*) FILTER (prob <= 0.9::DOUBLE) AS borderline, count(*) FILTER (n_chars < 60) AS near_empty, min(n_chars) AS min_len, round(median(n_chars), 6) AS med_len, max(n_chars) AS max_len FROM scored WHERE label = 0 AND prob >= 0.5::DOUBLE GROUP BY source")
def a50_fp_diagnosis(spark, d):
    f = scored(spark, d).where((F.col("label") == 0) & (flag_a() == 1))
    per = f.groupBy("source").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("prob") > 0.9).alias("confident"), count_if(F.col("prob") <= 0.9).alias("borderline"), count_if(F.col("n_chars") < 60).alias("near_empty"), F.min("n_chars").alias("min_len"), F.max("n_chars").alias("max_len"))
    return m.with_quantiles(per, f, "n_chars", {"med_len": 0.5}, "source")


@query("SELECT source, round(100.0::DOUBLE * avg(regexp_matches(lower(text), '(^|[^a-z])the($|[^a-z])')::INTEGER), 6) AS pct_retained, min(length(text)) AS min_len, round(median(length(text)), 6) AS med_len, max(length(text)) AS max_len FROM documents WHERE lang = 'en' GROUP BY source")
def a51_paraphrase_audit(spark, d):
    t = table(spark, d, "documents").where("lang = 'en'").select("source", "text", F.length("text").alias("n"))
    per = t.groupBy("source").agg(r6(100.0 * F.avg(F.lower("text").rlike("(^|[^a-z])the($|[^a-z])").cast("int"))).alias("pct_retained"), F.min("n").alias("min_len"), F.max("n").alias("max_len"))
    return m.with_quantiles(per, t, "n", {"med_len": 0.5}, "source")


@query(f"WITH {SWEEP}, k AS (SELECT threshold, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c) SELECT threshold, f1 FROM k ORDER BY f1 DESC, threshold LIMIT 1")
def t02_best_threshold(spark, d):
    return m.derived(m.sweep(scored(spark, d), GRID)).select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


@query(f"WITH {SWEEP}, k AS (SELECT threshold, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall FROM c) SELECT max(threshold) FILTER (recall >= 0.9::DOUBLE) AS threshold, max(recall) AS best_recall, max(threshold) FILTER (recall >= 0.9::DOUBLE) IS NOT NULL AS achievable FROM k")
def t03_highest_recall_threshold(spark, d):
    c = m.derived(m.sweep(scored(spark, d), GRID))
    t = F.max(F.when(F.col("recall") >= 0.9, F.col("threshold")))
    return c.agg(t.alias("threshold"), F.max("recall").alias("best_recall"), t.isNotNull().alias("achievable"))


@query(f"WITH {SWEEP} SELECT coalesce(min(threshold) FILTER (coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) <= 0.05::DOUBLE), 0.999::DOUBLE) AS tau FROM c")
def t04_matched_operating_point(spark, d):
    z = F.coalesce(m.ratio(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0))
    return m.sweep(scored(spark, d), GRID).agg(F.coalesce(F.min(F.when(z <= 0.05, F.col("threshold"))), F.lit(0.999)).alias("tau"))


@query(f"WITH {SCORED}, q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM scored) SELECT CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= b THEN 2 WHEN n_chars <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg((prob >= 0.5::DOUBLE)::INTEGER), 6) AS rate FROM scored, q GROUP BY 1")
def w05_length_quartiles(spark, d):
    s = scored(spark, d)
    q = m.with_quantiles(s.agg(F.count(F.lit(1)).alias("n_all")), s, "n_chars", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    k = F.when(F.col("n_chars") <= F.col("q1"), 1).when(F.col("n_chars") <= F.col("q2"), 2).when(F.col("n_chars") <= F.col("q3"), 3).otherwise(4)
    return s.crossJoin(F.broadcast(q)).groupBy(k.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(flag_a())).alias("rate"))


@query(f"WITH {SWEEP}, k AS (SELECT threshold, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) <= 0.4::DOUBLE AS ok FROM c), r AS (SELECT threshold, bool_and(ok) OVER (ORDER BY threshold DESC) AS kept FROM k) SELECT min(threshold) AS tau FROM r WHERE kept")
def w10_fixed_sequence_scan(spark, d):
    z = F.coalesce(m.ratio(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0))
    k = m.sweep(scored(spark, d), GRID).select("threshold", F.bool_and(z <= 0.4).over(Window.orderBy(F.desc("threshold"))).alias("kept"))
    return k.where("kept").agg(F.min("threshold").alias("tau"))


TEMPS = "(SELECT (50 + 5 * i) / 100.0::DOUBLE AS temp FROM range(0, 60) r(i))"


@query(f"WITH {SCORED}, l AS (SELECT label, ln(greatest(least(prob, 0.9999::DOUBLE), 0.0001::DOUBLE) / (1 - greatest(least(prob, 0.9999::DOUBLE), 0.0001::DOUBLE))) AS z FROM scored), n AS (SELECT temp, round(avg(ln(1 + exp(CASE WHEN label = 1 THEN -z / temp ELSE z / temp END))), 6) AS nll FROM l, {TEMPS} GROUP BY temp) SELECT temp, nll FROM n")
def m11_temperature_grid(spark, d):
    p = F.greatest(F.least(F.col("prob"), F.lit(0.9999)), F.lit(0.0001))
    z = F.log(p / (1 - p))
    s = scored(spark, d).select("label", z.alias("z"))
    one = s.agg(F.array(*[F.struct(F.lit(t).alias("temp"), r6(F.avg(F.log(1 + F.exp(F.when(F.col("label") == 1, -F.col("z") / t).otherwise(F.col("z") / t))))).alias("nll")) for t in [(50 + 5 * i) / 100 for i in range(60)]]).alias("x"))
    return one.select(F.inline("x"))


@query(f"WITH {SCORED}, w AS (SELECT i / 10.0::DOUBLE AS w FROM range(0, 11) r(i)) SELECT w, count(*) FILTER (w * prob + (1 - w) * prob_b >= 0.5::DOUBLE AND label = 1) AS tp, count(*) FILTER (w * prob + (1 - w) * prob_b >= 0.5::DOUBLE AND label = 0) AS fp FROM scored, w GROUP BY w")
def x32_ensemble_sweep(spark, d):
    ws = [i / 10 for i in range(11)]
    p = lambda w: F.lit(w) * F.col("prob") + (1 - F.lit(w)) * F.col("prob_b")
    one = scored(spark, d).agg(F.array(*[F.struct(F.lit(w).alias("w"), count_if((p(w) >= 0.5) & (F.col("label") == 1)).alias("tp"), count_if((p(w) >= 0.5) & (F.col("label") == 0)).alias("fp")) for w in ws]).alias("x"))
    return one.select(F.inline("x"))


@query(f"WITH {SCORED}, f AS (SELECT label, 0.6::DOUBLE * ln(greatest(prob, 0.0001::DOUBLE) / greatest(1 - prob, 0.0001::DOUBLE)) + 0.4::DOUBLE * ln(greatest(prob_b, 0.0001::DOUBLE) / greatest(1 - prob_b, 0.0001::DOUBLE)) AS z FROM scored) SELECT count(*) FILTER (z >= 0 AND label = 1) AS tp, count(*) FILTER (z >= 0 AND label = 0) AS fp, round(avg(1 / (1 + exp(-z))), 6) AS mean_prob FROM f")
def m14_logit_fusion(spark, d):
    z = lambda c: F.log(F.greatest(F.col(c), F.lit(0.0001)) / F.greatest(1 - F.col(c), F.lit(0.0001)))
    f = scored(spark, d).select("label", (0.6 * z("prob") + 0.4 * z("prob_b")).alias("z"))
    return f.agg(count_if((F.col("z") >= 0) & (F.col("label") == 1)).alias("tp"), count_if((F.col("z") >= 0) & (F.col("label") == 0)).alias("fp"), r6(F.avg(1 / (1 + F.exp(-F.col("z"))))).alias("mean_prob"))


SHARES = [0.0, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5]


@query(f"""WITH {SCORED}, g AS (SELECT unnest({SHARES}::DOUBLE[]) AS share),
m AS (SELECT share, lang, label, (1 - share) * prob + share * prob_b AS prob FROM scored, g),
c AS (SELECT share, {CELLS} FROM m GROUP BY share), d AS (SELECT share, {DERIVED} FROM c),
o AS (SELECT share, {CELLS} FROM m WHERE lang = 'es' GROUP BY share), e AS (SELECT share, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS es_recall FROM o),
k AS (SELECT d.share, f1, recall, fpr, es_recall, fpr < 0.2::DOUBLE AS g_fpr, recall >= 0.3::DOUBLE AS g_recall, f1 >= 0.2::DOUBLE AS g_f1, es_recall >= 0.2::DOUBLE AS g_es FROM d LEFT JOIN e USING (share)),
p AS (SELECT *, (g_fpr IS NULL)::BIGINT + (g_recall IS NULL)::BIGINT + (g_f1 IS NULL)::BIGINT + (g_es IS NULL)::BIGINT AS missing, coalesce(g_fpr, true) AND coalesce(g_recall, true) AND coalesce(g_f1, true) AND coalesce(g_es, true) AND coalesce(g_fpr, g_recall, g_f1, g_es) IS NOT NULL AS passes FROM k)
SELECT *, passes AND row_number() OVER (ORDER BY passes DESC, f1 DESC, share) = 1 AS best FROM p""")
def m19_lambda_grid(spark, d):
    """Candidates by the share of the second score: metrics, four gates (one on a subgroup that may lack positives), and
    the candidate of the best F1 among those that pass."""
    mixed = m.mixtures(scored(spark, d).select("lang", "label", "prob", "prob_b"), "prob", "prob_b", SHARES)
    every = m.derived(m.confusion(mixed, "share")).select("share", "f1", "recall", "fpr")
    es = m.confusion(mixed.where("lang = 'es'"), "share").select(F.col("share").alias("_s"), m.r6(m.ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("es_recall"))
    c = every.join(F.broadcast(es), F.col("share") == F.col("_s"), "left").drop("_s")
    c = m.gated(c, {"g_fpr": F.col("fpr") < 0.2, "g_recall": F.col("recall") >= 0.3, "g_f1": F.col("f1") >= 0.2, "g_es": F.col("es_recall") >= 0.2})
    return c.withColumn("best", m.best_of(c, F.desc("f1"), F.col("share")))


QUERIES, SQL = query.queries, query.sql
