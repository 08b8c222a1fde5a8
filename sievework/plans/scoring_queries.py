"""Queries M02-M04, M10, M12, M15-M18, M20, A34, A44, P01, P04, T05: from texts to scores, and reports about scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import metrics as m
from ..operators import ml, scoring
from ._base import Plan, table

query = Plan()
count_if = lambda c: F.count(F.when(c, 1))
r6 = m.r6
INVISIBLE_SQL = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"


def words_sql(t):
    return f"regexp_extract_all(lower(regexp_replace(coalesce({t}, ''), '{INVISIBLE_SQL}', '', 'g')), '[a-z]+')"


def prob_sql(ws):
    z = " + ".join([f"{scoring.BIAS}"] + [f"({v}) * len(list_filter({ws}, lambda v: v = '{k}'))" for k, v in scoring.WEIGHTS.items()])
    return f"(floor(10000 / (1 + exp(-({z}) / 100.0::DOUBLE)) + 0.5::DOUBLE) / 10000.0::DOUBLE)"


TEXT = f"scored AS (SELECT doc_id AS item_id, source, lang, label, {prob_sql('ws')} AS prob FROM (SELECT d.doc_id, source, lang, toxic AS label, {words_sql('text')} AS ws FROM documents d JOIN labels USING (doc_id)))"


def text_scored(spark, d):
    """documents x labels with the probability that the text gets."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return t.select(F.col("doc_id").alias("item_id"), "source", "lang", F.col("toxic").alias("label"), scoring.score(F.col("text")).alias("prob"))


@query(f"SELECT doc_id, (p >= 0.5::DOUBLE)::INTEGER AS label, round(greatest(p, 1 - p), 6) AS confidence, p AS prob FROM (SELECT doc_id, {prob_sql('ws')} AS p FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents))")
def m03_batch_scores(spark, d):
    v = x.let(scoring.score(F.col("text")), lambda p: scoring.verdict(p))
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.*")


@query(f"WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) SELECT conv_id, turn, {prob_sql('ws')} AS prob FROM (SELECT conv_id, turn, {words_sql(chr(39) + chr(39) + ' || text || ' + chr(39) + ' [SEP] ' + chr(39) + ' || coalesce(reply, ' + chr(39) * 2 + ')')} AS ws FROM t)")
def m03_pair_scores(spark, d):
    """Pair mode: a turn with the one that answers it, found by the next number of the same conversation."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    from pyspark.sql import Window

    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select("conv_id", "turn", scoring.score(scoring.pair(F.col("text"), reply)).alias("prob"))


@query(f"WITH w AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents), k AS (SELECT doc_id, ws, greatest(0, ceil((len(ws) - 128) / 64.0::DOUBLE))::BIGINT AS last FROM w), e AS (SELECT doc_id, ws[i * 64 + 1 : i * 64 + 128] AS ws FROM (SELECT doc_id, ws, unnest(range(0, last + 1)) AS i FROM k)), s AS (SELECT doc_id, {prob_sql('ws')} AS p FROM e) SELECT doc_id, count(*) AS n_windows, max(p) AS max_prob, round(avg(p), 6) AS mean_prob, (max(p) >= 0.5::DOUBLE)::INTEGER AS label FROM s GROUP BY doc_id")
def m04_sliding_scores(spark, d):
    p = table(spark, d, "documents").select("doc_id", scoring.sliding(F.col("text")).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / F.size("p")
    return p.select("doc_id", F.size("p").cast("long").alias("n_windows"), F.array_max("p").alias("max_prob"), r6(mean).alias("mean_prob"), (F.array_max("p") >= 0.5).cast("int").alias("label"))


@query(f"WITH g AS (SELECT source, CASE WHEN text IS NULL THEN 'missing' WHEN length(trim(text)) < 40 THEN 'too short' END AS error, {prob_sql('ws')} AS p FROM (SELECT source, text, {words_sql('text')} AS ws FROM documents)) SELECT source, count(*) AS n, count(error) AS n_errors, count(*) FILTER (error IS NULL AND p >= 0.5::DOUBLE) AS n_flagged FROM g GROUP BY source")
def m17_baseline_errors(spark, d):
    g = table(spark, d, "documents").select("source", scoring.guarded(F.col("text"), 40).alias("v"))
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("v.error").alias("n_errors"), count_if(F.col("v.label") == 1).alias("n_flagged"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, toxic AS y, unnest({words_sql('text')}) AS word FROM documents JOIN labels USING (doc_id)), n AS (SELECT sum(toxic) AS n1, sum(1 - toxic) AS n0 FROM documents JOIN labels USING (doc_id)), c AS (SELECT word, sum(y) AS a, sum(1 - y) AS b FROM w GROUP BY word HAVING count(*) >= 5), o AS (SELECT word, a, b, ln((a + 0.5::DOUBLE) / (n1 - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (n0 - b + 0.5::DOUBLE)) AS odds FROM c, n) SELECT word, floor(100 * odds + 0.5::DOUBLE)::INTEGER AS weight, round(abs(odds / sqrt(1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE))), 6) AS z FROM o ORDER BY z DESC, word LIMIT 50")
def m03_fitted_weights(spark, d):
    """The scorer learnt from labelled texts."""
    t = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return scoring.fit_weights(t, "text", "toxic")


@query(f"WITH {TEXT}, c AS (SELECT count(*) FILTER (label = 1 AND prob >= 0.5::DOUBLE) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5::DOUBLE) AS fp, count(*) FILTER (label = 0 AND prob < 0.5::DOUBLE) AS tn, count(*) FILTER (label = 1 AND prob < 0.5::DOUBLE) AS fn FROM scored) SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr FROM c")
def a04_prf_of_texts(spark, d):
    """A03 and A04 on scores that come from the texts."""
    return m.derived(m.confusion(text_scored(spark, d)))


GRID5 = [round(0.05 * i, 2) for i in range(1, 20)]
GRID5_SQL = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in GRID5) + "]) AS threshold)"
SWEPT = f"{TEXT}, c AS (SELECT threshold, count(*) FILTER (label = 1 AND prob >= threshold) AS tp, count(*) FILTER (label = 0 AND prob >= threshold) AS fp, count(*) FILTER (label = 0 AND prob < threshold) AS tn, count(*) FILTER (label = 1 AND prob < threshold) AS fn FROM scored, {GRID5_SQL} GROUP BY threshold), k AS (SELECT threshold, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr FROM c)"


@query(f"WITH {SWEPT} SELECT min(threshold) FILTER (fpr <= 0.05::DOUBLE) AS tau FROM k")
def t05_first_tau(spark, d):
    """The first threshold, ascending, with at most five per cent of false alarms."""
    return m.derived(m.sweep(text_scored(spark, d), GRID5)).agg(F.min(F.when(F.col("fpr") <= 0.05, F.col("threshold"))).alias("tau"))


@query(f"WITH {SWEPT}, g AS (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS target), best AS (SELECT max(recall) AS r, arg_max(threshold, recall * 1000 + threshold) AS t FROM k), w AS (SELECT target, coalesce(max(threshold) FILTER (recall >= target), max(best.t)) AS threshold, max(best.r) >= target AS achievable FROM g, k, best GROUP BY target), p AS (SELECT unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE]) AS prior) SELECT target, achievable, threshold, recall, fpr, prior, round(recall * prior + fpr * (1 - prior), 6) AS escalated FROM w JOIN k USING (threshold), p")
def m12_escalation_report(spark, d):
    """Per recall target the highest threshold that meets it (or the one of best recall), and how much it escalates at
    several base rates. The curve has one row per threshold of the grid."""
    k = m.derived(m.sweep(text_scored(spark, d), GRID5)).select("threshold", "recall", "fpr")
    points = k.agg(F.collect_list(F.struct("threshold", "recall", "fpr")).alias("k"))
    each = points.select("k", F.explode(F.array(*map(F.lit, [0.5, 0.7, 0.8, 0.9]))).alias("target"))
    met = F.array_max(F.filter("k", lambda p: p["recall"] >= F.col("target")))
    best = F.array_max(F.transform("k", lambda p: F.struct(p["recall"].alias("recall"), p["threshold"].alias("threshold"), p["fpr"].alias("fpr"))))
    each = each.select("target", met.isNotNull().alias("achievable"), F.coalesce(met, F.struct(best["threshold"].alias("threshold"), best["recall"].alias("recall"), best["fpr"].alias("fpr"))).alias("at"))
    each = each.select("target", "achievable", "at.*", F.explode(F.array(*map(F.lit, [0.001, 0.01, 0.1]))).alias("prior"))
    return each.withColumn("escalated", r6(F.col("recall") * F.col("prior") + F.col("fpr") * (1 - F.col("prior"))))


@query(f"WITH {TEXT}, s AS (SELECT strategy, (prob >= 0.5::DOUBLE)::INTEGER AS p, CASE strategy WHEN 'toxic' THEN label WHEN 'strict' THEN (quality = 0)::INTEGER ELSE (quality = 0 OR label = 1)::INTEGER END AS y FROM scored JOIN labels ON item_id = doc_id, (VALUES ('toxic'), ('strict'), ('broad')) v(strategy)), c AS (SELECT strategy, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM s GROUP BY strategy), e AS (SELECT *, (tp + tn)::DOUBLE / n AS po, ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n::DOUBLE * n) AS pe FROM c) SELECT strategy, n, round(coalesce((po - pe) / nullif(1 - pe, 0), 0), 6) AS kappa, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(po, 6) AS accuracy FROM e")
def m15_external_validation(spark, d):
    """Three readings of the label against the text scores, unpivoted in one pass."""
    q = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    s = text_scored(spark, d).join(q, "item_id")
    bad, toxic = (F.col("quality") == 0).cast("int"), F.col("label")
    each = F.array(*[F.struct(F.lit(k).alias("strategy"), y.alias("y")) for k, y in {"toxic": toxic, "strict": bad, "broad": F.greatest(bad, toxic)}.items()])
    rows = s.select((F.col("prob") >= 0.5).cast("int").alias("p"), F.inline(each)).withColumnRenamed("y", "label")
    c = rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in m.cells(F.col("p")).items()])
    tp, fp, tn, fn, n = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn", "n"))
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return c.select("strategy", "n", r6(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0))).alias("kappa"), r6(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))).alias("f1"), r6(po).alias("accuracy"))


@query(f"WITH {TEXT}, r AS (SELECT lang, round(avg((prob >= 0.5::DOUBLE)::INTEGER), 6) AS flag_rate, round(avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (label = 1), 6) AS hit, count(*) AS n FROM scored GROUP BY lang) SELECT lang, n, flag_rate, hit, round(hit - (SELECT hit FROM r WHERE lang = 'en'), 6) AS delta FROM r WHERE lang <> 'en'")
def m16_ood_deltas(spark, d):
    """Groups outside the home language: how often the positives are hit, and the difference to the home language."""
    f = (F.col("prob") >= 0.5).cast("int")
    r = text_scored(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(f)).alias("flag_rate"), r6(F.avg(F.when(F.col("label") == 1, f))).alias("hit"))
    home = r.where("lang = 'en'").select(F.col("hit").alias("home"))
    return r.where("lang <> 'en'").join(F.broadcast(home), how="left").select("lang", "n", "flag_rate", "hit", r6(F.col("hit") - F.col("home")).alias("delta"))


CHUNKS = "string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"WITH s AS (SELECT doc_id, {CHUNKS} AS s, k FROM documents, (VALUES (1), (2), (3), (5)) v(k)), c AS (SELECT doc_id, k, s, unnest(range(0, k)) AS i FROM s), t AS (SELECT doc_id, k, array_to_string(s[round_even(i * len(s) / k::DOUBLE, 0)::INTEGER + 1 : round_even((i + 1) * len(s) / k::DOUBLE, 0)::INTEGER], ' ') AS text FROM c), p AS (SELECT doc_id, k, {prob_sql('ws')} AS p FROM (SELECT doc_id, k, {words_sql('text')} AS ws FROM t)) SELECT k, count(*) FILTER (f) AS n_flagged, count(*) AS n FROM (SELECT doc_id, k, bool_or(p >= 0.5::DOUBLE) AS f FROM p GROUP BY doc_id, k) GROUP BY k")
def m18_chunk_flags(spark, d):
    """Documents cut into K turns of sentences: flagged if any turn is, for several K. The turns stay in the row."""
    flag = lambda k: F.exists(x.split_k(F.col("text"), k), lambda c: scoring.score(c) >= 0.5)
    t = table(spark, d, "documents").select(F.inline_outer(F.array(*[F.struct(F.lit(k).alias("k"), flag(k).alias("f")) for k in (1, 2, 3, 5)])))
    return t.groupBy("k").agg(count_if(F.col("f")).alias("n_flagged"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, quantile_disc(floor(value)::BIGINT, 0.5) AS p50_ms, quantile_disc(floor(value)::BIGINT, 0.95) AS p95_ms, round(1000 * count(*) / sum(value), 4) AS per_second FROM events GROUP BY event_type")
def a44_latency(spark, d):
    return scoring.latency(table(spark, d, "events").select("event_type", "value"), "event_type", "value")


#: Perturbations as columns and as SQL: words spelt with digits, letters apart, upper case, invisible characters.
PERTURBED = {
    "upper": (lambda t: F.translate(t, x.LOWER, x.UPPER), "translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"),
    "leet": (x.leet, "translate({0}, 'aeiost', '431057')"),
    "zero_width": (lambda t: F.regexp_replace(t, "([a-z])", "$1​"), "regexp_replace({0}, '([a-z])', '\\1' || chr(8203), 'g')"),
    "dotted": (lambda t: F.regexp_replace(t, "([aeiou])", "$1."), "regexp_replace({0}, '([aeiou])', '\\1.', 'g')"),
}
_ARMS = " UNION ALL ".join(f"SELECT '{k}' AS perturbation, label, base, {prob_sql('ws')} AS p FROM (SELECT label, base, {words_sql(s.format('text'))} AS ws FROM b)" for k, (_, s) in PERTURBED.items())
SUITE = f"b AS (SELECT toxic AS label, text, {prob_sql('ws')} AS base FROM (SELECT toxic, text, {words_sql('text')} AS ws FROM documents JOIN labels USING (doc_id))), a AS ({_ARMS}), r AS (SELECT perturbation, count(*) AS n, count(*) FILTER (label = 1 AND base >= 0.5::DOUBLE) AS held, count(*) FILTER (label = 1 AND base >= 0.5::DOUBLE AND p < 0.5::DOUBLE) AS evaded, avg(((base >= 0.5::DOUBLE)::INTEGER = label)::INTEGER) - avg(((p >= 0.5::DOUBLE)::INTEGER = label)::INTEGER) AS drop FROM a GROUP BY perturbation)"


@query(f"WITH {SUITE} SELECT perturbation, n, round(coalesce(evaded::DOUBLE / nullif(held, 0), 0), 6) AS success, round(drop, 6) AS degradation, round(1000.0::DOUBLE * evaded / n, 6) AS per_thousand FROM r")
def p04_suite(spark, d):
    """Examples x perturbations, scored before and after: share of the caught that evade, accuracy lost, evasions per
    thousand texts."""
    return _suite(spark, d).select("perturbation", "n", r6("success").alias("success"), r6("drop").alias("degradation"), r6(1000.0 * F.col("evaded") / F.col("n")).alias("per_thousand"))


def _suite(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    each = F.array(*[F.struct(F.lit(k).alias("perturbation"), scoring.score(f(F.col("text"))).alias("p")) for k, (f, _) in PERTURBED.items()])
    # the base score in a step of its own: beside a generator it would be made once a perturbation
    rows = t.withColumn("base", scoring.score(F.col("text"))).select("label", "base", F.inline_outer(each))
    right = lambda p: ((p >= 0.5).cast("int") == F.col("label")).cast("int")
    held = (F.col("label") == 1) & (F.col("base") >= 0.5)
    r = rows.groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"), count_if(held).alias("held"), count_if(held & (F.col("p") < 0.5)).alias("evaded"), (F.avg(right(F.col("base"))) - F.avg(right(F.col("p")))).alias("drop"))
    return r.withColumn("success", F.coalesce(m.ratio(F.col("evaded"), F.col("held")), F.lit(0.0)))


@query(f"WITH {SUITE}, s AS (SELECT perturbation, coalesce(evaded::DOUBLE / nullif(held, 0), 0) AS success FROM r) SELECT round(avg(success), 6) AS mean_success, round(max(success), 6) AS max_success, (SELECT perturbation FROM s ORDER BY success DESC, perturbation DESC LIMIT 1) AS worst, count(*) AS n_perturbations FROM s")
def a34_suite_summary(spark, d):
    s = _suite(spark, d)
    return s.agg(r6(F.avg("success")).alias("mean_success"), r6(F.max("success")).alias("max_success"), F.max_by("perturbation", F.struct("success", "perturbation")).alias("worst"), F.count(F.lit(1)).alias("n_perturbations"))


@query()
def m02_bow_elimination(spark, d):
    """Per class how many examples a bag of words tells with high confidence out of fold, what is left, and the class
    weights of what is left."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    p = ml.out_of_fold(ml.bag_of_words(t, "text"), "doc_id", "features", "label")
    sure = F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")) > 0.9
    c = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), count_if(sure).alias("eliminated")).withColumn("left", F.col("n") - F.col("eliminated"))
    total = c.agg(F.sum("left").alias("total"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(total)).select("label", "n", "eliminated", "left", r6(m.ratio(F.col("total"), F.col("k") * F.col("left"))).alias("weight"))


EXPERIMENTS = ["m12_escalation_report", "m15_external_validation", "m16_ood_deltas", "m17_baseline_errors", "m18_chunk_flags", "a34_suite_summary", "t05_first_tau"]


@query(" UNION ALL ".join(f"SELECT '{e}' AS experiment, 'ok' AS status, (SELECT count(*) FROM ({query.sql[e]})) AS n_rows, NULL::VARCHAR AS error" for e in EXPERIMENTS))
def m20_orchestrate(spark, d):
    """All experiments on text scores, one after the other, each with its rows or its error."""
    return scoring.run_all(spark, {e: (lambda e=e: query.queries[e](spark, d)) for e in EXPERIMENTS})


QUERIES, SQL = query.queries, query.sql
