"""Queries S*, J*, D*, T*, W06-W09, G*, M01-M08, ST*: sources, joins, de-duplication, splits, samples, ML, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import decon, ml, splits
from ..sources import readers
from ..streaming import streams
from ._base import HASH32, NORM, SCORED, Plan, scored, table

query = Plan()
count_if = lambda c: F.count(F.when(c, 1))


def docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en'")
def s02_scan_project(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id", "lang", "source")


@query("SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def s03_union_sources(spark, d):
    a = docs(spark, d).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 1")
def s13_fullest_source(spark, d):
    return readers.fullest(docs(spark, d).select("source"), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id::VARCHAR AS run, arg_max(event_type, event_id) AS step, arg_max(CASE WHEN value > 50 THEN 'high' ELSE 'low' END, event_id) AS status, count(*) AS lines FROM events GROUP BY user_id")
def s14_log_progress(spark, d):
    e = table(spark, d, "events")
    return readers.progress(e.select(F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("user_id").cast("string"), F.lit(" step="), "event_type", F.lit(" status="), F.when(F.col("value") > 50, "high").otherwise("low")).alias("value")))


@query("SELECT p_brand AS role, list_sort(list(p_partkey)) AS keys FROM part GROUP BY p_brand")
def s15_registry_roles(spark, d):
    return readers.by_role(table(spark, d, "part").select(F.col("p_brand").alias("role"), F.col("p_partkey").alias("key")))


@query("SELECT source AS block, count(*) AS n, count(*) FILTER (toxic = 1) AS n_positive FROM documents JOIN labels USING (doc_id) GROUP BY source")
def s19_manifest(spark, d):
    j = docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumnRenamed("source", "block")
    return readers.manifest(j, "block", "toxic")


@query("WITH m AS (SELECT count(*) AS n_total, least(count(*), 100) AS n_saved, count(*) > 100 AS truncated FROM documents) SELECT doc_id, n_total, n_saved, truncated FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100), m")
def s20_retention(spark, d):
    """The kept rows, each with the numbers of the whole."""
    kept, meta = readers.retained(docs(spark, d).select("doc_id"), "doc_id", 100)
    return kept.crossJoin(F.broadcast(meta))


@query("SELECT o_orderkey, coalesce(c_name, '') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def j01_left_lookup(spark, d):
    bank = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(decon.bounded_broadcast(bank, 1_000_000), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("name"))


@query(f"SELECT doc_id FROM documents WHERE md5({NORM.format('text')}) NOT IN (SELECT md5({NORM.format('text')}) FROM documents WHERE source = 'src1')")
def j02_anti_exact(spark, d):
    t = docs(spark, d)
    key = F.md5(x.collapse(F.col("text"))).alias("k")
    return t.select("doc_id", key).join(t.where("source = 'src1'").select(key).distinct(), "k", "left_anti").select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r WHERE r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)")
def j03_anti_composite(spark, d):
    t = table(spark, d, "lineitem")
    r = t.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return t.join(r, ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber")


@query(f"WITH e AS (SELECT DISTINCT {NORM.format('text')} AS k FROM documents WHERE source = 'src2'), t AS (SELECT DISTINCT {NORM.format('text')} AS k FROM documents WHERE source <> 'src2') SELECT count(*) AS n_eval, count(t.k) AS n_overlap, round(100.0::DOUBLE * count(t.k) / count(*), 6) AS pct, CASE WHEN count(t.k) = 0 THEN 'CLEAN' WHEN 100.0::DOUBLE * count(t.k) / count(*) < 5 THEN 'PARTIAL' ELSE 'LEAK' END AS status FROM e LEFT JOIN t USING (k)")
def j04_overlap_audit(spark, d):
    t = docs(spark, d)
    return decon.overlap(t.where("source <> 'src2'"), t.where("source = 'src2'"), x.collapse(F.col("text")))


GRAMS = "{0}(SELECT {1} AS k, [array_to_string(ws[i:i+7], ' ') for i in range(1, len(ws) - 6)] AS g FROM (SELECT {1}, list_filter(string_split(" + NORM.format("text") + ", ' '), lambda v: v <> '') AS ws FROM {2}))"
HITS = "d AS " + GRAMS.format("", "doc_id", "documents") + ", b AS " + GRAMS.format("", "item_id", "benchmark") + ", u AS (SELECT DISTINCT unnest(g) AS g FROM b), hit AS (SELECT DISTINCT k FROM (SELECT k, unnest(g) AS g FROM d) JOIN u USING (g))"


@query(f"WITH {HITS} SELECT k AS doc_id FROM hit")
def j05_ngram_semi(spark, d):
    return decon.ngram_hits(docs(spark, d), table(spark, d, "benchmark"), "doc_id")


@query(f"SELECT DISTINCT d.doc_id FROM documents d JOIN (SELECT DISTINCT substr({NORM.format('text')}, 1, 64) AS k FROM documents WHERE source = 'src3') b ON substr({NORM.format('d.text')}, 1, 64) = b.k")
def j06_prefix_overlap(spark, d):
    key = F.substring(x.collapse(F.col("text")), 1, 64).alias("k")
    t = docs(spark, d)
    return t.select("doc_id", key).join(t.where("source = 'src3'").select(key).distinct(), "k", "left_semi").select("doc_id").distinct()


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (NOT (a.label IS NOT DISTINCT FROM b.toxic)) AS n_different FROM scored a FULL JOIN labels b ON a.item_id = b.doc_id")
def j08_alignment(spark, d):
    a = scored(spark, d).select("item_id", "label")
    b = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "toxic")
    return a.join(b, "item_id", "full").agg(F.count(F.lit(1)).alias("n"), count_if(~F.col("label").eqNullSafe(F.col("toxic"))).alias("n_different"))


@query("WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) SELECT a.o_custkey, a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.rn = b.rn WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F'")
def j09_tier_match(spark, d):
    """One window and one aggregate: matched positions pivot together, no self-join."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    r = table(spark, d, "orders").where("o_orderstatus IN ('O', 'F')").select("o_custkey", "o_orderstatus", "o_orderkey", F.row_number().over(w).alias("rn"))
    one = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    return r.groupBy("o_custkey", "rn").agg(one("O").alias("first_key"), one("F").alias("second_key")).where("first_key IS NOT NULL AND second_key IS NOT NULL").select("o_custkey", "first_key", "second_key")


@query("SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5")
def j10_all_tiers(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.size(F.collect_set("o_orderpriority")).alias("n"))
    return g.where("n = 5").select("o_custkey", "first_key")


@query("SELECT item_id, variant, label, text || suffix AS text FROM benchmark, (VALUES ('plain', 0, ''), ('refusal', 0, ' No.'), ('answer', 1, ' Yes.')) v(variant, label, suffix)")
def j11_variant_cross(spark, d):
    v = F.array(*[F.struct(F.lit(a).alias("variant"), F.lit(b).alias("label"), F.lit(c).alias("suffix")) for a, b, c in (("plain", 0, ""), ("refusal", 0, " No."), ("answer", 1, " Yes."))])
    return table(spark, d, "benchmark").select("item_id", "text", F.inline(v)).select("item_id", "variant", "label", F.concat("text", "suffix").alias("text"))


PARETO = f"WITH {SCORED}, p AS (SELECT source AS name, round(avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (label = 1), 6) AS recall, round(avg((prob >= 0.5::DOUBLE)::INTEGER) FILTER (label = 0), 6) AS over_refusal FROM scored GROUP BY source HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.over_refusal <= a.over_refusal AND b.recall >= a.recall AND (b.over_refusal < a.over_refusal OR b.recall > a.recall))"


@query(PARETO)
def j13_pareto(spark, d):
    """Recall against over-refusal by source. Sorted by cost, a point is on the frontier if no earlier one reaches its
    recall: a running maximum instead of comparing all pairs."""
    flag = (F.col("prob") >= 0.5).cast("int")
    rate = lambda y: F.round(F.avg(F.when(F.col("label") == y, flag)), 6)
    p = scored(spark, d).groupBy(F.col("source").alias("name")).agg(rate(1).alias("recall"), rate(0).alias("over_refusal")).where("recall IS NOT NULL AND over_refusal IS NOT NULL")
    best = p.groupBy("over_refusal").agg(F.max("recall").alias("recall"))
    cheaper = F.max("recall").over(Window.orderBy("over_refusal").rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("c", cheaper).where(F.col("c").isNull() | (F.col("c") < F.col("recall"))).drop("c")
    return p.join(decon.bounded_broadcast(front, 100_000), ["over_refusal", "recall"]).select("name", "recall", "over_refusal")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.variant'), json_extract_string(props, '$.page'), 'none') AS picked FROM events")
def j15_fallback_path(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.variant"), F.get_json_object("props", "$.page"), F.lit("none")).alias("picked"))


@query("SELECT src, count(*) AS n, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM (SELECT 'a' AS src, toxic FROM labels WHERE quality = 1 UNION ALL SELECT 'b', toxic FROM labels WHERE quality = 0) GROUP BY src")
def d01_union_counts(spark, d):
    t = table(spark, d, "labels")
    u = t.where("quality = 1").select(F.lit("a").alias("src"), "toxic").unionByName(t.where("quality = 0").select(F.lit("b").alias("src"), "toxic"))
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("toxic") == 1).alias("pos"), count_if(F.col("toxic") == 0).alias("neg"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def d02_dedupe_first(spark, d):
    return splits.first_per_key(docs(spark, d).select("doc_id", "text"), F.sha2("text", 256), "doc_id").select("doc_id")


@query("SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def d03_dedupe_composite(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return splits.first_per_key(e, F.struct("user_id", "event_type"), "event_id").select("event_id")


@query(f"SELECT arg_min(label, priority) AS label, count(*) AS n, k FROM (SELECT md5({NORM.format('text')}) AS k, CASE lang WHEN 'en' THEN 0 ELSE 1 END * 1000000000 + doc_id AS priority, lang AS label FROM documents) GROUP BY k")
def d05_priority_dedupe(spark, d):
    p = F.when(F.col("lang") == "en", 0).otherwise(1) * 1000000000 + F.col("doc_id")
    return docs(spark, d).select(F.md5(x.collapse(F.col("text"))).alias("k"), p.alias("p"), "lang").groupBy("k").agg(F.min_by("lang", "p").alias("label"), F.count(F.lit(1)).alias("n"))


@query("SELECT text FROM documents WHERE source = 'src1' INTERSECT SELECT text FROM documents WHERE source = 'src2'")
def d06_intersect(spark, d):
    t = docs(spark, d)
    return t.where("source = 'src1'").select("text").intersect(t.where("source = 'src2'").select("text"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def d07_except(spark, d):
    return docs(spark, d).select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("WITH e AS (SELECT DISTINCT lang, md5(lower(trim(text))) AS k FROM documents WHERE source = 'src4'), t AS (SELECT DISTINCT md5(lower(trim(text))) AS k FROM documents WHERE source <> 'src4') SELECT lang, count(*) AS n_eval, count(t.k) AS n_overlap FROM e LEFT JOIN t USING (k) GROUP BY lang")
def d09_leakage_by_block(spark, d):
    t, key = docs(spark, d), F.md5(F.lower(F.trim("text"))).alias("k")
    e = t.where("source = 'src4'").select("lang", key).distinct()
    train = t.where("source <> 'src4'").select(key).distinct().withColumn("hit", F.lit(1))
    return e.join(train, "k", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_eval"), F.count("hit").alias("n_overlap"))


@query(f"WITH {HITS}, n AS (SELECT doc_id, md5({NORM.format('text')}) AS q FROM documents), f AS (SELECT q, min(doc_id) AS first FROM n GROUP BY q), x AS (SELECT DISTINCT md5({NORM.format('text')}) AS q FROM benchmark) SELECT n.doc_id, CASE WHEN n.doc_id <> f.first THEN 'duplicate' WHEN x.q IS NOT NULL THEN 'exact' WHEN hit.k IS NOT NULL THEN 'ngram' ELSE 'kept' END AS reason FROM n JOIN f USING (q) LEFT JOIN x USING (q) LEFT JOIN hit ON hit.k = n.doc_id")
def d11_ngram_decontamination(spark, d):
    return decon.decontaminate(docs(spark, d), table(spark, d, "benchmark"))


@query(f"""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role),
v AS (SELECT conv_id, string_agg(role || ':' || lpad(n::VARCHAR, 12, '0'), ',' ORDER BY role || ':' || lpad(n::VARCHAR, 12, '0')) AS v FROM c GROUP BY conv_id),
i AS (SELECT conv_id, (row_number() OVER (ORDER BY v, {HASH32.format("conv_id")}, conv_id) - 1) * {splits.GOLDEN}::DOUBLE AS x FROM v)
SELECT conv_id, turn, role, CASE WHEN x - floor(x) < 0.7::DOUBLE THEN 'train' WHEN x - floor(x) < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM conversations JOIN i USING (conv_id)""")
def d12_group_split(spark, d):
    """Conversations whole to one split each, roles in equal shares."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return splits.group_split(t, F.col("conv_id"), "role").select("conv_id", "turn", "role", "split")


@query(f"WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM labels WHERE toxic = 0) SELECT doc_id, rn <= greatest(1, floor(n * 0.2::DOUBLE)) AS held_out FROM b")
def d13_benign_holdout(spark, d):
    """The hold-out is a top-k by hash; the rest follows by an outer join, not by a global window."""
    b = table(spark, d, "labels").where("toxic = 0").select("doc_id")
    n = max(1, int(b.count() * 0.2))
    held = splits.sample(b, "doc_id", n).withColumn("h", F.lit(True))
    return b.join(held, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit(False)).alias("held_out"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(text || source), 32, 1))::INTEGER % 2 = 0 THEN 'a' ELSE 'b' END AS half FROM documents")
def d15_hash_parity(spark, d):
    h = F.conv(F.substring(F.md5(F.concat("text", "source")), 32, 1), 16, 10).cast("int")
    return docs(spark, d).select("doc_id", F.when(h % 2 == 0, "a").otherwise("b").alias("half"))


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) SELECT doc_id, CASE WHEN rn <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r")
def d16_stratified_split(spark, d):
    r = splits.ranked(docs(spark, d).select("doc_id", "source", "lang"), "doc_id", "source", "lang")
    return r.select("doc_id", F.when(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1)), "val").otherwise("train").alias("split"))


@query("SELECT f.lang AS fold, d.doc_id, d.lang = f.lang AS is_test FROM documents d, (SELECT DISTINCT lang FROM documents) f")
def d18_lodo_folds(spark, d):
    """Leave one language out: every row in every fold. The folds are a dimension of checked size."""
    t = docs(spark, d).select("doc_id", "lang")
    folds = decon.bounded_broadcast(t.select(F.col("lang").alias("fold")).distinct(), 1000)
    return t.crossJoin(folds).select("fold", "doc_id", (F.col("lang") == F.col("fold")).alias("is_test"))


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 5 THEN 'train' WHEN rn <= greatest(3, n - floor(n * 0.8::DOUBLE)) THEN 'held_out' ELSE 'train' END AS part FROM r")
def d24_small_source_rule(spark, d):
    r = splits.ranked(docs(spark, d).select("doc_id", "source"), "doc_id", "source")
    held = F.col("_rn") <= F.greatest(F.lit(3), F.col("_n") - F.floor(F.col("_n") * 0.8))
    return r.select("doc_id", F.when(F.col("_n") <= 5, "train").when(held, "held_out").otherwise("train").alias("part"))


@query(f"SELECT source, count(*) AS total, count(*) FILTER (toxic = 1) AS harmful, count(*) FILTER (b.k IS NULL) AS new FROM (SELECT d.*, l.toxic, md5({NORM.format('text')}) AS k FROM documents d LEFT JOIN labels l USING (doc_id)) a LEFT JOIN (SELECT DISTINCT md5({NORM.format('text')}) AS k FROM documents WHERE source = 'src1') b USING (k) GROUP BY source")
def d23_harvest(spark, d):
    key = F.md5(x.collapse(F.col("text"))).alias("k")
    t = docs(spark, d)
    seen = t.where("source = 'src1'").select(key).distinct().withColumn("seen", F.lit(1))
    j = t.select("doc_id", "source", key).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").join(seen, "k", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("toxic") == 1).alias("harmful"), count_if(F.col("seen").isNull()).alias("new"))


@query(f"SELECT doc_id FROM documents ORDER BY {HASH32.format('doc_id')}, doc_id LIMIT 100")
def t07_random_sample(spark, d):
    return splits.sample(docs(spark, d).select("doc_id"), "doc_id", 100)


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id FROM r WHERE rn <= greatest(1, floor(n * 0.1::DOUBLE + 0.5::DOUBLE))")
def t08_stratified_sample(spark, d):
    return splits.per_stratum(docs(spark, d).select("doc_id", "source"), "doc_id", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1 + 0.5)), "source").select("doc_id")


@query(f"WITH q(source, quota) AS (VALUES ('src0', 7), ('src1', 3), ('src2', 5)), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id FROM r JOIN q USING (source) WHERE rn <= quota")
def t09_quotas(spark, d):
    q = F.when(F.col("source") == "src0", 7).when(F.col("source") == "src1", 3).when(F.col("source") == "src2", 5).otherwise(0)
    return splits.per_stratum(docs(spark, d).select("doc_id", "source"), "doc_id", q, "source").select("doc_id")


@query()
def t10_water_filling(spark, d):
    """Small categories first, each getting an even share of what is left, at most a cap. The quotas are a recurrence
    over category counts."""
    t = docs(spark, d).select("doc_id", "lang")
    left, quotas = 200, {}
    counts = sorted((r["count"], r["lang"]) for r in t.groupBy("lang").count().collect())
    for i, (n, lang) in enumerate(counts):
        quotas[lang] = min(n, 80, left // (len(counts) - i))
        left -= quotas[lang]
    q = F.lit(0)
    for lang, k in quotas.items():
        q = F.when(F.col("lang") == lang, k).otherwise(q)
    return splits.per_stratum(t, "doc_id", q, "lang").select("doc_id", "lang")


@query(f"WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id FROM r JOIN s USING (source) WHERE rn <= floor(105 / k) + (CASE WHEN idx < 105 % k THEN 1 ELSE 0 END)")
def t11_equal_quota(spark, d):
    t = docs(spark, d).select("doc_id", "source")
    s = t.select("source").distinct()
    s = s.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("idx")).crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("k"))))
    r = splits.ranked(t, "doc_id", "source").join(decon.bounded_broadcast(s, 100_000), "source")
    return r.where(F.col("_rn") <= F.floor(105 / F.col("k")) + F.when(F.col("idx") < 105 % F.col("k"), 1).otherwise(0)).select("doc_id")


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, toxic ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn FROM documents JOIN labels USING (doc_id)) SELECT doc_id FROM r WHERE rn <= 5")
def t12_k_per_cell(spark, d):
    t = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return splits.per_stratum(t, "doc_id", F.lit(5), "source", "toxic").select("doc_id")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey FROM r WHERE rn <= 2")
def t13_head_per_source(spark, d):
    return readers.rank_in_file(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 2).select("o_orderkey")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), 2")
def t15_custom_sort(spark, d):
    order = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.array_position(order, F.col("o_orderpriority")), "o_orderstatus")


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE i % 3 = 0 AND i < 9")
def w08_stride_sample(spark, d):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", i.alias("i")).where("i % 3 = 0 AND i < 9").select("o_custkey", "o_orderkey")


@query("SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 2 = 0 THEN 'a' ELSE 'b' END AS half FROM labels")
def w09_alternate_split(spark, d):
    t = splits.numbered(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")
    return t.select("doc_id", F.when((F.col("_rn") - 1) % 2 == 0, "a").otherwise("b").alias("half"))


@query("SELECT source, doc_id, nth FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)")
def w06_ith_element(spark, d):
    return splits.numbered(docs(spark, d).select("source", "doc_id"), "doc_id", "source").select("source", "doc_id", F.col("_rn").alias("nth"))


@query("WITH p AS (SELECT n_nationkey * 1000000 + item_id AS key, n_name, item_id, '[' || n_name || '] ' || text AS prompt FROM nation, benchmark), f AS (SELECT min(key) AS key FROM p GROUP BY " + NORM.format("prompt") + f") SELECT n_name, item_id, prompt FROM p JOIN f USING (key) WHERE " + NORM.format("prompt") + " NOT IN (SELECT " + NORM.format("text") + f" FROM benchmark) ORDER BY {HASH32.format('key')}, key LIMIT 500")
def g02_template_product(spark, d):
    """Frames x topics, the first of each normalised prompt, without those that equal a benchmark item, shuffled by hash
    and capped. The frames are a dimension of checked size."""
    frames = decon.bounded_broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"), 10_000)
    p = table(spark, d, "benchmark").select("item_id", "text").crossJoin(frames)
    p = p.select((F.col("n_nationkey") * 1000000 + F.col("item_id")).alias("key"), "n_name", "item_id", F.concat(F.lit("["), "n_name", F.lit("] "), "text").alias("prompt"))
    p = p.withColumn("k", F.md5(x.collapse(F.col("prompt"))))
    first = splits.first_per_key(p, F.col("k"), "key")
    taken = table(spark, d, "benchmark").select(F.md5(x.collapse(F.col("text"))).alias("k")).distinct()
    return splits.sample(first.join(taken, "k", "left_anti"), "key", 500).select("n_name", "item_id", "prompt")


@query("SELECT doc_id, style FROM (SELECT doc_id, ['formal', 'casual', 'terse'][(row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1] AS style FROM labels WHERE toxic = 1)")
def g01_round_robin(spark, d):
    styles = F.array(*map(F.lit, ["formal", "casual", "terse"]))
    t = splits.numbered(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return t.select("doc_id", F.element_at(styles, ((F.col("_rn") - 1) % 3 + 1).cast("int")).alias("style"))


@query()
def m01_bow_predictability(spark, d):
    t = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    p = ml.out_of_fold(ml.bag_of_words(t, "text"), "doc_id", "features", "label")
    return p.select("doc_id", F.round("p", 6).alias("p_unsafe"), (F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")) > 0.9).alias("trivial"))


@query("WITH p AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), g AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM p GROUP BY label, i), a AS (SELECT label, max(n) AS n, sum(s * s) AS ss, sum(q) AS qq FROM g GROUP BY label), t AS (SELECT sum(s * s) AS ss FROM (SELECT i, sum(s) AS s FROM g GROUP BY i)), m AS (SELECT label, n, ss, qq, sum(n) OVER () AS total, sum(ss) OVER () AS inside FROM a) SELECT label, n, round((ss - qq) / nullif(n * (n - 1), 0), 6) AS positive, (SELECT round((t.ss - max(inside)) / nullif(sum(n * (total - n)), 0), 6) FROM m, t GROUP BY t.ss) AS negative FROM m")
def m06_group_contrast(spark, d):
    """Mean dot product of all pairs within a group, and of all pairs across groups, over whole vectors. Sums of
    vectors give both, so no pair is formed: the pairs of a group add up to |sum|^2 less the squares of its members."""
    return ml.group_contrast(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS flagged FROM events GROUP BY 1")
def st_tumbling_rate(spark, d):
    """Extension: the table form of the windowed stream."""
    w = streams.rate_windows(table(spark, d, "events"), F.col("event_type") == "purchase")
    return w.select(F.col("w.start").alias("start"), "n", "flagged")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def st_sessions(spark, d):
    s = streams.sessions(table(spark, d, "events"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


QUERIES, SQL = query.queries, query.sql
