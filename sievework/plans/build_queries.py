"""Queries D04-D26, J07, J12, J14, F05, F20, S11, T01, T06, T14, W01-W03, A23, X02-X25: dataset builds and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import builds, splits
from ..operators import metrics as m
from ._base import HASH32, NORM, SCORED, Plan, scored, table

query = Plan()
count_if = lambda c: F.count(F.when(c, 1))
sha = lambda c: F.sha2(c, 256)


def docs(spark, d):
    return table(spark, d, "documents")


def labelled(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id")


@query(f"WITH loaded AS (SELECT DISTINCT lang, md5({NORM.format('text')}) AS k FROM documents WHERE source = 'src1'), n AS (SELECT doc_id, lang, md5({NORM.format('text')}) AS k FROM documents WHERE source <> 'src1') SELECT min(doc_id) AS doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM loaded l WHERE l.lang = n.lang AND l.k = n.k) GROUP BY lang, k")
def d04_new_against_loaded(spark, d):
    t = docs(spark, d).select("doc_id", "lang", "source", F.md5(x.collapse(F.col("text"))).alias("k"))
    return builds.new_against(t.where("source <> 'src1'"), t.where("source = 'src1'"), ["lang", "k"], "doc_id").select("doc_id")


@query("WITH e AS (SELECT DISTINCT source AS eval_set, lang AS block, text FROM documents WHERE source IN ('src2', 'src3')), t AS (SELECT DISTINCT text FROM documents WHERE source NOT IN ('src2', 'src3')) SELECT eval_set, block, count(*) AS n_eval, count(t.text) AS n_overlap FROM e LEFT JOIN t USING (text) GROUP BY eval_set, block")
def d08_exact_audit(spark, d):
    t = docs(spark, d).select("source", "lang", sha(F.col("text")).alias("k"))
    e = t.where("source IN ('src2', 'src3')").select(F.col("source").alias("eval_set"), F.col("lang").alias("block"), "k").distinct()
    train = t.where("source NOT IN ('src2', 'src3')").select("k").distinct().withColumn("hit", F.lit(1))
    return e.join(train, "k", "left").groupBy("eval_set", "block").agg(F.count(F.lit(1)).alias("n_eval"), F.count("hit").alias("n_overlap"))


@query(f"WITH n AS (SELECT source, {NORM.format('text')} AS t FROM documents), e AS (SELECT DISTINCT source, t FROM n WHERE source <> 'src1'), a AS (SELECT DISTINCT t FROM n WHERE source = 'src1'), p AS (SELECT DISTINCT substr(t, 1, 64) AS t FROM a) SELECT source, count(*) AS n, count(a.t) AS n_exact, count(p.t) AS n_prefix, count(a.t) > 0 OR count(p.t) > 0.02::DOUBLE * count(*) AS flagged FROM e LEFT JOIN a ON a.t = e.t LEFT JOIN p ON p.t = substr(e.t, 1, 64) GROUP BY source")
def d10_prefix_audit(spark, d):
    n = docs(spark, d).select("source", x.collapse(F.col("text")).alias("t"))
    keys = n.select("source", sha(F.col("t")).alias("k"), sha(F.substring("t", 1, 64)).alias("p"))
    e, a = keys.where("source <> 'src1'").distinct(), keys.where("source = 'src1'")
    exact, prefix = (a.select(c).distinct().withColumn(f"in_{c}", F.lit(1)) for c in ("k", "p"))
    j = e.join(exact, "k", "left").join(prefix, "p", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("in_k").alias("n_exact"), F.count("in_p").alias("n_prefix"))
    return j.withColumn("flagged", (F.col("n_exact") > 0) | (F.col("n_prefix") > 0.02 * F.col("n")))


@query(f"WITH q AS (SELECT DISTINCT md5({NORM.format('text')}) AS k FROM documents), r AS (SELECT k, row_number() OVER (ORDER BY {HASH32.format('k')}, k) AS rn, count(*) OVER () AS n FROM q) SELECT doc_id, CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT doc_id, md5({NORM.format('text')}) AS k FROM documents) JOIN r USING (k)")
def d14_query_split(spark, d):
    """All rows of one normalised query fall to one side."""
    t = docs(spark, d).select("doc_id", F.md5(x.collapse(F.col("text"))).alias("k"))
    r = splits.ranked(t.select("k").distinct(), "k").select("k", F.when(F.col("_rn") <= F.floor(F.col("_n") * 0.9), "train").otherwise("val").alias("split"))
    return t.join(r, "k").select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN source = 'src8' THEN 'ood_fpr' WHEN source = 'src9' THEN 'ood_fnr' ELSE 'train' END AS bucket FROM documents JOIN labels USING (doc_id) WHERE NOT (source = 'src8' AND toxic = 1) AND NOT (source = 'src9' AND toxic = 0)")
def d17_source_ood_split(spark, d):
    """Whole sources leave the training data: one keeps its negatives, for false alarms, one its positives, for misses."""
    t = labelled(spark, d).where(~((F.col("source") == "src8") & (F.col("toxic") == 1)) & ~((F.col("source") == "src9") & (F.col("toxic") == 0)))
    return t.select("doc_id", F.when(F.col("source") == "src8", "ood_fpr").when(F.col("source") == "src9", "ood_fnr").otherwise("train").alias("bucket"))


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id, source, CASE WHEN rn <= 20 THEN 'train' ELSE 'held_out' END AS part FROM r")
def d19_sample_and_remainder(spark, d):
    r = splits.ranked(docs(spark, d).select("doc_id", "source"), "doc_id", "source")
    return r.select("doc_id", "source", F.when(F.col("_rn") <= 20, "train").otherwise("held_out").alias("part"))


PREPARED = f"""l AS (SELECT doc_id, md5({NORM.format("text")}) AS base, toxic AS label, coalesce(source, '') || ' [SEP] ' || coalesce(text, '') AS text FROM documents JOIN labels USING (doc_id)),
h AS (SELECT base, row_number() OVER (ORDER BY {HASH32.format("base")}, base) AS rn, count(*) OVER () AS n FROM (SELECT base FROM l GROUP BY base HAVING max(label) = 0)),
o AS (SELECT base FROM h WHERE rn <= greatest(1, floor(n * 0.2::DOUBLE))),
c AS (SELECT base, label::VARCHAR || ':' || lpad(count(*)::VARCHAR, 12, '0') AS c FROM l WHERE base NOT IN (SELECT base FROM o) GROUP BY base, label),
v AS (SELECT base, string_agg(c, ',' ORDER BY c) AS v FROM c GROUP BY base),
i AS (SELECT base, (row_number() OVER (ORDER BY v, {HASH32.format("base")}, base) - 1) * {splits.GOLDEN}::DOUBLE AS x FROM v),
s AS (SELECT doc_id, label, text, CASE WHEN x IS NULL THEN 'held_out' WHEN x - floor(x) < 0.7::DOUBLE THEN 'train' WHEN x - floor(x) < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM l LEFT JOIN i USING (base))"""


def prepared(spark, d):
    """Labelled documents; copies of one text (in normal form) are one base."""
    t = labelled(spark, d).select("doc_id", F.md5(x.collapse(F.col("text"))).alias("base"), F.col("toxic").alias("label"), "source", "text")
    return builds.formatted(builds.prepare(t, "base"), "source", "text")


@query(f"WITH {PREPARED}, n AS (SELECT split, label, count(*) AS n FROM s GROUP BY split, label), w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE) AS weight FROM s WHERE split = 'train' GROUP BY label) SELECT split, label, n, round(weight, 6) AS weight FROM n JOIN w USING (label)")
def d20_prepare_data(spark, d):
    """Hold-out of clean bases, the rest split by base, class weights of the training part: the summary."""
    return builds.summary(prepared(spark, d))


@query(f"WITH {PREPARED} SELECT doc_id, label, split, md5(text) AS digest FROM s")
def d20_prepared_rows(spark, d):
    return prepared(spark, d).select("doc_id", "label", "split", F.md5("text").alias("digest"))


BLOCKS = f"""b1 AS (SELECT 'b1_keyword' AS block, doc_id AS id, text, 0 AS label FROM documents WHERE contains(lower(text), 'license') ORDER BY {HASH32.format('doc_id')}, doc_id LIMIT 30),
b2 AS (SELECT 'b2_variants' AS block, item_id AS id, text || s AS text, y AS label FROM benchmark, (VALUES (' No.', 0), (' Yes.', 1)) v(s, y)),
b3 AS (SELECT 'b3_turns' AS block, min(conv_id) AS id, text, 0 AS label FROM conversations WHERE role = 'user' GROUP BY text ORDER BY id, text LIMIT 50),
b4 AS (SELECT 'b4_toxic' AS block, doc_id AS id, text, 1 AS label FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 ORDER BY {HASH32.format('doc_id')}, doc_id LIMIT 40),
u AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4)"""


@query(f"WITH {BLOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY {NORM.format('text')} ORDER BY block, label, id, text) AS rn FROM u) SELECT coalesce(block, 'total') AS block, count(*) AS n, count(*) FILTER (label = 1) AS n_positive FROM f WHERE rn = 1 GROUP BY GROUPING SETS ((block), ())")
def d21_augmentation_blocks(spark, d):
    """Four capped blocks, the first of equal texts kept, with a manifest of the blocks and the total."""
    t = docs(spark, d)
    block = lambda df, name, key, label: df.select(F.lit(name).alias("block"), F.col(key).alias("id"), "text", F.lit(label).alias("label"))
    b1 = splits.sample(t.where(x.keyword_any(F.col("text"), ["license"])).select("doc_id", "text"), "doc_id", 30)
    b2 = table(spark, d, "benchmark").select("item_id", "text", F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(y).alias("label")) for s, y in ((" No.", 0), (" Yes.", 1))])))
    b3 = table(spark, d, "conversations").where("role = 'user'").groupBy("text").agg(F.min("conv_id").alias("conv_id")).orderBy("conv_id", "text").limit(50)
    b4 = splits.sample(labelled(spark, d).where("toxic = 1").select("doc_id", "text"), "doc_id", 40)
    u = block(b1, "b1_keyword", "doc_id", 0).unionByName(b2.select(F.lit("b2_variants").alias("block"), F.col("item_id").alias("id"), F.concat("text", "s").alias("text"), "label"))
    u = u.unionByName(block(b3, "b3_turns", "conv_id", 0)).unionByName(block(b4, "b4_toxic", "doc_id", 1))
    first = splits.first_per_key(u, F.md5(x.collapse(F.col("text"))), "block", "label", "id", "text")
    counts = [F.count(F.lit(1)).alias("n"), count_if(F.col("label") == 1).alias("n_positive")]
    return first.groupingSets([["block"], []], "block").agg(*counts).select(F.coalesce("block", F.lit("total")).alias("block"), "n", "n_positive")


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH32.format('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'use' ELSE 'locked' END AS part FROM r")
def d22_fractional_partition(spark, d):
    r = splits.ranked(docs(spark, d).select("doc_id"), "doc_id")
    return r.select("doc_id", F.when(F.col("_rn") <= F.floor(F.col("_n") * 0.7), "use").otherwise("locked").alias("part"))


POOL = f"""u AS (SELECT 0 AS priority, doc_id AS id, text, 'positive' AS role FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
 UNION ALL SELECT 1, item_id, text, 'hard_negative' FROM benchmark UNION ALL SELECT 2, conv_id * 1000 + turn, text, 'easy_negative' FROM conversations),
f AS (SELECT role, id, k FROM (SELECT *, md5({NORM.format('text')}) AS k, row_number() OVER (PARTITION BY md5({NORM.format('text')}) ORDER BY priority, id) AS rn FROM u WHERE length(trim(text)) >= 8) WHERE rn = 1),
r AS (SELECT role, id, k, row_number() OVER (PARTITION BY role ORDER BY {HASH32.format('id')}, id) AS rn, count(*) OVER (PARTITION BY role) AS n FROM f)"""


@query(f"WITH {POOL} SELECT role, id, CASE WHEN role = 'positive' AND rn > floor(n * 0.8::DOUBLE) THEN 'selectivity' ELSE 'train' END AS part FROM r WHERE role <> 'easy_negative' OR rn <= 100")
def d25_pool(spark, d):
    """Several sources by priority, the first of each normalised text, short ones left out; a fifth of the positives is
    held out, easy negatives are capped."""
    pos = labelled(spark, d).where("toxic = 1").select(F.lit(0).alias("priority"), F.col("doc_id").alias("id"), "text", F.lit("positive").alias("role"))
    hard = table(spark, d, "benchmark").select(F.lit(1).alias("priority"), F.col("item_id").alias("id"), "text", F.lit("hard_negative").alias("role"))
    easy = table(spark, d, "conversations").select(F.lit(2).alias("priority"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit("easy_negative").alias("role"))
    u = pos.unionByName(hard).unionByName(easy).where(F.length(F.trim("text")) >= 8)
    first = splits.first_per_key(u.select("priority", "id", "role", F.md5(x.collapse(F.col("text"))).alias("k")), F.col("k"), "priority", "id")
    r = splits.ranked(first, "id", "role").where((F.col("role") != "easy_negative") | (F.col("_rn") <= 100))
    held = (F.col("role") == "positive") & (F.col("_rn") > F.floor(F.col("_n") * 0.8))
    return r.select("role", "id", F.when(held, "selectivity").otherwise("train").alias("part"))


@query(f"WITH n AS (SELECT doc_id, source, lang, toxic, md5({NORM.format('text')}) AS q, contains(lower(text), 'the') AS topic FROM documents JOIN labels USING (doc_id)), seen AS (SELECT DISTINCT q FROM n WHERE source = 'src1') SELECT min(doc_id) AS doc_id, q AS qhash, min_by(toxic, doc_id) AS label FROM n WHERE source <> 'src1' AND topic AND q NOT IN (SELECT q FROM seen) GROUP BY q")
def d26_clean_eval(spark, d):
    """Labelled rows on the topic, without those whose query was seen, one per query."""
    n = labelled(spark, d).select("doc_id", "source", "toxic", F.md5(x.collapse(F.col("text"))).alias("q"), x.keyword_any(F.col("text"), ["the"]).alias("topic"))
    fresh = builds.new_against(n.where("source <> 'src1' AND topic"), n.where("source = 'src1'"), ["q"], "doc_id")
    return fresh.select("doc_id", F.col("q").alias("qhash"), F.col("toxic").alias("label"))


@query("SELECT item_id, p AS perturbation, sha256(CASE p WHEN 'upper' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 'leet' THEN translate(text, 'aeiost', '431057') ELSE replace(text, ' ', '  ') END) AS digest FROM benchmark, (VALUES ('upper'), ('leet'), ('double_space')) v(p)")
def j12_perturbation_cross(spark, d):
    t = F.col("text")
    made = {"upper": F.translate(t, x.LOWER, x.UPPER), "leet": x.leet(t), "double_space": F.replace(t, F.lit(" "), F.lit("  "))}
    return table(spark, d, "benchmark").select("item_id", F.inline(F.array(*[F.struct(F.lit(k).alias("perturbation"), sha(v).alias("digest")) for k, v in made.items()])))


@query(f"WITH {SCORED}, pre AS (SELECT source AS name, round(avg((prob >= 0.5::DOUBLE)::INTEGER), 6) AS pre FROM scored GROUP BY source), post AS (SELECT source AS name, round(avg((prob_b >= 0.5::DOUBLE)::INTEGER), 6) AS post FROM scored WHERE source <> 'src0' GROUP BY source) SELECT name, pre, post, round(post - pre, 6) AS delta FROM pre JOIN post USING (name)")
def j14_pre_post(spark, d):
    """Named results before and after; a name that one side lacks is passed over."""
    s = scored(spark, d)
    rate = lambda df, c, out: df.groupBy(F.col("source").alias("name")).agg(F.round(F.avg((F.col(c) >= 0.5).cast("int")), 6).alias(out))
    return rate(s, "prob", "pre").join(rate(s.where("source <> 'src0'"), "prob_b", "post"), "name").withColumn("delta", F.round(F.col("post") - F.col("pre"), 6))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(lang || ' ' || source), 'src3')")
def f05_text_or_subcategory(spark, d):
    return docs(spark, d).where(x.keyword_any(F.col("text"), ["license"]) | x.keyword_any(F.array_join(F.array("lang", "source"), " "), ["src3"])).select("doc_id")


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'stor') AS in_context FROM documents")
def f20_context(spark, d):
    return docs(spark, d).select("doc_id", x.keyword_any(F.col("text"), ["license", "stor"]).alias("in_context"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3")
def t01_top_counts(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def t06_cap(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(50)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {HASH32.format('doc_id')}, doc_id) AS place FROM documents")
def t14_seeded_shuffle(spark, d):
    return splits.ranked(docs(spark, d).select("doc_id"), "doc_id").select("doc_id", F.col("_rn").alias("place"))


@query(f"WITH {SCORED} SELECT DISTINCT prob, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp FROM scored WINDOW w AS (ORDER BY prob DESC)")
def w01_cumulative(spark, d):
    return m.curve(scored(spark, d)).select("prob", "tp", "fp")


@query(f"WITH {SCORED} SELECT item_id, (min(rn) OVER (PARTITION BY prob) + max(rn) OVER (PARTITION BY prob)) / 2.0::DOUBLE AS rank FROM (SELECT item_id, prob, row_number() OVER (ORDER BY prob) AS rn FROM scored)")
def w02_average_ranks(spark, d):
    return m.average_ranks(scored(spark, d).select("item_id", "prob"), "prob", "rank").select("item_id", "rank")


@query(f"WITH {SCORED}, c AS (SELECT source, sum((prob >= 0.5::DOUBLE)::INTEGER)::DOUBLE AS k, count(*)::DOUBLE AS n FROM scored GROUP BY source), w AS (SELECT source, k / n AS p, n, 1.959964::DOUBLE AS z FROM c) SELECT source, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS high FROM w")
def a23_wilson(spark, d):
    c = scored(spark, d).groupBy("source").agg(count_if(F.col("prob") >= 0.5).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = m.wilson(F.col("k"), F.col("n"))
    return c.select("source", low.alias("low"), high.alias("high"))


LOOKALIKES = "translate({0}, 'аеорсхіѕӏ', 'aeorcxisl')"


@query("SELECT doc_id, sha256(text) AS digest FROM (SELECT doc_id, " + LOOKALIKES.format("translate(text, 'aeorcxisl', 'аеорсхіѕӏ')") + " AS text FROM documents)")
def x02_homoglyphs(spark, d):
    """Latin letters spelt with look-alikes come back."""
    return docs(spark, d).select("doc_id", sha(x.fold_homoglyphs(F.translate("text", x.HOMOGLYPHS[1], x.HOMOGLYPHS[0]))).alias("digest"))


@query(r"SELECT conv_id, turn, length(text) >= 3 AND length(text) - len(regexp_extract_all(text, '[\p{C}\x{FFFD}]')) >= length(text) * 0.85::DOUBLE AS plausible FROM conversations")
def x03_plausible(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", x.plausible(F.col("text")).alias("plausible"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]{2,}'), lambda w: list_contains([" + ", ".join(f"'{w}'" for w in x.ENGLISH) + "], w)))::INTEGER AS markers FROM documents")
def x04_english_score(spark, d):
    return docs(spark, d).select("doc_id", x.english_score(F.col("text")).alias("markers"))


@query("SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def x09_backspaces(spark, d):
    """Each character typed wrong, then erased, and a run of twelve at once."""
    typed = F.concat(F.regexp_replace("text", "([a-z])", "#\b$1"), F.repeat(F.lit("q"), F.lit(12)), F.repeat(F.lit("\b"), F.lit(12)))
    return table(spark, d, "conversations").select("conv_id", "turn", sha(x.erase_backspaces(typed)).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM (SELECT doc_id, nfc_normalize(regexp_replace(text, '[\\p{Mn}\\p{Mc}]', '', 'g')) AS text FROM documents)")
def x10_x11_marks_and_form(spark, d):
    """Standalone marks put after every letter go again; what is left is in normal form C."""
    t = docs(spark, d).select("doc_id", F.regexp_replace("text", "([a-z])", "$1̕").alias("text"))
    for step in (x.strip_marks, x.normal_form("NFC")):
        t = t.withColumn("text", step(F.col("text")))
    return t.select("doc_id", sha(F.col("text")).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z]', '  ', 'g') || ' ', ' (the license|license|the) ')) AS n FROM documents")
def x18_terms(spark, d):
    return docs(spark, d).select("doc_id", F.size(x.terms(F.col("text"), ["the", "license"])).cast("long").alias("n"))


@query()
def x14_undo_evasion(spark, d):
    """Texts spelt with signs for letters and, every third word, letter by letter, through the evasion normaliser."""
    spaced = F.transform(F.split("text", " "), lambda w, i: F.when(i % 3 == 0, F.array_join(F.split(w, ""), " ")).otherwise(F.translate(w, "aeio", "@31\u200b0")))
    t = docs(spark, d).select("doc_id", F.array_join(spaced, " ").alias("text"))
    return x.undo_evasion_columns(t, "text").select("doc_id", sha(F.col("text")).alias("digest"))


FAMILIES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"https?://[^\s)>\]]+", "path": r"/(?:home|Users|tmp)/[A-Za-z0-9_./-]+", "phone": r"\+[0-9][0-9 ().-]{8,}[0-9]", "token": "token = \"[0-9a-f]+\"", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"}


@query("SELECT f.family, count(*) FILTER (n > 0) AS n_texts, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS family, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in FAMILIES.items()) + ") f GROUP BY f.family")
def x25_pattern_families(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    rows = docs(spark, d).select(F.inline(F.array(*[F.struct(F.lit(k).alias("family"), n(p).alias("n")) for k, p in FAMILIES.items()])))
    return rows.groupBy("family").agg(count_if(F.col("n") > 0).alias("n_texts"), F.sum("n").alias("n"))


@query()
def x13_pair_normalize(spark, d):
    """A turn and the one that answers it, normalised alike; a turn without an answer keeps a null one."""
    t = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("prompt"))
    reply = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("prompt").alias("response"))
    pairs = x.normalize_columns(t.join(reply, ["conv_id", "turn"], "left"), "prompt", "response")
    return pairs.select("conv_id", "turn", sha(F.col("prompt")).alias("prompt"), sha(F.col("response")).alias("response"))


@query()
def x15_release_normalize(spark, d):
    return docs(spark, d).select("doc_id", sha(x.release_normalize(F.col("text"))).alias("digest"))


QUERIES, SQL = query.queries, query.sql
