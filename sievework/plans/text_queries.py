"""Queries F*, X*, W11-W13, P*: filters, text functions, decoding, redaction, perturbation round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import edits, roundtrip
from ._base import NORM, SCORED, Plan, scored, table

query = Plan()
TERMS = ["the", "and", "que", "der"]
count_if = lambda c: F.count(F.when(c, 1))


def docs(spark, d):
    return table(spark, d, "documents")


def sha(c):
    return F.sha2(c, 256)


@query("SELECT doc_id, lang || ' [SEP] ' || source AS text, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS label FROM documents")
def f01_project(spark, d):
    return docs(spark, d).select("doc_id", F.concat_ws(" [SEP] ", "lang", "source").alias("text"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))


@query("SELECT doc_id, lang AS query, source AS response FROM documents")
def f02_inverse_parse(spark, d):
    parts = F.split("text", r" \[SEP\] ", 2)
    return f01_project(spark, d).select("doc_id", F.trim(parts[0]).alias("query"), F.trim(parts[1]).alias("response"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), '')) AS title FROM pages")
def f03_coalesce_fields(spark, d):
    return table(spark, d, "pages").select("page_id", x.first_filled(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url")).alias("title"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'license')")
def f04_keyword_filter(spark, d):
    return docs(spark, d).where(x.keyword_any(F.col("text"), ["worthless", "license"])).select("doc_id")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'category' ELSE 'keyword' END AS reason FROM documents WHERE source IN ('src1', 'src2') OR contains(lower(text), 'license')")
def f06_category_or_keyword(spark, d):
    cat, kw = F.col("source").isin("src1", "src2"), x.keyword_any(F.col("text"), ["license"])
    return docs(spark, d).where(cat | kw).select("doc_id", F.when(cat, "category").otherwise("keyword").alias("reason"))


@query("SELECT doc_id, m.class FROM documents JOIN (VALUES ('src1', 'x'), ('src2', 'y'), ('src3', 'x')) m(source, class) USING (source)")
def f07_strict_category(spark, d):
    return docs(spark, d).withColumn("class", F.when(F.col("source").isin("src1", "src3"), "x").when(F.col("source") == "src2", "y")).where("class IS NOT NULL").select("doc_id", "class")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'license')")
def f08_exclusion_filter(spark, d):
    t = F.col("text")
    return docs(spark, d).where(x.keyword_any(t, ["the"]) & ~x.keyword_any(t, ["license"])).select("doc_id")


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), 'license') THEN 'license' WHEN regexp_matches(text, '[0-9]') THEN 'digits' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE 'other' END AS bucket FROM documents) GROUP BY bucket")
def f09_bucket_regex(spark, d):
    t = F.col("text")
    b = F.when(F.lower(t).rlike("license"), "license").when(t.rlike("[0-9]"), "digits").when(t.rlike("[|]"), "table").otherwise("other")
    return docs(spark, d).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'legitimate' WHEN o_orderpriority IN ('5-LOW') THEN 'negative' ELSE 'ambiguous' END AS label FROM orders")
def f10_value_map(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.when(p.isin("1-URGENT", "2-HIGH"), "legitimate").when(p.isin("5-LOW"), "negative").otherwise("ambiguous").alias("label"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN CASE WHEN lang = 'en' THEN 'ood_fpr' ELSE 'ood_fnr' END ELSE 'train' END AS bucket FROM documents")
def f11_route_split(spark, d):
    return docs(spark, d).select("doc_id", F.when(F.col("source") == "src0", F.when(F.col("lang") == "en", "ood_fpr").otherwise("ood_fnr")).otherwise("train").alias("bucket"))


@query("SELECT doc_id, (quality = 0)::INTEGER AS strict, (quality = 0 OR toxic = 1)::INTEGER AS broad FROM labels")
def f12_label_strategies(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("strict"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("broad"))


@query("SELECT d.doc_id, CASE WHEN l.toxic IS NOT NULL THEN l.toxic = 1 ELSE coalesce(source = 'src0', false) END AS harmful FROM documents d LEFT JOIN labels l USING (doc_id)")
def f13_multi_schema_predicate(spark, d):
    j = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("toxic").isNotNull(), F.col("toxic") == 1).otherwise(F.coalesce(F.col("source") == "src0", F.lit(False))).alias("harmful"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label FROM conversations WHERE lower(role) IN ('user', 'assistant')")
def f14_native_label(spark, d):
    return table(spark, d, "conversations").where(F.lower("role").isin("user", "assistant")).select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(0).alias("label"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 80 AND NOT regexp_matches(substr(text, 1, 400), '[$%&]')")
def f15_substantive(spark, d):
    return docs(spark, d).where((F.length(F.trim("text")) >= 80) & ~F.substring("text", 1, 400).rlike("[$%&]")).select("doc_id")


@query("SELECT 'duplicate_id' AS check_name, count(*) AS n FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'short_text', count(*) FROM documents WHERE length(text) < 20 UNION ALL SELECT 'bad_source', count(*) FROM documents WHERE NOT regexp_matches(source, '^src[0-9]+$') UNION ALL SELECT 'uncovered_lang', count(*) FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) v(lang) WHERE lang NOT IN (SELECT lang FROM documents)")
def f16_validators(spark, d):
    t = docs(spark, d)
    langs = spark.sql("SELECT * FROM VALUES ('en'), ('fr'), ('de'), ('es'), ('it') AS v(lang)")
    out = [("duplicate_id", t.groupBy("doc_id").count().where("count > 1")), ("short_text", t.where("length(text) < 20")), ("bad_source", t.where("NOT source RLIKE '^src[0-9]+$'")), ("uncovered_lang", langs.join(t.select("lang").distinct(), "lang", "left_anti"))]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in out]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("SELECT severity, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, 'token = ') THEN 'CRITICAL' WHEN regexp_matches(text, '@') THEN 'HIGH' WHEN regexp_matches(text, '[0-9]{6}') THEN 'LOW' ELSE 'NONE' END AS severity FROM documents) GROUP BY severity")
def f17_severity(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("text").rlike("token = "), "SECRETS.token"), F.when(F.col("text").rlike("@"), "PII.email"), F.when(F.col("text").rlike("[0-9]{6}"), "NUMBERS")))
    f = docs(spark, d).select(flags.alias("flags"))
    sev = F.when(F.exists("flags", lambda v: v.startswith("SECRETS.")), "CRITICAL").when(F.exists("flags", lambda v: v.startswith("PII.")), "HIGH").when(F.size("flags") > 0, "LOW").otherwise("NONE")
    return f.groupBy(sev.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, avg(toxic) FILTER (quality = 0) <= 0.5::DOUBLE AS gate_bad, avg(toxic) FILTER (quality = 1) <= 0.2::DOUBLE AS gate_good, coalesce(avg(toxic) FILTER (quality = 0) <= 0.5::DOUBLE, true) AND coalesce(avg(toxic) FILTER (quality = 1) <= 0.2::DOUBLE, true) AND count(*) > 0 AS overall FROM documents JOIN labels USING (doc_id) GROUP BY source")
def f18_gates(spark, d):
    g = docs(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("source").agg((F.avg(F.when(F.col("quality") == 0, F.col("toxic"))) <= 0.5).alias("gate_bad"), (F.avg(F.when(F.col("quality") == 1, F.col("toxic"))) <= 0.2).alias("gate_good"))
    known = F.filter(F.array("gate_bad", "gate_good"), lambda v: v.isNotNull())
    return g.select("source", "gate_bad", "gate_good", ((F.size(known) > 0) & F.forall(known, lambda v: v)).alias("overall"))


def _re(words):
    return "(^|[^a-z])(" + "|".join(words) + ")($|[^a-z])"


@query(f"WITH m AS (SELECT doc_id, regexp_matches(lower(text), '{_re(['idiot'])}') AS u, regexp_matches(lower(text), '{_re(['moron'])}') AS c, regexp_matches(lower(text), '{_re(['stupid'])}') AS s, regexp_matches(lower(text), '{_re(['clown'])}') AS w, regexp_matches(lower(text), '{_re(['the', 'and'])}') AS x FROM documents) SELECT doc_id, CASE WHEN u THEN 1 WHEN c AND (s OR w) THEN 1 WHEN c THEN NULL WHEN s AND x THEN 2 END AS tier, CASE WHEN u THEN true WHEN c AND (s OR w) THEN true WHEN c THEN false WHEN s AND x THEN true ELSE false END AS flag FROM m")
def f19_lexicon_ladder(spark, d):
    t = F.col("text")
    out = docs(spark, d).select("doc_id", x.ladder(x.terms(t, ["idiot"]), x.terms(t, ["moron"]), x.terms(t, ["stupid"]), x.terms(t, ["clown"]), x.terms(t, ["the", "and"])).alias("v"))
    return out.select("doc_id", "v.tier", "v.flag")


@query(f"WITH {SCORED} SELECT item_id, prob >= 0.6::DOUBLE AS prompt_flag, prob_b >= 0.5::DOUBLE AS response_flag, prob >= 0.6::DOUBLE OR prob_b >= 0.5::DOUBLE AS joint_flag, concat_ws('; ', CASE WHEN prob >= 0.6::DOUBLE THEN 'prompt' END, CASE WHEN prob_b >= 0.5::DOUBLE THEN 'response' END) AS joint_reason FROM scored")
def f21_dual_verdict(spark, d):
    a, b = F.col("prob") >= 0.6, F.col("prob_b") >= 0.5
    return scored(spark, d).select("item_id", a.alias("prompt_flag"), b.alias("response_flag"), (a | b).alias("joint_flag"), F.concat_ws("; ", F.when(a, "prompt"), F.when(b, "response")).alias("joint_reason"))


@query(f"WITH {SCORED}, p AS (SELECT label, policy, CASE policy WHEN 'prompt_only' THEN prob >= 0.5::DOUBLE WHEN 'response_only' THEN prob_b >= 0.5::DOUBLE WHEN 'and' THEN prob >= 0.5::DOUBLE AND prob_b >= 0.5::DOUBLE ELSE prob >= 0.5::DOUBLE OR prob_b >= 0.5::DOUBLE END AS flag FROM scored, (VALUES ('prompt_only'), ('response_only'), ('and'), ('or')) v(policy)) SELECT policy, count(*) FILTER (flag AND label = 1) AS tp, count(*) FILTER (flag AND label = 0) AS fp FROM p GROUP BY policy")
def f22_policies(spark, d):
    a, b = F.col("prob") >= 0.5, F.col("prob_b") >= 0.5
    rows = scored(spark, d).select("label", F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("flag")) for k, v in {"prompt_only": a, "response_only": b, "and": a & b, "or": a | b}.items()])))
    return rows.groupBy("policy").agg(count_if(F.col("flag") & (F.col("label") == 1)).alias("tp"), count_if(F.col("flag") & (F.col("label") == 0)).alias("fp"))


@query(f"WITH {SCORED} SELECT route, count(*) AS n, sum(label)::BIGINT AS n_positive FROM (SELECT label, CASE WHEN prob < 0.3::DOUBLE THEN 'pass' WHEN prob > 0.7::DOUBLE THEN 'flag' ELSE 'escalate' END AS route FROM scored) GROUP BY route")
def f23_cascade_route(spark, d):
    r = F.when(F.col("prob") < 0.3, "pass").when(F.col("prob") > 0.7, "flag").otherwise("escalate")
    return scored(spark, d).groupBy(r.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"))


@query(f"WITH {SCORED} SELECT item_id, CASE WHEN source = 'src1' THEN prob >= 0.5::DOUBLE OR prob_b >= 0.5::DOUBLE ELSE prob_b >= 0.5::DOUBLE END AS flag FROM scored")
def f24_metadata_cascade(spark, d):
    a, b = F.col("prob") >= 0.5, F.col("prob_b") >= 0.5
    return scored(spark, d).select("item_id", F.when(F.col("source") == "src1", a | b).otherwise(b).alias("flag"))


ROT_SQL = "translate({0}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')"
SCORE_SQL = "len(list_filter(regexp_extract_all(lower({0}), '[a-z]{{2,}}'), lambda w: list_contains([" + ", ".join(f"'{w}'" for w in x.ENGLISH) + "], w)))"
PLAUSIBLE_SQL = "(length({0}) >= 3 AND length({0}) - len(regexp_extract_all({0}, '[\\p{{C}}\\x{{FFFD}}]')) >= length({0}) * 0.85::DOUBLE)"


@query(f"WITH r AS (SELECT doc_id, text, doc_id % 2 = 1 AS coded, CASE WHEN doc_id % 2 = 1 THEN {ROT_SQL.format('text')} ELSE text END AS given FROM documents), t AS (SELECT *, {ROT_SQL.format('given')} AS turned FROM r), c AS (SELECT *, {PLAUSIBLE_SQL.format('turned')} AND turned <> given AND {SCORE_SQL.format('turned')} > {SCORE_SQL.format('given')} AS fires FROM t) SELECT doc_id, coalesce(fires, false) AS decoded, sha256(CASE WHEN fires THEN turned ELSE given END) AS digest FROM c")
def x05_rot13(spark, d):
    """Every other text comes rotated; the decoder turns back what then reads more like English, and nothing else."""
    given = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 1, x.rot13(F.col("text"))).otherwise(F.col("text")).alias("given"))
    out = given.withColumn("turned", x.decode_rot13(F.col("given")))
    return out.select("doc_id", F.col("turned").isNotNull().alias("decoded"), sha(F.coalesce("turned", "given")).alias("digest"))


CODED_SQL = "SELECT conv_id, turn, sha256(CASE WHEN length(coded) >= 20 AND " + PLAUSIBLE_SQL.format("text") + " THEN text ELSE coded END) AS digest FROM (SELECT conv_id, turn, coalesce(text, '') AS text, {0} AS coded FROM conversations)"


@query(CODED_SQL.replace("{0}", "to_base64(encode(coalesce(text, '')))"))
def x06_base64_roundtrip(spark, d):
    """Base64 of a text decodes to it; what is too short or no plausible text stays encoded."""
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    coded = F.replace(F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    return t.select("conv_id", "turn", sha(F.coalesce(x.decode_base64(coded), coded)).alias("digest"))


@query(CODED_SQL.replace("{0}", "hex(encode(coalesce(text, '')))"))
def x08_hex_roundtrip(spark, d):
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    coded = F.hex(F.encode("text", "UTF-8"))
    return t.select("conv_id", "turn", sha(F.coalesce(x.decode_hex(coded), coded)).alias("digest"))


@query("SELECT conv_id, turn, sha256(CASE WHEN " + PLAUSIBLE_SQL.format("text") + " THEN text ELSE replace(replace(text, '%', '%25'), ' ', '%20') END) AS digest FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def x07_url_roundtrip(spark, d):
    """Blanks and percent signs are escaped; the decoder undoes it where the result is plausible text."""
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    coded = F.replace(F.replace("text", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return t.select("conv_id", "turn", sha(F.coalesce(x.decode_url(coded), coded)).alias("digest"))


@query()
def x12_normalize(spark, d):
    rows = x.normalize_columns(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text")
    return rows.select("conv_id", "turn", sha("text").alias("digest"))


@query(r"SELECT doc_id, sha256(lower(regexp_replace(text, '[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'))) AS digest FROM documents")
def x01_strip_invisible(spark, d):
    """Zero-width spaces put between letters go again."""
    dirty = F.regexp_replace("text", " ", " ​")
    return docs(spark, d).select("doc_id", sha(F.lower(x.strip_invisible(dirty))).alias("digest"))


@query("SELECT doc_id, sha256(" + NORM.format("text") + ") AS digest FROM documents")
def x16_collapse(spark, d):
    return docs(spark, d).select("doc_id", sha(x.collapse(F.col("text"))).alias("digest"))


@query(r"WITH w AS (SELECT doc_id, list_filter(string_split(" + NORM.format("text") + r", ' '), lambda v: v <> '') AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) >= 8 THEN len(list_distinct([array_to_string(ws[i:i+7], ' ') for i in range(1, len(ws) - 6)])) ELSE 0 END AS n_grams FROM w")
def x17_ngrams(spark, d):
    from ..operators.decon import norm_words

    rows = docs(spark, d).select("doc_id", norm_words(F.col("text")).alias("ws"))
    return rows.select("doc_id", F.size(x.ngrams(F.col("ws"), 8)).cast("long").alias("n_grams"))


@query("SELECT doc_id, md5(trim(lower(text))) AS qhash, substr(sha1(text), 1, 16) AS rhash FROM documents")
def x29_hashes(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.trim(F.lower("text"))).alias("qhash"), F.substring(F.sha1("text"), 1, 16).alias("rhash"))


@query("SELECT doc_id, 'doc_' || lang || '_' || substr(sha256(text), 1, 8) AS new_id FROM documents")
def x28_ids(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("doc_"), "lang", F.lit("_"), F.substring(sha("text"), 1, 8)).alias("new_id"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) + len(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '<EMAIL>', 'g'), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS n_subs, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '<EMAIL>', 'g'), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', '<IP>', 'g')) AS digest FROM documents")
def x24_redact(spark, d):
    # possessive forms that never start within a word: linear on long runs
    e, ip = r"(?:\G|(?<![A-Za-z0-9.]))[A-Za-z0-9.]++@[A-Za-z0-9.]++", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    gate = lambda t, c, p, r: F.when(F.contains(t, F.lit(c)), F.regexp_replace(t, p, r)).otherwise(t)
    done = x.let(gate(F.col("text"), "@", e, "<EMAIL>"), lambda once: F.struct(F.regexp_count(once, F.lit(ip)).alias("n"), sha(F.regexp_replace(once, ip, "<IP>")).alias("digest")))
    rows = docs(spark, d).select("doc_id", F.when(F.contains("text", F.lit("@")), F.regexp_count("text", F.lit(e))).otherwise(0).alias("n"), done.alias("done"))
    return rows.select("doc_id", (F.col("n") + F.col("done.n")).cast("long").alias("n_subs"), "done.digest")


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def x26_concat_turns(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", sha(F.array_join(F.transform("t", lambda t: t["text"]), "\n")).alias("digest"), F.size("t").cast("long").alias("n_turns"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text FROM documents")
def x27_truncate(spark, d):
    return docs(spark, d).select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN '[' || props || ',' || props || ']' ELSE props END AS body, CASE event_id % 3 WHEN 2 THEN 2 ELSE 1 END AS n FROM events")
def x22_json_from_prose(spark, d):
    """A fenced block, an object in prose or an array in prose → its JSON and how many objects it holds."""
    p, k = F.col("props"), F.col("event_id") % 3
    prose = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone {so}."))).when(k == 1, F.concat(F.lit("Here is the result: "), p, F.lit(" as asked."))).otherwise(F.concat(F.lit("All of them: ["), p, F.lit(","), p, F.lit("]\n")))
    body = table(spark, d, "events").select("event_id", x.json_body(prose).alias("body"))
    return body.select("event_id", "body", F.coalesce(F.json_array_length("body"), F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(replace(replace(lower(text), 'idiot', '[MASK]'), 'clown', '[MASK]')) AS digest FROM documents")
def x20_mask_terms(spark, d):
    t = F.lower("text")
    for term in sorted(["clown", "idiot"], key=len, reverse=True):
        t = F.regexp_replace(t, term, "[MASK]")
    return docs(spark, d).select("doc_id", sha(t).alias("digest"))


def any_sql(t, phrases):
    return "(" + " OR ".join("contains(lower(coalesce({0}, '')), '{1}')".format(t, p.replace("'", "''")) for p in phrases) + ")::INTEGER"


#: What the assistant says, with phrases of every kind put before it by the turn's number.
SAID = ["Of course. ", "I cannot help with this. That said, ", "I'm not able to say. ", "", "Certainly: "]
TONE = ["however", "therefore", "the "]
SAID_SQL = "CASE turn % 5 " + " ".join(f"WHEN {i} THEN '" + p.replace("'", "''") + "'" for i, p in enumerate(SAID)) + " END || text"


@query(f"WITH t AS (SELECT conv_id, turn, text AS prompt, {SAID_SQL} AS said FROM conversations) SELECT conv_id, turn, {any_sql('prompt', x.FRAMES)} AS frame, (trim(said, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = 'Certainly:')::INTEGER AS template, {any_sql('said', x.OPENINGS)} AS opening, {any_sql('said', x.REFUSALS)} * {any_sql('said', x.TURNS)} AS turned, {any_sql('said', TONE)} AS toned FROM t")
def x19_markers(spark, d):
    """Framing, template, opening, refusal turned round and tone of a turn."""
    said = F.concat(F.get(F.array(*map(F.lit, SAID)), (F.col("turn") % 5).cast("int")), F.col("text"))
    t = table(spark, d, "conversations").select("conv_id", "turn", x.markers(F.col("text"), said, "Certainly:", TONE).alias("m"))
    return t.select("conv_id", "turn", "m.*")


@query("SELECT page_id, regexp_extract(url, '^[^:]*://(.*)$', 1) AS rest FROM pages")
def x21_strip_wrapper(spark, d):
    return table(spark, d, "pages").select("page_id", F.element_at(F.split("url", "://", 2), 2).alias("rest"))


#: Verdicts in five forms, by the turn's number, before or after the text.
FORMS = ["Harmful request: {a}\nHarmful response: {b}\n", "Safety: {c}\n", "\n\n{d}\n", "<think>it is {e}</think> {f} ", "{f} Response harm: harmful "]
WORDS = {"a": ("yes", "no"), "b": ("No", "Yes"), "c": ("Unsafe", "controversial"), "d": ("unsafe", "Safe"), "e": ("dangerous", "benign"), "f": ("it should not be flagged.", "I would flag it.")}


def _form(k, odd):
    return FORMS[k].format(**{name: pair[odd] for name, pair in WORDS.items()})


def raw_sql():
    cases = " ".join("WHEN {} THEN '{}'".format(2 * k + odd, _form(k, odd).replace("\n", "' || chr(10) || '")) for k in range(5) for odd in (0, 1))
    return f"(CASE (2 * (turn % 5) + conv_id % 2) {cases} END) || text"


def last_sql(tail):
    cues = [("harmful", k, c) for k, c in x.HARM_CUES.items()] + [("unharmful", k, c) for k, c in x.SAFE_CUES.items()]
    hits = ", ".join(f"struct_pack(e := length(regexp_extract({tail}, '(?is)^(.*{c})', 1)), r := {i}, verdict := '{v}', cue := '{k}')" for i, (v, k, c) in enumerate(cues))
    return f"list_max([{hits}])"


@query(f"""WITH t AS (SELECT conv_id, turn, {raw_sql()} AS raw FROM conversations),
h AS (SELECT *, lower(regexp_extract(raw, '[Rr]esponse\\s+harm:\\s*(harmful|unharmful)', 1)) AS line, string_split(raw, '</think>')[-1] AS tail FROM t),
m AS (SELECT *, {last_sql("tail")} AS m FROM h)
SELECT conv_id, turn, CASE lower(regexp_extract(raw, '(?i)Harmful request:\\s*(yes|no)', 1)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS request,
       CASE lower(regexp_extract(raw, '(?i)Harmful response:\\s*(yes|no)', 1)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS response,
       CASE lower(regexp_extract(raw, '(?i)Safety:\\s*(safe|unsafe|controversial)', 1)) WHEN 'unsafe' THEN 1 WHEN 'controversial' THEN 1 WHEN 'safe' THEN 0 END AS graded,
       CASE lower(regexp_extract(raw, '(?i)^\\s*(safe|unsafe)', 1)) WHEN 'safe' THEN 0 WHEN 'unsafe' THEN 1 END AS leading,
       CASE WHEN line <> '' THEN line WHEN m.e > 0 THEN m.verdict ELSE 'unknown' END AS verdict, CASE WHEN line <> '' THEN 'structured' WHEN m.e > 0 THEN m.cue ELSE '' END AS cue FROM m""")
def x23_verdicts(spark, d):
    """Three parsers of verdict lines, and the one for free words (W11: the last cue decides)."""
    forms = F.array(*[F.lit(_form(k, odd)) for k in range(5) for odd in (0, 1)])
    raw = F.concat(F.get(forms, (2 * (F.col("turn") % 5) + F.col("conv_id") % 2).cast("int")), F.col("text"))
    t = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    r = F.col("raw")
    out = t.select("conv_id", "turn", x.yes_no(r, "Harmful request").alias("request"), x.yes_no(r, "Harmful response").alias("response"), x.graded(r, unsure=1).alias("graded"), x.leading(r).alias("leading"), x.free_verdict(r).alias("v"))
    return out.select("conv_id", "turn", "request", "response", "graded", "leading", "v.verdict", "v.cue")


@query("SELECT doc_id, pmod_hash AS bucket FROM (SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT % 1000 AS pmod_hash FROM documents)")
def x30_group_id(spark, d):
    return docs(spark, d).select("doc_id", (F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % 1000).alias("bucket"))


@query(f"WITH {SCORED} SELECT item_id, round(greatest(prob, 1 - prob), 6) AS confidence, CASE WHEN prob >= 0.9::DOUBLE THEN 1 WHEN prob >= 0.5::DOUBLE THEN 2 ELSE 3 END AS tier FROM scored")
def x34_confidence_tier(spark, d):
    p = F.col("prob")
    return scored(spark, d).select("item_id", F.round(F.greatest(p, 1 - p), 6).alias("confidence"), F.when(p >= 0.9, 1).when(p >= 0.5, 2).otherwise(3).alias("tier"))


@query("SELECT event_id, map_keys(map_from_entries(list_filter([('big', value > 50), ('click', event_type = 'click'), ('view', event_type = 'view')], lambda e: e[2])))[1] AS primary_tag FROM events")
def x36_active_categories(spark, d):
    m = F.create_map(F.lit("big"), F.col("value") > 50, F.lit("click"), F.col("event_type") == "click", F.lit("view"), F.col("event_type") == "view")
    return table(spark, d, "events").select("event_id", F.get(F.map_keys(F.map_filter(m, lambda k, v: v)), F.lit(0)).alias("primary_tag"))


@query("SELECT c_custkey, i AS choice, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'][i + 1] AS text, (i = c_custkey % 4)::INTEGER AS label FROM customer, range(0, 4) r(i)")
def x37_mcq_explode(spark, d):
    choices = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]))
    return table(spark, d, "customer").select("c_custkey", F.posexplode(choices).alias("choice", "text")).select("c_custkey", F.col("choice").cast("long").alias("choice"), "text", (F.col("choice") == F.col("c_custkey") % 4).cast("int").alias("label"))


@query("SELECT c_custkey, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY'][(c_custkey % 4)::INTEGER + 1] AS answer FROM customer")
def x38_correct_choice(spark, d):
    choices = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]))
    return table(spark, d, "customer").select("c_custkey", F.element_at(choices, (F.col("c_custkey") % 4 + 1).cast("int")).alias("answer"))


@query("SELECT conv_id, turn, role, length(text)::BIGINT AS n FROM conversations")
def x39_flatten_bundles(spark, d):
    bundles = table(spark, d, "conversations").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("q"))
    return bundles.select("conv_id", F.inline("q")).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


WS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda v: v <> '')"


@query(f"WITH w AS (SELECT doc_id, {WS} AS ws FROM documents), k AS (SELECT doc_id, ws, greatest(0, ceil((len(ws) - 128) / 64.0::DOUBLE))::BIGINT AS last FROM w), e AS (SELECT doc_id, ws, unnest(range(0, last + 1)) AS i FROM k) SELECT doc_id, i AS nth, len(ws[i * 64 + 1 : i * 64 + 128]) AS n, sha256(array_to_string(ws[i * 64 + 1 : i * 64 + 128], ' ')) AS digest FROM e")
def w12_token_windows(spark, d):
    rows = docs(spark, d).select("doc_id", F.array_remove(F.split("text", r"\s+"), "").alias("ws"))
    parts = rows.select("doc_id", F.posexplode(x.windows(F.col("ws"), 128, 64)).alias("nth", "w"))
    return parts.select("doc_id", F.col("nth").cast("long").alias("nth"), F.size("w").cast("long").alias("n"), sha(F.array_join("w", " ")).alias("digest"))


SENTENCES = "string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"WITH s AS (SELECT conv_id, turn, {SENTENCES} AS s FROM conversations), c AS (SELECT conv_id, turn, s, unnest(range(0, 3)) AS i FROM s) SELECT conv_id, turn, i::INTEGER AS part, sha256(array_to_string(s[round_even(i * len(s) / 3.0::DOUBLE, 0)::INTEGER + 1 : round_even((i + 1) * len(s) / 3.0::DOUBLE, 0)::INTEGER], ' ')) AS digest FROM c")
def w13_sentence_chunks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(x.split_k(F.col("text"), 3)).alias("part", "chunk"))
    return rows.select("conv_id", "turn", "part", sha("chunk").alias("digest"))


SPACES = r"[ \t\n\x0B\f\r]+"
ASCII, WIDE = "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F)))
#: P01 but for the normal form: (as columns, as SQL).
PERTURBATIONS = {
    "double_space": (lambda t: F.regexp_replace(t, SPACES, "  "), f"regexp_replace(text, '{SPACES}', '  ', 'g')"),
    "rot13": (x.rot13, f"translate(text, '{x.LOWER + x.UPPER}', '{x.ROT + x.ROT.upper()}')"),
    "url_encode": (lambda t: F.replace(F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), "url_encode(text)"),
    "full_width": (lambda t: F.translate(t, ASCII, WIDE), "translate(text, '" + ASCII.replace("'", "''") + f"', '{WIDE}')"),
    "leet": (x.leet, "translate(text, 'aeiost', '431057')"),
    "zero_width": (lambda t: F.regexp_replace(t, "([a-z])", "$1" + chr(0x200B)), r"regexp_replace(text, '([a-z])', '\1' || chr(8203), 'g')"),
    "case": (lambda t: F.translate(t, x.UPPER + x.LOWER, x.LOWER + x.UPPER), f"translate(text, '{x.UPPER + x.LOWER}', '{x.LOWER + x.UPPER}')"),
}


@query("SELECT doc_id, unnest([" + ", ".join(f"'{k}'" for k in PERTURBATIONS) + "]) AS perturbation, sha256(unnest([" + ", ".join(s for _, s in PERTURBATIONS.values()) + "])) AS digest FROM documents")
def p01_perturb(spark, d):
    """Seven of the perturbations of every text; the eighth, a normal form, is in ``p01_roundtrip``."""
    each = F.array(*[F.struct(F.lit(k).alias("perturbation"), f(F.col("text")).alias("t")) for k, (f, _) in PERTURBATIONS.items()])
    return docs(spark, d).select("doc_id", F.inline(each)).select("doc_id", "perturbation", sha("t").alias("digest"))


@query()
def p01_roundtrip(spark, d):
    """How many texts normalisation brings back from each perturbation: both sides normalised, then compared without
    regard to case and white space. Leet spelling is not undone by it, so its rate is near zero. Texts are judged where
    they are read; the columns judge those that ``roundtrip`` hands back."""
    rows = docs(spark, d).select(F.col("text").cast("binary").alias("text")).mapInArrow(roundtrip.judge, roundtrip.SCHEMA)
    t = F.col("text")
    changed = {k: f(t) for k, (f, _) in PERTURBATIONS.items()} | {"nfkd": x.normal_form("NFKD")(t)}
    each = F.when(t.isNull(), F.array(F.struct("perturbation", t.alias("t")))).otherwise(F.array(*[F.struct(F.lit(k).alias("perturbation"), v.alias("t")) for k, v in changed.items()]))
    rows = x.normalize_columns(rows.withColumn("plain", t), "plain").withColumn("plain", x.collapse(F.col("plain"))).select("n", "recovered", "plain", F.inline(each))
    same = x.collapse(F.col("t")) == F.col("plain")
    return x.normalize_columns(rows, "t").groupBy("perturbation").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.sum(F.coalesce("recovered", same.cast("bigint"), F.lit(0))).alias("recovered"))


@query("SELECT doc_id, sha256('Topic: ' || replace(lower(text), 'idiot', 'person') || ' End.') AS digest FROM documents")
def p03_wrap_and_replace(spark, d):
    return docs(spark, d).select("doc_id", sha(F.concat(F.lit("Topic: "), F.replace(F.lower("text"), F.lit("idiot"), F.lit("person")), F.lit(" End."))).alias("digest"))


def _edits_sql():
    bound = lambda numbers, k: f"list_sort(list_filter({numbers}, lambda v: v IS NOT NULL))[least({k}, len(list_filter({numbers}, lambda v: v IS NOT NULL)))]"
    changed = lambda c, pair: f"translate({c}, '{pair[0]}', '{pair[1]}')"
    open_to = lambda pair, h: f"list_transform(c, lambda v, i: CASE WHEN {changed('v', pair)} <> v THEN {h}[i] END)"
    share = lambda n, rate: f"greatest(1, floor({n} * {rate}::DOUBLE)::BIGINT)"
    numbers = ", ".join(f"list_transform(d, lambda v: ('0x' || substr(v, {1 + 8 * k}, 8))::BIGINT) AS h{k}" for k in range(4))
    each = {
        "lookalike": f"CASE WHEN h0[i] <= b0 THEN {changed('v', edits.LOOKALIKE)} ELSE v END",
        "digit": f"CASE WHEN h1[i] <= b1 THEN {changed('v', edits.DIGIT)} ELSE v END",
        "typo": "CASE WHEN h2[i] <= b2 THEN CASE WHEN h2[i] % 2 = 1 AND h2[i + 1] > b2 THEN c[i + 1] || v ELSE '' END WHEN i > 1 AND h2[i - 1] <= b2 AND h2[i - 1] % 2 = 1 THEN '' ELSE v END",
        "case": f"CASE WHEN h3[i] % 2 = 1 THEN {changed('v', (x.LOWER, x.UPPER))} ELSE {changed('v', (x.UPPER, x.LOWER))} END",
        "mark": f"CASE WHEN h3[i] <= b3 THEN v || substr('{edits.MARKS}', (h3[i] % {len(edits.MARKS)} + 1)::INTEGER, 1) ELSE v END",
    }
    names, texts = ", ".join(f"'{k}'" for k in each), ", ".join(f"array_to_string(list_transform(c, lambda v, i: {e}), '')" for e in each.values())
    return f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '(?s).') AS c FROM conversations),
      d AS (SELECT *, list_transform(range(0, len(c)), lambda i: md5(conv_id::VARCHAR || ':' || turn::VARCHAR || ':' || i::VARCHAR)) AS d FROM t),
      h AS (SELECT *, {numbers} FROM d),
      b AS (SELECT *, {open_to(edits.LOOKALIKE, 'h0')} AS o0, {open_to(edits.DIGIT, 'h1')} AS o1 FROM h),
      e AS (SELECT *, {bound('o0', share('len(c)', 0.15))} AS b0, {bound('o1', share('len(list_filter(o1, lambda v: v IS NOT NULL))', 0.3))} AS b1,
            {bound('h2', share('len(c)', 0.05))} AS b2, {bound('h3', 5)} AS b3 FROM b),
      u AS (SELECT conv_id, turn, unnest([{names}]) AS edit, unnest([{texts}]) AS changed FROM e)
      SELECT conv_id, turn, edit, length(changed)::BIGINT AS n_chars, sha256(changed) AS digest FROM u"""


@query(_edits_sql())
def p02_random_edits(spark, d):
    """Five kinds of random edits of every turn, each at its own rate, at places drawn by digest."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    # the outer form, since for the inner one the optimiser filters by the array's size and makes all edits twice
    out = edits.random_edits(t, "text", F.concat_ws(":", "conv_id", "turn")).select("conv_id", "turn", F.inline_outer("edits"))
    return out.select("conv_id", "turn", "edit", F.length("changed").cast("long").alias("n_chars"), sha("changed").alias("digest"))


QUERIES, SQL = query.queries, query.sql
