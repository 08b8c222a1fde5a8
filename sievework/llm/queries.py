"""The registered queries: each applies its operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, lines, mixing, near_dedup, periodic, pii, quality, resampling, sharding, substring, toxicity, url_filter
from ._common import let, table, words


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "found"))
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.text_of(F.col("base")), 256).alias("base_sha256"), pii.text_of(every).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = lambda name: F.col(f"_f.{name}").alias(name)
    judged = quality.judge_narrow(docs)
    return judged.select("doc_id", f("n_words"), f("word_chars"), f("n_symbols"), f("n_dup_lines"), f("n_repeat_words"), quality.base_failed().alias("base_failed"), F.col("_kept").alias("kept"), F.col("_quality").alias("quality"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, threshold=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return out.select("doc_id", sharding.record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"), "e_value")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, buckets=10_000, seed=7)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by the CRC of its id ends in a passage repeated over and over: from word a on,
    word i is word a + (i - a) % p. Texts without a doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def places(ws):
        n = F.greatest(F.size(ws), F.lit(1))
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return let(F.struct(ws.alias("ws"), n.alias("n"), a.alias("a"), p.alias("p")), repeated)

    def repeated(x):
        tail = F.transform(F.sequence(x["a"], x["n"] - 1), lambda i: F.get(x["ws"], x["a"] + F.pmod(i - x["a"], x["p"])))
        return F.array_join(F.concat(F.slice(x["ws"], F.lit(1), x["a"]), tail), " ")

    planted = let(words(F.col("text")), places)
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(planted_repeats(table(spark, sf_dir, "documents")), exponent=4, least=6)
    lines_ = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(lines_, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    each = [op1_pii, op2_quality, op3_near_dedup, op4_line_dedup, op5_sharding, op6_toxicity, op7_substring_dedup, op8_mixing, op9_decontamination, op10_url_filters, op11_importance_resampling, op12_exact_dedup, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in each}


#: Equal to op4: hosts, visible lines, pages of a host that hold a line against all pages of the host.
OP4_SQL = r"""
WITH parsed AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
             '(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'),
             '(?i)<(?:br|/?(?:p|div|li|ul|ol|nav|article|header|footer|section|h[1-6]|tr|td|th|table|title|head|body|html|aside|main|blockquote|pre))\b[^>]*>', chr(10), 'g'),
             '<[^>]*>', '', 'g'), chr(10)),
           lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT coalesce(host, '') AS host, count(*) AS pages FROM parsed GROUP BY 1 HAVING count(*) >= 5),
held AS (SELECT coalesce(host, '') AS host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM parsed) GROUP BY 1, 2),
gone AS (SELECT host, list(line) AS lines FROM held JOIN totals USING (host) WHERE n > 0.3 * pages GROUP BY host)
SELECT page_id, coalesce(p.host, '') AS host, len(p.lines)::BIGINT AS n_lines,
       (len(p.lines) - len(list_filter(p.lines, lambda x: NOT coalesce(list_contains(g.lines, x), false))))::BIGINT AS n_dropped,
       sha256(array_to_string(list_filter(p.lines, lambda x: NOT coalesce(list_contains(g.lines, x), false)), chr(10))) AS kept_sha256
FROM parsed p LEFT JOIN gone g ON coalesce(p.host, '') = g.host
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
k AS (
  SELECT doc_id, source, size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
         -ln((CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 1.0::DOUBLE) / 281474976710656.0::DOUBLE)
           / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(length(t), 1)::DOUBLE)) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM k GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
final AS (SELECT arg_min(level, cap / weight) FILTER (WHERE cap > level * weight) AS level FROM l),
t AS (
  SELECT source, source_size, CASE WHEN cap <= l.level * weight OR final.level IS NULL THEN cap ELSE final.level * weight END AS target FROM l, final),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, target - epochs * source_size AS rest FROM e),
p AS (
  SELECT k.*, r.source_size, r.target, r.epochs, r.rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, id) AS upto FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
best AS (
  SELECT source, min(least(abs(upto - rest), rest)) AS off FROM p GROUP BY source),
cut AS (
  SELECT p.source, min(upto) FILTER (WHERE abs(upto - rest) = off) AS upto, bool_or(rest = off) AS nothing FROM p JOIN best ON p.source IS NOT DISTINCT FROM best.source GROUP BY p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(epochs + CASE WHEN p.upto <= cut.upto AND NOT nothing THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM p JOIN cut ON p.source IS NOT DISTINCT FROM cut.source
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
v AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), length(rule_host || rule_path)) FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best,
         regexp_matches(host || path, '^([^/]*\.)?((spam-farm|cheap-pills|ads-track|link-farm|free-casino|payday-loans)\.|ads.*\.example([^A-Za-z0-9_.%-]|$))|^tracker\.|/wp-login\.php$|/track/.*/click([^A-Za-z0-9_.%-]|$)|/banner-ads/') AS own FROM h)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN own THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op10_url_filters": OP10_SQL, "op12_exact_dedup": OP12_SQL}
