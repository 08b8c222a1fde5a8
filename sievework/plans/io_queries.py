"""Queries S* and ST*: readers, caches, sinks and streams, each through real files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from ..session import scratch_path
from ..sources import ordered, readers
from ..streaming import stateful, streams
from ._base import HASH32, Plan, table

query = Plan()


def docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT CASE WHEN lang = 'de' THEN 'bad' ELSE 'good' END AS kind, CASE WHEN lang = 'de' THEN NULL ELSE doc_id::VARCHAR END AS example_id, md5(CASE WHEN lang = 'de' THEN '{broken ' || doc_id ELSE text END) AS digest FROM documents WHERE lang IS DISTINCT FROM 'fr'")
def s01_typed_scan(spark, d):
    """Typed JSON lines: German rows are written broken and come back as bad lines, French ones as blanks, which go."""
    path = scratch_path(spark, "s01")
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("example_id"), F.col("text").alias("query"), F.col("source").alias("category")))
    line = F.when(F.col("lang") == "de", F.concat(F.lit("{broken "), "doc_id")).when(F.col("lang") == "fr", "  ").otherwise(row)
    docs(spark, d).select(line.alias("value")).write.text(path)
    good, bad = readers.jsonl(spark, path, readers.EXAMPLE)
    out = good.select(F.lit("good").alias("kind"), "example_id", F.md5("query").alias("digest"))
    return out.unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("example_id"), F.md5("line").alias("digest")))


@query("SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS source_model, doc_id FROM documents")
def s04_source_from_path(spark, d):
    path = scratch_path(spark, "s04")
    docs(spark, d).select("doc_id", F.col("source").alias("origin")).write.partitionBy("origin").json(path)
    return readers.with_source(spark, f"{path}/origin=*/*.json", "doc_id long", r"/origin=([^/]+)/[^/]+$").select("source_model", "doc_id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s05_json_document(spark, d):
    """One JSON document, an array of rows, for each region."""
    path = scratch_path(spark, "s05")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.groupBy(F.col("n_regionkey").alias("_r")).agg(F.to_json(F.collect_list(F.struct(*n.columns)), {"pretty": "true"}).alias("value")).repartition("_r").write.partitionBy("_r").text(path)
    return readers.json_document(spark, f"{path}/_r=*", "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT 'R' || n_nationkey AS rule_id, 'C' || n_regionkey AS category, n_name AS title, 1 + n_regionkey % 5 AS threat_level_boundary FROM nation")
def s06_rules(spark, d):
    """A rule file as parsed on the driver; rule files are small, as this dimension is."""
    rows = table(spark, d, "nation").select(F.concat(F.lit("R"), "n_nationkey").alias("rule_id"), F.concat(F.lit("C"), "n_regionkey").alias("category"), F.col("n_name").alias("title"), (1 + F.col("n_regionkey") % 5).alias("threat_level_boundary"))
    rows = rows.withColumns({c: F.lit("-") for c in ("permitted", "restricted", "rationale")})
    return readers.rules(spark, {"rules": [r.asDict() for r in rows.collect()]}).select("rule_id", "category", "title", "threat_level_boundary")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def s08_csv_cache(spark, d):
    """CSV with a header, cached as JSON lines."""
    path = scratch_path(spark, "s08")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand").write.option("header", True).csv(f"{path}/csv")
    return readers.cached(readers.csv(spark, f"{path}/csv"), f"{path}/cache")


@query("SELECT text AS query, item_id AS source_id, 'unsafe' AS safety_label, 'I can''t help with: ' || text || '.' AS response FROM benchmark")
def s09_mapped_cache(spark, d):
    out = readers.mapped(table(spark, d, "benchmark"), {"query": "text", "source_id": "item_id"}, {"safety_label": "unsafe"}, {"response": "I can't help with: {}."})
    return readers.cached(out, scratch_path(spark, "s09"))


@query("SELECT c_custkey, c_name FROM customer")
def s10_fallback(spark, d):
    """The first reader finds no file, the second does."""
    t = readers.first_source(lambda: table(spark, d, "no_such_table"), lambda: table(spark, d, "customer"))
    return t.select("c_custkey", "c_name")


@query("SELECT doc_id, source, 'english' AS tag FROM documents WHERE lang = 'en'")
def s11_derived_cache(spark, d):
    """A parent cache, and one made from it by a filter and a tag."""
    path = scratch_path(spark, "s11")
    parent = readers.cached(docs(spark, d).select("doc_id", "source", "lang"), f"{path}/parent")
    return readers.cached(parent.where("lang = 'en'").select("doc_id", "source", F.lit("english").alias("tag")), f"{path}/child")


@query("SELECT lpad(c_custkey::VARCHAR, 12, '0') AS id, c_name FROM customer ORDER BY id LIMIT 100")
def s12_capped_scan(spark, d):
    """The cap is the feature: the first hundred rows in key order."""
    path = scratch_path(spark, "s12")
    table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("id"), "c_name").write.option("header", True).csv(path)
    return readers.csv(spark, path, limit=100, order="id")


@query("SELECT doc_id, source, md5(text) AS digest FROM documents")
def s16_jsonl_sink(spark, d):
    path = scratch_path(spark, "s16")
    t = docs(spark, d).select("doc_id", "source", "text")
    readers.write_jsonl(t, path)
    readers.write_jsonl(t, path)  # a second run overwrites
    return spark.read.schema(t.schema).json(path).select("doc_id", "source", F.md5("text").alias("digest"))


@query("SELECT DISTINCT conv_id || '-' || turn AS k, role AS fine_label FROM conversations")
def s17_append_resume(spark, d):
    """A first run that wrote the user's turns, and a resumed one that adds what the sink lacks."""
    path = scratch_path(spark, "s17")
    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.col("role").alias("fine_label")).distinct()
    readers.append_new(t.where("fine_label = 'user'"), path, "k", "fine_label")
    readers.append_new(t, path, "k", "fine_label")
    return spark.read.json(path).select("k", "fine_label")


@query("""SELECT '{"source":"' || source || '","n":' || count(*) || '}' AS value FROM documents WHERE source IS NOT NULL GROUP BY source""")
def s18_report(spark, d):
    path = scratch_path(spark, "s18")
    readers.report(docs(spark, d).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))).write.text(path)
    return spark.read.text(path)


@query(f"WITH s AS (SELECT doc_id, CASE WHEN {HASH32.format('doc_id')} % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) SELECT split, doc_id, count(*) OVER (PARTITION BY split) AS card_n FROM s")
def s23_dataset_export(spark, d):
    """The exported rows, each beside what the card says of its split."""
    path = scratch_path(spark, "s23")
    split = F.when(splits.hash32(F.col("doc_id")) % 10 < 8, "train").otherwise("test")
    readers.export_dataset(docs(spark, d).select("doc_id", split.alias("split")), path, "split")
    card = spark.read.schema("split string, n long").json(f"{path}/card").withColumnRenamed("n", "card_n")
    return spark.read.parquet(f"{path}/data").join(F.broadcast(card), "split").select("split", "doc_id", "card_n")


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


def finish(started) -> None:
    """A stream over what there is ends by itself."""
    started.awaitTermination()


@query("SELECT event_id, value > 50 AS flag FROM events")
def st1_scored_stream(spark, d):
    path = scratch_path(spark, "st1")
    finish(streams.score_stream(event_stream(spark, d), lambda s: s.select("event_id", (F.col("value") > 50).alias("flag")), f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema("event_id long, flag boolean").parquet(f"{path}/out")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def st2_resumed_stream(spark, d):
    """The first event of each user and type; the query is started again from its checkpoint and adds nothing."""
    path = scratch_path(spark, "st2")
    for _ in range(2):
        stream = event_stream(spark, d).select("user_id", "event_type", "event_id")
        finish(stateful.to_files(stateful.resume(stream, ["user_id", "event_type"], "event_id"), f"{path}/sink", f"{path}/checkpoint"))
    return spark.read.schema("user_id long, event_type string, event_id long").parquet(f"{path}/sink")


@query("""WITH r AS (SELECT user_id::VARCHAR AS run, arg_max(event_type, (ts, event_type)) AS status, count(*) AS lines, max(ts) AS seen FROM events GROUP BY user_id),
newest AS (SELECT max(ts) AS t FROM events)
SELECT run, CASE WHEN status = 'purchase' THEN 'over' ELSE 'progress' END AS kind, status, lines FROM r
UNION ALL SELECT run, 'silent', status, lines FROM r, newest WHERE status <> 'purchase' AND seen + INTERVAL 6 HOUR < t - INTERVAL 10 MINUTE""")
def st3_log_watcher(spark, d):
    """Users as runs, their events as log lines; a purchase ends a run. Who says nothing for six hours is reported."""
    path = scratch_path(spark, "st3")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.col("user_id").cast("string"), F.concat(F.lit("status="), "event_type"))
    finish(stateful.to_files(stateful.watch(event_stream(spark, d).select(line.alias("value")), "6 hours", over=("purchase",)), f"{path}/out", f"{path}/checkpoint", timers=True))
    return spark.read.schema(stateful.REPORT).parquet(f"{path}/out").select("run", "kind", "status", "lines")


def write_in_order(df, path, order, value):
    """The rows' lines in key order over several files, whose names ascend with the key."""
    df.repartitionByRange(5, *order).sortWithinPartitions(*order).select(value.alias("value")).write.text(path)
    return path


@query("""WITH a AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'bad' WHEN lang = 'fr' THEN 'blank' ELSE 'good' END AS kind, 0 AS f FROM documents),
b AS (SELECT vec_id AS doc_id, 'good' AS kind, 1 AS f FROM embeddings),
n AS (SELECT doc_id, kind, f, row_number() OVER (ORDER BY f DESC, doc_id) - 1 AS number FROM (FROM a UNION ALL FROM b))
SELECT CASE WHEN kind = 'good' THEN doc_id END AS id, CASE WHEN kind = 'good' THEN number END AS number, kind, f AS source FROM n WHERE kind <> 'blank'""")
def s03_lines_in_order(spark, d):
    """Two sets of JSON-lines files, the second given first: every record with its line number over all, bad lines set aside."""
    path = scratch_path(spark, "s03")
    row = lambda c: F.to_json(F.struct(F.col(c).alias("id")))
    line = F.when(F.col("lang") == "de", F.concat(F.lit("{broken "), "doc_id")).when(F.col("lang") == "fr", "  ").otherwise(row("doc_id"))
    first = write_in_order(table(spark, d, "embeddings").select("vec_id"), f"{path}/b", ["vec_id"], row("vec_id"))
    second = write_in_order(docs(spark, d).select("doc_id", "lang"), f"{path}/a", ["doc_id"], line)
    read = ordered.jsonl(spark, [first, second], "id long")
    source = F.when(F.contains("file", F.lit("/b/")), 1).otherwise(0).alias("source")
    good = read.rows.select("id", "number", F.lit("good").alias("kind"), source)
    return good.unionByName(read.bad.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("number"), F.lit("bad").alias("kind"), source))


@query("WITH n AS (SELECT doc_id, toxic, quality, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM labels) SELECT number, toxic::VARCHAR AS \"left\", quality::VARCHAR AS \"right\", toxic = quality AS same FROM n")
def j07_positional_zip(spark, d):
    """Two lists of predictions in files put side by side by line; neither holds a key. Unequal lengths are refused."""
    path = scratch_path(spark, "j07")
    l = table(spark, d, "labels").select("doc_id", "toxic", "quality")
    sides = [ordered.lines(spark, write_in_order(l, f"{path}/{c}", ["doc_id"], F.col(c).cast("string"))) for c in ("toxic", "quality")]
    return ordered.zipped(*sides).withColumn("same", F.col("left") == F.col("right"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w07_first_line(spark, d):
    """Files in the order of prices: the first line of each customer, not the least key."""
    path = scratch_path(spark, "w07")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    write_in_order(o, path, ["o_totalprice", "o_orderkey"], F.to_json(F.struct("o_custkey", "o_orderkey")))
    read = ordered.jsonl(spark, path, "o_custkey long, o_orderkey long").rows
    return ordered.first_lines(read, "o_custkey").select("o_custkey", "o_orderkey")


QUERIES, SQL = query.queries, query.sql
