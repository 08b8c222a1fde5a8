"""Readers and sinks: JSON lines with bad rows set aside, several files in order, documents, CSV, rules, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLE = "example_id string, rule_id string, category string, query string, response string, fine_label string, safety_label string, augmentation string, language string, jailbreak_template string, boundary_reasoning string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:  # S01, S02
    """(good rows, bad lines). Missing files give no rows; blank lines are skipped."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    typed = T._parse_datatype_string(schema)
    if not paths:
        return spark.createDataFrame([], typed), spark.createDataFrame([], "line string")
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*typed.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def concat_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:  # S03
    """Files one after the other; _file keeps their order."""
    out = None
    for i, p in enumerate(paths):
        part = jsonl(spark, p, schema)[0].withColumn("_file", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_source(spark: SparkSession, glob: str, schema: str, pattern: str = r"([^/]+)\.jsonl$", name: str = "source_model") -> DataFrame:  # S04
    return spark.read.schema(schema).json(glob).withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:  # S05
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, limit: int | None = None, order: str | None = None) -> DataFrame:  # S08, S12
    df = spark.read.csv(path, header=True)
    return df if limit is None else df.orderBy(order or df.columns[0]).limit(limit)


def rules(spark: SparkSession, document: dict | str) -> DataFrame:  # S06
    """Rules from a parsed document (or its JSON text); an error names the row and the id."""
    data = json.loads(document) if isinstance(document, str) else document
    need = ("rule_id", "category", "title", "permitted", "restricted", "rationale", "threat_level_boundary")
    rows = []
    for i, r in enumerate(data["rules"]):
        missing = [k for k in need if k not in r]
        if missing or not 1 <= int(r["threat_level_boundary"]) <= 5:
            raise ValueError(f"rule {i} ({r.get('rule_id')}): {'missing ' + ', '.join(missing) if missing else 'threat level out of range'}")
        rows.append(tuple(r[k] for k in need))
    return spark.createDataFrame(rows, "rule_id string, category string, title string, permitted string, restricted string, rationale string, threat_level_boundary int")


def mapped(df: DataFrame, fields: dict[str, str], defaults: dict[str, str], templates: dict[str, str] | None = None) -> DataFrame:  # S09
    """A foreign table in the classifier schema: fields renamed, constants for what it lacks, and texts from templates
    in which ``{}`` stands for the first mapped field. A template's value for a null field is null."""
    first = F.col(next(iter(fields.values())))
    parts = {k: t.split("{}") for k, t in (templates or {}).items()}
    made = [F.concat(*[x for i, p in enumerate(ps) for x in ([first.cast("string")] if i else []) + [F.lit(p)]]).alias(k) for k, ps in parts.items()]
    return df.select(*[F.col(old).alias(new) for new, old in fields.items()], *[F.lit(v).alias(k) for k, v in defaults.items()], *made)


def cached(df: DataFrame, path: str) -> DataFrame:  # S08, S09, S11
    """The rows through a JSON-lines cache: written if the cache is missing, read with the table's schema."""
    spark = df.sparkSession
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        write_jsonl(df, path)
    return spark.read.schema(df.schema).json(path)


def first_source(*attempts):  # S10
    """The result of the first reader that works."""
    errors = []
    for a in attempts:
        try:
            return a()
        except Exception as e:  # each source may fail in its own way
            errors.append(f"{type(e).__name__}: {e}"[:200])
    raise FileNotFoundError("; ".join(errors))


def fullest(df: DataFrame, by: str) -> DataFrame:  # S13
    """The rows of the candidate file with most rows; ties go to the first name."""
    best = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(1).select(by)
    return df.join(F.broadcast(best), by, "left_semi")


def progress(log: DataFrame) -> DataFrame:  # S14
    """Last step and state of each run from log lines '<n> <run> step=<s> status=<x>'."""
    parts = log.select(F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("at"), F.regexp_extract("value", r"^\d+ (\S+)", 1).alias("run"), F.regexp_extract("value", r"step=(\S+)", 1).alias("step"), F.regexp_extract("value", r"status=(\S+)", 1).alias("status"))
    return parts.where("run <> ''").groupBy("run").agg(F.max_by("step", "at").alias("step"), F.max_by("status", "at").alias("status"), F.count(F.lit(1)).alias("lines"))


def write_jsonl(df: DataFrame, path: str) -> None:  # S16
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str, route: str) -> None:  # S17
    """Appends rows whose key the sink lacks, routed to a folder per label."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.json(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").partitionBy(route).json(path)


def report(df: DataFrame) -> DataFrame:  # S18
    return df.select(F.to_json(F.struct("*")).alias("value"))


def export_dataset(df: DataFrame, path: str, split: str) -> None:  # S23
    """Parquet by split, and a card with the rows of each split as JSON lines."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    report(df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))).coalesce(1).write.mode("overwrite").text(f"{path}/card")


def manifest(df: DataFrame, block: str, label: str) -> DataFrame:  # S19
    return df.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == 1, 1)).alias("n_positive"))


def retained(df: DataFrame, key: str, cap: int | None) -> tuple[DataFrame, DataFrame]:  # S20
    """(rows up to a cap in key order, one row of n_total, n_saved, truncated)."""
    kept = df if cap is None else df.orderBy(key).limit(cap)
    n = F.count(F.lit(1))
    meta = df.agg(n.alias("n_total")).select("n_total", F.least(F.col("n_total"), F.lit(cap if cap is not None else 2**62)).alias("n_saved"))
    return kept, meta.withColumn("truncated", F.col("n_saved") < F.col("n_total"))


def by_role(registry: DataFrame) -> DataFrame:  # S15
    return registry.groupBy("role").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def rank_in_file(df: DataFrame, source: str, line: str, n: int) -> DataFrame:  # T13
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(line))).where(F.col("_rn") <= n).drop("_rn")
