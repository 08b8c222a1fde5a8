"""URL rules indexed by their rarest literal token (DataFrame functions only).

Rules come as a table of patterns. Every rule is filed under that whole token of its text which the fewest URLs hold;
rules without one are always run. The tokens of a URL fetch the candidate rules, and only those run their regular
expression.

Up to `FEW` rules the index is part of the plan and every URL is judged where it is read, without a shuffle. A larger
index is joined: the distinct URLs are exploded into tokens, and the verdicts are joined back.

Patterns: ``||`` at the start stands for the beginning of a host label, ``|`` at the start or end for that end of
host and path (query and fragment are no part of them), ``*`` for any characters and ``^`` for a separator or the end.
Patterns are matched against the host in lower case, and against the path as it stands.

Defined results: a null URL, or one without ``://``, has an empty host and path; only rules that match empty text fit
it, and without a rule the method allows it. Of named rules the longest name wins, of equal lengths the first by code
point; where rules without a name disagree, block wins. Null patterns are no rules, and rules given twice count once.
Repeated rows each get the same result; empty tables of pages or rules are allowed; other columns are ignored. A very
long URL costs time in proportion to its length for each rule that it fetches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, let, lookup, maybe_broadcast

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[^a-z0-9]+"
#: Rules that the plan itself holds.
FEW = 2_000
#: Rules without a token that run on a URL one after the other.
BLOCK = 500

# The rules of the contract.
CONTRACT_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: The method's own: link farms by host label, advertising and tracking by host or path, log-in pages by their end.
PATTERN_RULES = [
    *(f"||{label}." for label in ("spam-farm", "cheap-pills", "ads-track", "link-farm", "free-casino", "payday-loans")),
    "||ads*.example^", "|tracker.", "/wp-login.php|", "/track/*/click^", "/banner-ads/",
]


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def default_rules(spark: SparkSession) -> DataFrame:
    """(pattern, verdict, name): the contract's rules by name and the method's own."""
    rows = [(f"||{name}", verdict, name) for name, verdict in CONTRACT_RULES] + [(p, "block", None) for p in PATTERN_RULES]
    each = [F.struct(F.lit(p).alias("pattern"), F.lit(v).alias("verdict"), F.lit(n).cast("string").alias("name")) for p, v, n in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern, to be searched in host + path."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\|\|?", ""), r"\|$", "")
    body = F.regexp_replace(body, r"([\\.\[\]{}()+?$|-])", r"\\$1")
    body = F.regexp_replace(F.replace(body, F.lit("*"), F.lit(".*")), r"\^", r"(?:[^A-Za-z0-9_.%-]|\$)")
    start = F.when(F.startswith(pattern, F.lit("||")), r"^(?:[^/]*\.)?").when(F.startswith(pattern, F.lit("|")), "^").otherwise("")
    return F.concat(F.lit("(?s)"), start, body, F.when(pattern.rlike(r"[^|]\|$"), r"\z").otherwise(""))


def pattern_tokens(pattern: Column) -> Column:
    """The tokens that any URL a pattern fits holds whole: those with separators or anchors on both sides."""
    text = F.translate(pattern, _UPPER, _LOWER)
    ends = F.concat(F.when(F.startswith(text, F.lit("|")), "").otherwise("*"), text, F.when(text.rlike(r"[^|]\|$"), "").otherwise("*"))
    return F.array_distinct(F.regexp_extract_all(ends, F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))


def compiled(rules: DataFrame) -> DataFrame:
    """(regex, tokens, rule_verdict, rule_name) of each rule."""
    rules = rules.where("pattern IS NOT NULL AND verdict IS NOT NULL").select("pattern", "verdict", "name").distinct()
    return rules.select(pattern_regex(F.col("pattern")).alias("regex"), pattern_tokens(F.col("pattern")).alias("tokens"), F.col("verdict").alias("rule_verdict"), F.col("name").alias("rule_name"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _TOKEN), ""))


def rule_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """(token, regex, rule_verdict, rule_name): each rule under its rarest token, or null without one. ``rules`` should
    be durable; ``url_tokens`` has a row for each token of each URL."""
    wanted = rules.select("regex", F.explode_outer("tokens").alias("token"), "rule_verdict", "rule_name")
    asked = durable(wanted.select("token").where("token IS NOT NULL").distinct(), "url-tokens")
    held = url_tokens.join(maybe_broadcast(asked, 100_000), "token", "left_semi").groupBy("token").count()
    rarest = wanted.join(held, "token", "left").groupBy("regex", "rule_verdict", "rule_name").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
    return durable(rarest.select(F.col("least.token").alias("token"), "regex", "rule_verdict", "rule_name"), "url-index")


def _best(fits: Column) -> tuple[Column, Column]:
    """Rule and verdict by an array of fitting rules (rule_verdict, rule_name)."""
    named = F.filter(fits, lambda r: r["rule_name"].isNotNull())
    best = F.array_min(F.transform(named, lambda r: F.struct((-F.length(r["rule_name"])).alias("n"), r["rule_name"].alias("name"), r["rule_verdict"].alias("verdict"))))
    own = F.array_max(F.transform(F.filter(fits, lambda r: r["rule_name"].isNull()), lambda r: r["rule_verdict"]))
    return best["name"], F.coalesce(best["verdict"], own, F.lit("allow"))


def _judged(index: DataFrame, host: Column, path: Column) -> Column:
    """Struct of rule and verdict, with the index as part of the expression: tokens that file a rule are found by a
    hash set, and only those look up their rules."""
    by_token: dict = {}
    for r in sorted(index.collect(), key=str):
        by_token.setdefault(r["token"], []).append(r)
    literal = lambda rs: F.array(*[F.struct(F.lit(r["regex"]).alias("regex"), F.lit(r["rule_verdict"]).alias("rule_verdict"), F.lit(r["rule_name"]).cast("string").alias("rule_name")) for r in rs])
    none = F.array().cast("array<struct<regex:string,rule_verdict:string,rule_name:string>>")
    always, filed = by_token.pop(None, []), list(by_token.items())
    target = F.concat(host, path)
    found = none
    if filed:
        keys, values = F.array(*[F.lit(t) for t, _ in filed]), F.array(*[literal(rs) for _, rs in filed])
        fetch = lambda t: F.get(values, F.array_position(keys, t).cast("int") - 1)
        found = F.flatten(F.transform(F.filter(tokens(target), lambda t: t.isin([t for t, _ in filed])), fetch))
    candidates = F.concat(found, literal(always)) if always else found

    def run(x: Column) -> Column:
        rule, verdict = _best(F.filter(x["rules"], lambda r: F.rlike(x["target"], r["regex"])))
        return F.struct(rule.alias("rule"), verdict.alias("verdict"))

    return let(F.struct(target.alias("target"), candidates.alias("rules")), run)


def _judged_by_join(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (_url, rule, verdict) for an index of any size. ``urls``: url, host, path."""
    target = F.concat("host", "path")
    blocks = max(1, -(-index.where("token IS NULL").count() // BLOCK))
    rows = durable(urls.select("url", target.alias("target")).distinct(), "url-texts")
    exploded = rows.select("url", "target", F.explode_outer(tokens(F.col("target"))).alias("token"))
    filed = durable(index.where("token IS NOT NULL").groupBy("token").agg(F.collect_list(F.struct("regex", "rule_verdict", "rule_name")).alias("rules")), "url-filed")
    fits = lookup(exploded, filed, ["token"], F.col("url"), FEW).select("url", "target", F.inline("rules")).where(F.rlike("target", F.col("regex")))
    fits = fits.select("url", "rule_verdict", "rule_name")
    # rules without a token run on every URL in any case: in blocks, one row for each
    always = index.where("token IS NULL").groupBy(F.pmod(F.xxhash64("regex"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("regex", "rule_verdict", "rule_name")).alias("rules"))
    met = rows.crossJoin(maybe_broadcast(durable(always, "url-always"), FEW)).select("url", F.inline(F.filter("rules", lambda r: F.rlike("target", r["regex"]))))
    fits = fits.unionByName(met.select("url", "rule_verdict", "rule_name"))
    rule, verdict = _best(F.col("fits"))
    per = fits.groupBy("url").agg(F.collect_set(F.struct("rule_verdict", "rule_name")).alias("fits")).select("url", rule.alias("rule"), verdict.alias("verdict"))
    return rows.select("url").join(per, "url", "left").select(F.col("url").alias("_url"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict. ``rules``: pattern, verdict, name (null: a rule of the
    method's own, which decides where no named rule fits)."""
    rules = compiled(default_rules(pages.sparkSession) if rules is None else rules)
    rules = durable(rules, "url-rules")
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    index = rule_index(rules, rows.select(F.explode(tokens(F.concat("host", "path"))).alias("token")))
    if index.limit(FEW + 1).count() <= FEW:
        judged = rows.withColumn("_j", _judged(index, F.col("host"), F.col("path")))
        return judged.select("page_id", "url", "host", "path", "_j.rule", "_j.verdict")
    judged = _judged_by_join(rows.select("url", "host", "path"), index)
    return rows.join(judged, F.col("url").eqNullSafe(F.col("_url")), "left").select("page_id", "url", "host", "path", "rule", "verdict")
