"""Unit cases of single operators, readers and streams."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as x
from sievework.operators import metrics, ml, splits, stats
from sievework.sources import readers
from sievework.streaming import streams


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("hel​lo", "hello"), ("cаt", "cat"), ("ca" + chr(0x301) + "t", "cat"), ("ｃａｔ", "cat"), ("Jung vf gur cebprff", "What is the process"),
        (base64.b64encode(b"this is a plaintext sentence").decode(), "this is a plaintext sentence"), ("hello%20world", "hello world"),
        ("How does PCR work?", "How does PCR work?"), ("DEADBEEF", "DEADBEEF"), ("", ""), ("hex" * 2 + "\x08", "hexhe"), (b"plain words in hexadecimal".hex(), "plain words in hexadecimal"),
    ],
)
def test_normalize(spark, given, wanted):
    assert one(spark, x.normalize, given) == wanted


def plain_normalize(t):
    """X12 in plain Python."""
    import re
    import unicodedata
    from urllib.parse import unquote

    def text(raw):
        try:
            out = raw.decode("utf-8") if isinstance(raw, bytes) else raw
        except UnicodeDecodeError:
            return None
        bad = sum(unicodedata.category(c)[0] == "C" or c == "�" for c in out)
        return out if len(out) >= 3 and len(out) - bad >= 0.85 * len(out) else None

    def score(v):
        return sum(w in x.ENGLISH for w in re.findall("[a-z]+", v.lower()))

    t = re.sub("[​-‏‪-‮⁠-⁤﻿­︀-️\U000e0000-\U000e007f\U000e0100-\U000e01ef]", "", t)
    while re.search("[^\b]\b", t):
        t = re.sub("[^\b]\b", "", t)
    out = text(unquote(t)) if re.search("%[0-9A-Fa-f]{2}", t) else None
    bare = re.sub(r"\s", "", t)
    if out is None and len(bare) >= 20 and re.fullmatch("[A-Za-z0-9+/]+=*", bare):
        body = bare.rstrip("=")
        out = text(base64.b64decode(body + "=" * (-len(body) % 4))) if len(body) % 4 != 1 else None
    bare = re.sub(r"0[xX]|\s", "", t)
    if out is None and len(t.strip()) >= 20 and len(bare) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", bare):
        out = text(bytes.fromhex(bare))
    if out is None:
        turned = t.translate(str.maketrans(x.LOWER + x.UPPER, x.ROT + x.ROT.upper()))
        out = turned if score(turned) > score(t) else t
    out = out.translate(str.maketrans(*x.HOMOGLYPHS))
    return unicodedata.normalize("NFKC", "".join(c for c in out if unicodedata.category(c) != "Mn"))


def test_normalize_against_plain_python(spark, tiny):
    said = "this is a plaintext sentence that is long enough for lines"
    coded = base64.b64encode(said.encode()).decode()
    hexed = said.encode().hex()
    pairs = [hexed[i : i + 2] for i in range(0, len(hexed), 2)]
    wanted = {
        "keep" + "hidden words" + "\b" * 12: "keep", "ab" + "\b" * 5 + "cd": "\b" * 3 + "cd", "a\bb\b\bc😀\b": "\bc",
        coded[:30] + "\n" + coded[30:]: said, coded[:30] + "\r\n " + coded[30:]: said, " ".join(coded): said, coded.rstrip("="): said,
        " ".join("0x" + h for h in pairs): said, "\n".join(pairs): said, "0x" + hexed: said, "48 65 6c 6c 6f 20 77": "Hello w",
    }
    assert len(coded.rstrip("=")) < len(coded)
    texts = list(wanted) + [r["text"] for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("text").where("text IS NOT NULL").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["o"] for r in df.select("i", x.normalize(F.col("t")).alias("o")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == wanted.get(t, plain_normalize(t)) == plain_normalize(t), t


def test_ngrams_and_windows(spark):
    w = F.array(*map(F.lit, "abcdef"))
    row = spark.range(1).select(x.ngrams(w, 7).alias("none"), x.ngrams(w, 5).alias("two"), x.windows(w, 4, 2).alias("w")).first()
    assert row["none"] == [] and row["two"] == ["a b c d e", "b c d e f"] and [len(v) for v in row["w"]] == [4, 4]


def scores(spark, rows):
    return spark.createDataFrame(rows, "label int, prob double")


def test_metrics_on_four_rows(spark):
    s = scores(spark, [(0, 0.01), (0, 0.4), (1, 0.2), (1, 0.8)])
    assert metrics.auroc(s).first()["auroc"] == 0.75
    assert metrics.average_precision(s).first()["ap"] == 0.833333
    r = metrics.derived(metrics.sweep(s, [0.5])).first()
    assert (r["tp"] + r["fp"], r["precision"], r["recall"], r["f1"], r["fpr"]) == (1, 1.0, 0.5, 0.666667, 0.0)


def test_auroc_ties_and_symmetry(spark):
    s = scores(spark, [(1, 0.5), (0, 0.5), (1, 0.7), (0, 0.2), (0, 0.7)])
    flipped = s.withColumn("prob", 1 - F.col("prob"))
    assert abs(metrics.auroc(s).first()["auroc"] + metrics.auroc(flipped).first()["auroc"] - 1) < 1e-9
    assert metrics.tpr_at_fpr(scores(spark, [(1, 0.99)] * 5 + [(0, 0.01)] * 5), 0.01).first()["tpr"] == 1.0


def test_sweep_is_monotone(spark):
    rows = [((i * 7) % 3 == 0 and 1 or 0, (i * 37 % 101) / 101) for i in range(200)]
    got = metrics.derived(metrics.sweep(scores(spark, rows), [k / 20 for k in range(20)])).orderBy("threshold").collect()
    assert all(a["recall"] >= b["recall"] and a["fpr"] >= b["fpr"] for a, b in zip(got, got[1:]))


def test_exact_intervals():
    low, high = stats.clopper_pearson(0, 1342)
    assert low == 0 and abs(high - 0.0027) < 2e-4
    low, high = stats.clopper_pearson(5, 10)
    assert abs(low - 0.187086) < 1e-4 and abs(high - 0.812914) < 1e-4


def test_bootstrap_contains_point_and_repeats(spark):
    s = scores(spark, [(i % 2, 0.9 if i % 3 else 0.1) for i in range(80)])
    a, b = stats.bootstrap_f1(s).first(), stats.bootstrap_f1(s).first()
    assert a == b and a["low"] <= a["f1"] <= a["high"]


def test_paired_bootstrap_keeps_pairs(spark):
    """Equal models never differ; a better one on the same rows does, though both intervals overlap."""
    rows = [(i % 2, float(i % 7 != 0) if i % 2 else float(i % 5 == 0)) for i in range(400)]
    same = spark.createDataFrame([(y, p, p) for y, p in rows], "label int, prob double, prob_b double")
    for r in stats.paired_bootstrap(same).collect():
        assert (r["delta"], r["low"], r["high"], r["p_a_le_b"], r["overlap"], r["n_valid"]) == (0, 0, 0, 1, True, 10_000)
    worse = spark.createDataFrame([(y, p, 1 - p if i % 50 == 3 else p) for i, (y, p) in enumerate(rows)], "label int, prob double, prob_b double")
    got = {r["metric"]: r for r in stats.paired_bootstrap(worse).collect()}
    tp, fn, fp = (sum((y, p) == c for y, p in rows) for c in ((1, 1.0), (1, 0.0), (0, 1.0)))
    assert set(got) == {"f1", "kappa", "fpr"} and abs(got["f1"]["a"] - 2 * tp / (2 * tp + fn + fp)) < 1e-12
    assert got["f1"]["low"] <= got["f1"]["delta"] <= got["f1"]["high"] and got["f1"]["overlap"]
    assert got["f1"]["high"] - got["f1"]["low"] < got["f1"]["high_a"] - got["f1"]["low_a"]


def test_group_split_is_disjoint(spark):
    df = spark.range(400).select((F.col("id") % 60).alias("g"), (F.col("id") % 60 % 2).alias("label"), "id")
    got = splits.group_split(df, F.col("g"), "label")
    assert got.count() == 400
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()} == {"train": 42, "val": 9, "test": 9}


def test_sample_and_remainder(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    s = splits.sample(df, "k", 20)
    assert s.count() == 20 and df.join(s, "k", "left_anti").count() == 30
    assert {r.k for r in s.collect()} == {r.k for r in splits.sample(df, "k", 20).collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "m1.jsonl").write_text('{"query_id": "a", "refusal_rate": 0.5}\n\nnot json\n{"query_id": "b"}\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "m1.jsonl"), "query_id string, refusal_rate double")
    assert {r.query_id for r in good.collect()} == {"a", "b"} and [r.line for r in bad.collect()] == ["not json"]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "a int")[0].collect() == []
    assert readers.with_source(spark, str(tmp_path / "*.jsonl"), "query_id string").where("query_id = 'a'").first()["source_model"] == "m1"
    rule = {"rule_id": "R1", "category": "c", "title": "t", "permitted": "p", "restricted": "r", "rationale": "why", "threat_level_boundary": 3}
    assert readers.rules(spark, {"rules": [rule]}).count() == 1
    with pytest.raises(ValueError, match="rule 1"):
        readers.rules(spark, {"rules": [rule, {**rule, "threat_level_boundary": 9}]})
    assert readers.first_source(lambda: 1 / 0, lambda: 7) == 7
    sink = str(tmp_path / "sink")
    df = spark.createDataFrame([("a", "safe"), ("b", "unsafe")], "k string, fine_label string")
    readers.append_new(df, sink, "k", "fine_label")
    readers.append_new(df.unionByName(spark.createDataFrame([("c", "safe")], "k string, fine_label string")), sink, "k", "fine_label")
    assert sorted(r.k for r in spark.read.json(sink).collect()) == ["a", "b", "c"]


def test_streams(spark, tmp_path, tiny):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(f"{tiny}/events.parquet", tmp_path / "in" / "a.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.score_stream(stream, lambda s: s.select("event_id", (F.col("value") > 50).alias("flag")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    n = spark.read.parquet(f"{tiny}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_running_sums_and_quantiles(spark):
    """Against plain Python: skewed keys, null groups, one row, ties, an empty table."""
    import random

    rng = random.Random(3)
    data = [(g, float(rng.choice([0, 1, 2, rng.random() * 50])), rng.randrange(9)) for g in ("a", "b", None) for _ in range(700)] + [("one", 4.0, 1), ("none", None, 5)]
    df = spark.createDataFrame(data, "g string, v double, n long")
    unique = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    for descending in (False, True):
        rows = splits.running(unique.where("v IS NOT NULL"), "v", {"s": "n"}, "g", descending=descending).collect()
        for r in rows:
            mine = [(v, n) for g, v, n in data if g == r["g"] and v is not None]
            assert r["s"] == sum(n for v, n in mine if (v >= r["v"] if descending else v <= r["v"])) and r["s_all"] == sum(n for _, n in mine)
        assert len(rows) == len({(g, v) for g, v, _ in data if v is not None})
    out = metrics.with_quantiles(df.groupBy("g").agg(F.count(F.lit(1)).alias("rows")), df, "v", {"q1": 0.25, "q2": 0.5, "q99": 0.99}, "g")
    for r in out.collect():
        mine = [v for g, v, _ in data if g == r["g"] and v is not None]
        assert (r["q1"], r["q2"], r["q99"]) == (pytest.approx(tuple(np.quantile(mine, [0.25, 0.5, 0.99])), abs=1e-6) if mine else (None, None, None))
    empty = df.limit(0)
    assert splits.running(empty, "v", {"s": "n"}).collect() == []
    assert metrics.with_quantiles(empty.agg(F.count(F.lit(1)).alias("rows")), empty, "v", {"q": 0.5}).collect()[0]["q"] is None
    ranks = {r["v"]: r["rank"] for r in metrics.average_ranks(df, "v", "rank").collect()}
    values = sorted(v for _, v, _ in data if v is not None)
    assert all(ranks[v] == pytest.approx((2 * values.index(v) + values.count(v) + 1) / 2) for v in set(values))


def test_undo_evasion_against_plain_python(spark, tiny):
    """Whole texts and hostile ones through the evasion normaliser, against its rules in plain Python."""
    import re
    import unicodedata

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        t = "".join(c for c in t if c not in "​‌‍⁠﻿­")
        t = re.sub(r"\b(?:\w\s){2,}\w\b", lambda m: m.group(0).replace(" ", ""), t)
        table = str.maketrans("@310$!54", "aeiosisa")
        return " ".join(w.translate(table) if sum(c.isalpha() for c in w) >= 2 and any(c in "@310$!54" for c in w) else w for w in t.split(" "))

    texts = ["h0w t0 m@ke a c@k3", "k i l o   t h e   c e l l", "normal text 2024", "a b", "a b c", "a b\nc d e", "s​t­op", "ﬁne ①②", "é è à ô", "a  b  c", "5o5 $100 !!", "", "x " * 30_000, "a b cd e f g"]
    texts += [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").limit(120).collect() if r["text"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["text"] for r in x.undo_evasion_columns(df, "text").collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_verdict_parsers(spark):
    rows = ["Harmful request: YES\nHarmful response: no", "safety:  Controversial", "  UNSAFE\nS1", "safety first", "", "<think>unsafe</think> it is safe, though dangerous", "should be flagged, no: not flagged", "unharmful", "Response harm: unharmful but flag it", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    t = F.col("t")
    got = df.select("i", x.yes_no(t, "Harmful request").alias("q"), x.yes_no(t, "Harmful response").alias("r"), x.graded(t).alias("g"), x.graded(t, unsure=1).alias("u"), x.leading(t).alias("l"), x.free_verdict(t).alias("v")).orderBy("i").collect()
    assert [(r["q"], r["r"]) for r in got][:2] == [(1, 0), (None, None)]
    assert (got[1]["g"], got[1]["u"], got[2]["g"]) == (0, 1, None) and [r["l"] for r in got[2:5]] == [1, 0, None]
    assert [tuple(r["v"]) for r in got[4:]] == [("unknown", ""), ("harmful", "dangerous"), ("unharmful", "not-flagged"), ("unharmful", "unharmful"), ("unharmful", "structured"), ("unknown", "")]


def test_pairs_and_release_form_against_plain_python(spark, tiny):
    """X13 and X15 on whole tables."""
    import hashlib
    import unicodedata

    from sievework import registry

    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    turns = {}
    for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect():
        at = (r["conv_id"], r["turn"])
        turns[at] = min(turns.get(at, r["text"]), r["text"])
    want = {at: (sha(plain_normalize(t)), sha(plain_normalize(turns[at[0], at[1] + 1])) if (at[0], at[1] + 1) in turns else None) for at, t in turns.items()}
    got = {(r["conv_id"], r["turn"]): (r["prompt"], r["response"]) for r in registry.queries()["x13_pair_normalize"](spark, tiny).collect()}
    assert got == want

    def short(t):
        t = "".join(c for c in t if not ("​" <= c <= "‏" or "‪" <= c <= "‮" or "⁠" <= c <= "⁤" or c in "﻿­" or "︀" <= c <= "️" or "\U000e0000" <= c <= "\U000e007f" or "\U000e0100" <= c <= "\U000e01ef"))
        return unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Mc")))

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    out = {r["doc_id"]: r["digest"] for r in registry.queries()["x15_release_normalize"](spark, tiny).collect()}
    assert out == {i: sha(short(t)) if t is not None else None for i, t in texts.items()}
