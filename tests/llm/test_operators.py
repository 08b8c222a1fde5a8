"""The registered queries against brute force on whole small tables, and the operators on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from sievework.llm import decontam, lines, mixing, near_dedup, pii, quality, queries, sharding, substring, toxicity, url_filter

NASTY = [
    (1, "a@b.c_d@e.fg 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (234) 567-8901"),
    (2, None), (3, ""), (4, " \t\n "), (5, "word"), (6, "x " * 3000 + "end"), (7, "4111-1111-1111-1112 +12 34"),
    (8, "one two three four five six seven eight nine " * 4), (9, "Line a\nLine a\n\nLine b 😀 é\nx|y"), (10, "9" * 3000 + "." + "1" * 3000), (10, "9" * 3000 + "." + "1" * 3000),
    (None, "no id here a@b.cd"), (12, "😀😀 mail me: q@x.org, 😀"),
]


@pytest.fixture(scope="module")
def nasty(spark):
    df = spark.createDataFrame(NASTY, "doc_id bigint, text string")
    for clash in ("n_words", "id", "key", "component", "size", "spans", "kept", "value", "tag", "lang"):
        df = df.withColumn(clash, F.lit("clash"))
    return df.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("s1")))


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_pii_base(spark, small, rows, nasty, tmp_path):
    got = by_id(queries.op1_pii(spark, small))
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["base_sha256"] == brute.base_sha(t)
    out = pii.find_pii(nasty).collect()
    assert len(out) == len(NASTY)
    want = {i: brute.base_spans(t) for i, t in NASTY}
    for r in out:
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["base"]] == want[r["doc_id"]]


def test_pii_bootstrap_finds_unseen(spark):
    texts = [f"staff record: contact mail {n}@corp.example for help" for n in ("ann", "bob", "cyd", "dee", "eve")]
    texts += ["staff record: contact mail zed9(at)corp.example for help", "a plain year 1999 in prose"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["found"]] for r in got}
    assert found[5] == [("email", "zed9(at)corp.example")]
    assert found[6] == []


def _found(spark, texts):
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {r["doc_id"]: [(s["kind"], s["value"]) for s in r["found"]] for r in got}


def test_pii_bootstrap_takes_any_slot_word(spark):
    texts = [f"staff record: contact mail {n}@corp.example for help" for n in ("ann", "bob", "cyd", "dee", "eve")]
    texts += ["staff record: contact mail zed(at)corp.example for help"]
    assert _found(spark, texts)[5] == [("email", "zed(at)corp.example")]


def test_pii_bootstrap_counts_all_slot_words(spark):
    texts = [f"the list of {n}@corp.example is here" for n in ("ann", "bob", "cyd", "dee", "eve", "fay", "guy")]
    texts += [f"some talk of {w} now" for w in ("rain", "snow", "wind", "hail", "mist", "dew", "fog", "1999", "2001")]
    found = _found(spark, texts)
    assert all(found[i] == [] for i in range(len(texts)))


def test_pii_bootstrap_runs_to_the_end(spark):
    """Each slot vouches for the words that make the next one trusted."""
    texts = [f"see slot0 {w}@x.org end" for w in ("a", "b", "c", "d", "e")]
    for k in range(3):
        for i in range(5):
            texts += [f"see slot{k} key{k}a{i}(at)x.org end", f"see slot{k + 1} key{k}a{i}(at)x.org end"]
    found = _found(spark, texts)
    assert all(found[i] for i in range(5, len(texts)))
    assert found == brute.bootstrap(texts)


def planted():
    """Records with labelled identifiers, most in a form the fixed patterns know, some in one they don't; decoys of like
    shape stand elsewhere. Returns texts and the unseen (text number, kind, value)."""
    import random

    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "do", "mi", "ter", "lun", "so") for b in ("ra", "len", "kat", "vo", "pist")]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep):
        body = "4" + digits(14)
        last = next(d for d in "0123456789" if brute.luhn(body + d))
        return sep.join((body + last)[i : i + 4] for i in range(0, 16, 4))

    forms = {
        "email": ("E-mail:", lambda: f"{rng.choice(words)}{digits(3)}@corp.example", lambda: f"{rng.choice(words)}{digits(3)}(at)corp[dot]example"),
        "phone": ("Phone:", lambda: f"+49{digits(9)}", lambda: f"0{digits(3)}/{digits(6)}"),
        "ip": ("address =", lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), lambda: "[.]".join(str(rng.randrange(1, 255)) for _ in range(4))),
        "card": ("card no.:", lambda: card(" "), lambda: card(".")),
    }
    texts, unseen = [], set()
    for i in range(240):
        kind = list(forms)[i % 4]
        label, known, other = forms[kind]
        new = i % 12 < 4
        value = (other if new else known)()
        if new:
            unseen.add((i, kind, value))
        decoy = rng.choice([f"order {digits(4)}-{digits(2)}-{digits(4)}", f"book 978-3-16-{digits(6)}-0", f"version {digits(1)}.{digits(2)}.{digits(1)}", f"on 12:{digits(2)}:{digits(2)} sharp", f"part {digits(16)}"])
        texts.append(f"{some(6)} {decoy} {some(3)}.\n{label} {value}, {some(4)}. İ {some(2)}")
    return texts, unseen


def test_pii_planted(spark):
    """Precision and recall of what the bootstrap finds beyond the fixed patterns, by kind; the README has the figures."""
    texts, unseen = planted()
    found = _found(spark, texts)
    got = {(i, k, v) for i, x in found.items() for k, v in x}
    assert len(got & unseen) >= 0.95 * len(got)
    for kind in ("email", "phone", "ip", "card"):
        assert len({x for x in got & unseen if x[1] == kind}) >= 0.9 * len({x for x in unseen if x[1] == kind})
    assert found == brute.bootstrap(texts)


def test_pii_offsets_and_overlaps(spark):
    """Ends count characters of the text, whatever lower case does to them; found spans keep off the base ones."""
    texts = [f"contact mail: {n}@corp.example for help" for n in ("ann", "bob", "cyd", "dee", "eve")] + ["contact mail: İvan9(at)corp.example for help"]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[5]["found"]] == [(14, 35)]
    table = " ".join(f"192.168.7.{i % 250} 10-0-0-{i % 200} x" for i in range(3000))
    long = pii.find_pii(spark.createDataFrame([(1, table)], "doc_id bigint, text string")).first()
    assert len(long["base"]) == 3000 and long["base"][2999]["end"] <= len(table)


def test_pii_small_table_finds_nothing_false(spark, small):
    assert pii.find_pii(spark.read.parquet(f"{small}/documents.parquet")).where(F.size("found") > 0).count() == 0


def test_quality(spark, small, rows, nasty):
    got = by_id(queries.op2_quality(spark, small))
    for i, t in rows:
        want = brute.quality_base(t)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["base_failed"] and got[i]["kept"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    judged = [(labels[i], got[i]["quality"] >= 0.5) for i in labels if i in got]
    assert sum(bool(q) == k for q, k in judged) > 0.95 * len(judged)
    out = quality.judge_narrow(nasty).collect()
    assert len(out) == len(NASTY)
    for r in out:
        want = brute.quality_base(dict(NASTY)[r["doc_id"]])
        assert (r["_f"]["n_words"], r["_f"]["n_repeat_words"], r["_f"]["n_dup_lines"]) == (want["n_words"], want["n_repeat_words"], want["n_dup_lines"])
    assert quality.filter_quality(nasty.limit(0)).collect() == []
    assert quality.filter_quality(nasty).columns == nasty.columns


def test_near_dedup(spark, small, rows, nasty):
    want = brute.near_components(rows, 2)
    got = by_id(queries.op3_near_dedup(spark, small))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    out = near_dedup.near_duplicates(nasty, size=2).collect()
    assert len(out) == len(NASTY)
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in out)
    assert near_dedup.near_duplicates(nasty.limit(0)).collect() == []
    kept = near_dedup.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns and kept.count() == len(NASTY) - 1


def test_near_dedup_same_id_other_text(spark):
    """Two documents with one doc_id both stay, unless their group has a smaller id."""
    a, b, c = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (3, c), (0, c), (3, "other words here")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(docs).collect())
    assert got == sorted([(1, a), (1, b), (0, c)])


def test_hot_keys_join_alike(spark, monkeypatch):
    from sievework.llm import _common

    monkeypatch.setattr(_common, "HOT_KEYS", 2)
    big = spark.range(9000).select((F.col("id") % 7 * (F.col("id") % 3 > 1).cast("int")).alias("k"), "id")
    one = big.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("_n"))
    want = sorted(map(tuple, big.join(one.drop("_n"), "k").collect()))
    assert sorted(map(tuple, _common.hot_join(big, one, ["k"]).select("k", "id", "top").collect())) == want
    tagged, spread = _common.salt_hot(big, one.select("k", "_n"), "k", F.col("id"))
    assert sorted(map(tuple, tagged.join(spread(one.drop("_n")), ["k", "_salt"]).select("k", "id", "top").collect())) == want


@pytest.mark.parametrize("n", [20, 60, 150, 300, 700])
def test_estimate_margin_keeps_links(n):
    """Pairs of small sets at a similarity of 0.8 are not ruled out; most unlike pairs of larger ones are."""
    import numpy as np

    rng, lost, passed = np.random.default_rng(n), 0, 0
    least = float(near_dedup.least_estimate(80, np.array([n]))[0])
    for _ in range(400):
        u = rng.integers(0, 2**63, 3 * n, dtype=np.int64).view(np.uint64)
        k = -(-8 * n // 9)  # shared of two sets of n: Jaccard 0.8
        a, b = np.sort(u[:n]), np.sort(np.concatenate([u[:k], u[n : 2 * n - k]]))
        lost += near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b)) < least
        c = np.sort(np.concatenate([u[: n // 10], u[2 * n : 3 * n - n // 10]]))
        passed += near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(c)) >= least
    assert lost == 0 and (n < 60 or passed < 40)


@pytest.mark.parametrize("block", [256, 3])
def test_near_dedup_chain_in_one_bucket(spark, monkeypatch, block):
    """A chain of near copies whose ends are far apart is one component, however buckets are cut."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [(0, " ".join(words))]
    for i in range(1, 40):
        words = list(words)
        words[rng.randrange(120)] = f"n{i}"
        words[rng.randrange(120)] = f"m{i}"
        docs.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=2).collect()
    want = brute.near_components(docs, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_cross_pairs_lose_no_link(spark, monkeypatch):
    """One bucket with a large component, many small ones and a doc_id with two texts: every link between components."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in range(rng.randrange(1, 9)):
            words[rng.randrange(60)] = f"x{i}_{k}" if i % 3 else f"y{k}"
        texts.append((i, " ".join(words)))
    texts.append((7, "quite another text of few words"))
    members = spark.createDataFrame([(1, i, 0 if i % 2 else i) for i in range(60)], "key bigint, b bigint, c bigint")
    docs = spark.createDataFrame(texts, "id bigint, text string")
    likely = near_dedup.cross_pairs(members, docs, 2, 80)
    got = {(r["a"], r["b"]) for r in near_dedup.verify(likely, docs, 2, 80, True).distinct().collect()}
    sets = [(i, {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)}) for i, t in texts]
    want = {(min(i, j), max(i, j)) for i, x in sets for j, y in sets if i != j and (i % 2 == 0 or j % 2 == 0) and 100 * len(x & y) >= 80 * len(x | y)}
    assert want and got == want


def test_hyperminhash_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for shared in (0.9, 0.6, 0.2):
        u = rng.integers(0, 2**63, 4000, dtype=np.int64).view(np.uint64)
        k = int(4000 * shared)
        a, b = np.sort(u[: k + (4000 - k) // 2]), np.sort(np.concatenate([u[:k], u[k + (4000 - k) // 2 :]]))
        assert abs(near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b)) - shared) < 0.1


def test_line_dedup(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    want = sorted(con.sql(queries.OP4_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op4_line_dedup(spark, small).select("page_id", "host", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want
    df = spark.createDataFrame([(i, "http://h.example/x", f"same line\nown {i}") for i in range(9)] + [(100, None, None), (101, "nourl", "same line")], "page_id bigint, url string, html string")
    out = {r["page_id"]: r for r in lines.dedup_lines(df, html=False).collect()}
    assert out[3]["kept_text"] == "own 3" and out[100]["n_lines"] == 0 and out[101]["kept_text"] == "same line"


def brute_lines(pages, ratio, min_pages):
    """page_id, number of lines, what is kept, per page in order."""
    text = lambda t: [x for x in (re.sub(r"[\x20\x09-\x0D]+", " ", v).strip(" ") for v in (t or "").split("\n")) if x]
    host = lambda u: re.split(r"[/?#]", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
    total, held = Counter(), Counter()
    for _, u, t in pages:
        total[host(u)] += 1
        held.update((host(u), x) for x in set(text(t)))
    out = []
    for i, u, t in pages:
        h = host(u)
        gone = lambda x: total[h] >= min_pages and held[h, x] > 1 and held[h, x] > ratio * total[h]  # noqa: B023,E731
        out.append((str(i), h, len(text(t)), "\n".join(x for x in text(t) if not gone(x))))
    return sorted(out)


@pytest.mark.parametrize("few", [False, True])
def test_line_dedup_awkward_rows(spark, monkeypatch, few):
    """Nulls, empty and very long texts, a hot host, repeated rows, lines exactly at the ratio, clashing names, an empty
    table; with and without broadcasts."""
    if few:
        monkeypatch.setattr(lines, "maybe_broadcast", lambda df, rows: df)
    pages = [(i, f"http://hot.example/{i}", f"menu\nbody {i}\n{'at ratio' if i < 90 else 'below'}\n{'rare' if i < 2 else ''}") for i in range(300)]
    pages += [(500 + i, "http://Few.example", "menu\nmenu") for i in range(4)] + [(600, None, "menu"), (601, "nourl", None), (602, "http://hot.example", ""), (602, "http://hot.example", ""), (None, "http://hot.example?q", " menu \r\n\t x")]
    pages += [(700, "http://long.example/", "\n".join(f"line {k}" for k in range(60_000))), (701, "http://long.example/", "w " * 500_000)] + [(702, "http://long.example/", "line 7\nline 7")] * 3
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for clash in ("host", "lines", "hashes", "drop", "n", "h", "kept", "pages"):
        df = df.withColumn(clash, F.lit("clash"))
    got = sorted((str(r["page_id"]), r["host"], r["n_lines"], r["kept_text"]) for r in lines.dedup_lines(df, html=False, ratio=0.3).collect())
    assert got == brute_lines(pages, 0.3, 5)
    assert lines.dedup_lines(df.limit(0), html=False).collect() == []


def test_sharding(spark, small, nasty):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    got = queries.op5_sharding(spark, small).collect()
    assert len({r["doc_id"] for r in got}) == n == len(got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op5_sharding(spark, small).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    out = sharding.shard(nasty, n_shards=3, bucket_bytes=500)
    assert out.columns == [*nasty.columns, "shard", "slot"]
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in NASTY)
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s, m in ((0, 4), (1, 4), (2, 5)) for k in range(m)]
    assert sharding.shard(nasty.limit(0)).collect() == []


def test_sharding_against_reference(spark, tmp_path):
    """Every place follows from the hash buckets and one seeded permutation of each; files hold the same."""
    import numpy as np

    rows = [(i if i % 7 else None, f"text {i % 40} " * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = max(6, -(-sum(len(t or "") + 16 for _, t in rows) // 700))
    key = lambda seed: F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))
    buckets = {}
    for r in docs.select("doc_id", "text", F.pmod(key(7), F.lit(n)).alias("b"), key(8).alias("o")).collect():
        buckets.setdefault(r["b"], []).append((r["o"], r["doc_id"], r["text"]))
    every = []
    for b in sorted(buckets):
        order = np.arange(len(buckets[b]))
        np.random.Generator(np.random.PCG64([7, b])).shuffle(order)
        every += [sorted(buckets[b], key=lambda x: x[0])[k][1:] for k in order]
    cut = [300 * s // 6 for s in range(7)]
    want = sorted((str(i), t, s, k) for s in range(6) for k, (i, t) in enumerate(every[cut[s] : cut[s + 1]]))
    sharding.write_shards(docs, f"file://{tmp_path}/out", n_shards=6, bucket_bytes=700)
    for got in (sharding.shard(docs, n_shards=6, bucket_bytes=700), spark.read.parquet(f"file://{tmp_path}/out")):
        assert sorted((str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in got.collect()) == want


def test_shuffle_is_uniform(spark):
    """First slots are not tied to input order."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(df, n_shards=4).collect()
    mean = sum(r["doc_id"] for r in got if r["shard"] == 0) / 1000
    assert abs(mean - 2000) < 150


def test_toxicity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = by_id(queries.op6_toxicity(spark, small))
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(r.toxic, got[r.doc_id]["score"]) for r in labels.collect() if got[r.doc_id]["held_out"]]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc > 0.8
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = by_id(toxicity.score_toxicity(docs, flipped))
    assert all(abs(same[i]["score"] - got[i]["score"]) < 1e-12 for i in got)
    none = toxicity.score_toxicity(docs.limit(3), labels.limit(0)).collect()
    assert [r["predicted"] for r in none] == [0, 0, 0]


def test_toxicity_keeps_every_significant_feature(spark):
    """21,000 toxic and as many clean words, too short for prefixes."""
    import itertools

    every = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnop", repeat=4), 42_000)]
    toxic, clean = every[::2], every[1::2]
    docs = [(i, " ".join(toxic if i % 2 else clean)) for i in range(120)]
    docs += [(1000 + i, w) for i, w in enumerate(toxic)] + [(999, f"{toxic[0]} {clean[0]} {clean[1]} {toxic[1]}")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int")
    out = toxicity.score_toxicity(docs, labels).where("doc_id >= 999").select("doc_id", F.col("n_maximal").alias("n"))
    assert out.where("doc_id > 999 AND n = 1").count() == 21_000
    assert out.where("doc_id = 999").first()["n"] == 2


def test_maximal_segments_brute():
    import random

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 14)
        s = [rng.choice([-0.25, -0.25, 1.0, 0.3]) for _ in range(n)]
        at = [i for i in range(n) if s[i] > 0]
        got = toxicity.maximal_segments(at, [s[i] for i in at], -0.25)
        best = max((sum(s[i:j]) for i in range(n) for j in range(i + 1, n + 1)), default=0)
        assert abs(max((x for _, _, x in got), default=best if best <= 0 else -9) - best) < 1e-9
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


def test_all_maximal_segments_brute():
    """All segments, not the best alone: the best one, then those of what lies before and after it."""
    import random

    def brute_segments(s, lo, hi):
        every = [(sum(s[i:j]), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        if not every or max(every)[0] <= 0:
            return []
        total, i, j = max(every)
        return [*brute_segments(s, lo, -i), (-i, j - 1, total), *brute_segments(s, j, hi)]

    rng = random.Random(6)
    for _ in range(150):
        s = [rng.uniform(-1.5, 1) for _ in range(rng.randrange(1, 16))]
        at, sums = [i for i in range(len(s)) if s[i] > 0], [sum(s[:i]) for i in range(len(s) + 1)]
        got = toxicity._segments(at, [sums[i] for i in at], [sums[i + 1] for i in at])
        want = brute_segments(s, 0, len(s))
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_toxicity_awkward_rows(spark, nasty):
    """Nulls, empty and long texts, clashing names, an empty table, labels given twice; E-values of what is listed."""
    words = [(i, ("vile scum " if i % 2 else "kind word ") + "filler text " * 10) for i in range(80)] + [(200, "vile scum " * 3 + "filler " * 60_000 + "vile scum vile scum"), (201, None), (201, None), (None, "vile scum")]
    docs = spark.createDataFrame(words, "doc_id bigint, text string")
    for clash in ("toxic", "n", "best", "segments", "h", "score"):
        docs = docs.withColumn(clash, F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 0), (None, 1), (5, None)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(words)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["predicted"] == 1 and by[2]["predicted"] == 0 and by[201]["predicted"] == 0 and by[None]["predicted"] == 1
    assert all(s["e_value"] <= 0.5 for r in out for s in r["segments"])
    every = toxicity.score_toxicity(docs, labels, max_e=float("inf")).where("doc_id = 200").first()
    assert [(s["start"], s["end"]) for s in every["segments"]] == [(0, 6), (60_006, 60_010)] and every["n_maximal"] == 2
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []
    assert len(toxicity.score_toxicity(nasty, labels).collect()) == len(NASTY)


def test_substring(spark, small, rows, nasty):
    want = brute.substring(rows, 50)
    got = by_id(queries.op7_substring_dedup(spark, small))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(x[1] for x in want.values()) > 0
    out = substring.dedup_substrings(nasty, window=5 + 10).collect()
    assert len(out) == len(NASTY)
    assert substring.dedup_substrings(nasty.limit(0)).collect() == []


def test_word_windows_of_long_arrays(monkeypatch):
    """Slabs and linear minima give what the plain forms give."""
    import numpy as np

    from sievework.llm import _words

    rng = np.random.default_rng(3)
    for n, width in ((5, 5), (100, 7), (1000, 41), (999, 2)):
        v = rng.integers(0, 30, n).astype(np.uint64)
        want = np.arange(n - width + 1) + np.lib.stride_tricks.sliding_window_view(v, width).argmin(axis=1)
        assert (_words.sliding_argmin(v, width) == want).all()
    v = rng.integers(0, 255, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4900, 300))
    plain = _words.run_hashes(v, starts, starts + 70)
    monkeypatch.setattr(_words, "CHUNK_BYTES", 256)
    assert (_words.run_hashes(v, starts, starts + 70) == plain).all()
    (c,) = _words.chunks(__import__("pyarrow").array([" a  bc\n", None, "d"]))
    spelled, first, last = c.spelled()
    assert spelled.tobytes() == b"a bc d " and first.tolist() == [0, 2, 5] and last.tolist() == [1, 4, 6]


@pytest.mark.parametrize("n_batches", [1, 5])
def test_substring_small_windows(spark, n_batches):
    import random

    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for i in range(60):
        w = [rng.choice("abcdefgh") + str(rng.randrange(5)) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            lo = rng.randrange(30)
            w = w[:20] + passage[lo : lo + rng.randrange(10, 31)] + w[20:]
        docs.append((i, " ".join(w)))
    want = brute.substring(docs, 14)
    got = substring.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string"), window=14, n_batches=n_batches).withColumn("h", F.sha2("kept_text", 256)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in got} == want


def test_index_lives_on_in_other_sessions(spark, tmp_path):
    """Three crawls by three sessions on one folder give what one pass gives; wrong batches and windows are refused."""
    import random

    rng = random.Random(6)
    passages = [" ".join(f"p{k}w{rng.randrange(400)}" for _ in range(70)) for k in range(6)]
    texts = [(k, " ".join([f"own{k}x{i}" for i in range(rng.randrange(60))] + [rng.choice(passages)] * rng.randrange(1, 3) + [f"end{k}x{i}" for i in range(rng.randrange(30))])) for k in range(90)]
    want = brute.substring(texts, 50)
    at, cuts, got = f"{tmp_path}/index", (0, 30, 61, 90), {}
    for lo, hi in zip(cuts, cuts[1:]):
        session = spark.newSession()
        table = lambda rows, s=session: s.createDataFrame(rows, "doc_id bigint, text string")
        index = substring.FingerprintIndex(session, 50, path=at)
        assert index.highest == (None if lo == 0 else lo - 1)
        out = substring.dedup_batch(table(texts[lo:hi]), table(texts[:hi]), index)
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()}
    assert got == want and sum(x[1] for x in got.values()) > 2000
    again = substring.FingerprintIndex(spark, 50, path=at)
    assert again.generation == 3 and sorted(p.name for p in (tmp_path / "index" / "runs").iterdir()) == sorted(n for _, n in again.runs)
    with pytest.raises(ValueError, match="holds ids up to 89"):
        substring.dedup_batch(spark.createDataFrame(texts[5:6], "doc_id bigint, text string"), spark.createDataFrame(texts, "doc_id bigint, text string"), again)
    with pytest.raises(ValueError, match="windows of 50 words"):
        substring.FingerprintIndex(spark, 20, path=at)
    late = substring.FingerprintIndex(spark, 50, path=at)
    late.generation -= 1
    with pytest.raises(RuntimeError, match="another writer"):
        late._commit()


def test_mixing(spark, small, nasty):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.OP8_SQL).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in queries.op8_mixing(spark, small).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][:2] == want[i][:2] and got[i][3] == want[i][3] and abs(got[i][2] - want[i][2]) < 1e-6 * want[i][2]
    out = mixing.mix(nasty).collect()
    assert len(out) == len(NASTY) and all(0 <= r["_copies"] <= 3 for r in out)
    assert mixing.mixed_documents(nasty).columns == nasty.columns
    assert mixing.mix(nasty.limit(0)).collect() == []


def test_mixing_ties(spark):
    """Copies of one text, each with its own id, and rows that are alike in all: whole copies only, near the target."""
    rows = [(i, "same words here", "a") for i in range(100)] + [(1000 + i, f"w {i} x y", None) for i in range(60)] + [(7, "same words here", "b")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    for s in ("a", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["_size"] * r["_copies"] for r in mine) - mine[0]["_target"]) <= 4


def test_mixing_capped_source(spark):
    """A tiny source that would get more than three times its size stops there; the rest share the excess."""
    rows = [(i, "w " * 100, "big") for i in range(30)] + [(100 + i, "w w", "tiny") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    tiny = [r for r in got if r["source"] == "tiny"]
    assert all(r["_copies"] == 3 for r in tiny) and abs(tiny[0]["_target"] - 18) < 1e-9
    big = [r for r in got if r["source"] == "big"]
    assert abs(big[0]["_target"] - (3006 - 18)) < 1e-9
    assert abs(sum(r["_size"] * r["_copies"] for r in big) - 2988) <= 50


def test_decontamination(spark, small, rows):
    got = queries.op9_decontamination(spark, small).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    import re

    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    want = {(d, i) for d, t in rows for i, x in items if norm(x) in norm(t or "")}
    assert {(r["doc_id"], r["item_id"]) for r in got} >= want
    assert {r["doc_id"] for r in got} == {d for d, _ in want}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = decontam.decontaminate(docs, spark.read.parquet(f"{small}/benchmark.parquet"), max_items=7)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.decontaminate(docs, spark.read.parquet(f"{small}/benchmark.parquet").limit(0)).count() == len(rows)


def bm25_tables():
    """Items, and texts that hold pieces of them: whole, with replaced words, cut, or only some of their words."""
    import random

    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 90))) + ". " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    texts = []
    for d in range(90):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        piece = items[rng.randrange(60)][1].split()
        for _ in range(d % 7):
            piece[rng.randrange(len(piece))] = rng.choice(words)
        at = rng.randrange(len(body) + 1)
        texts.append((d, " ".join(body[:at] + piece[: len(piece) - (d % 4) * 3] + body[at:])))
    return texts + [(90, None), (91, ""), (None, items[3][1]), (92, items[3][1]), (92, items[3][1])], items + [(60, None), (61, "")]


def test_decontamination_against_bm25(spark):
    """Hits and scores equal plain BM25 over all passages, whatever the parts; a long item changes no other hit."""
    texts, items = bm25_tables()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("score", F.lit("clash"))
    bench = lambda rows: spark.createDataFrame(rows, "item_id bigint, text string")
    hits = lambda out: sorted((str(r["doc_id"]), str(r["item_id"]), round(r["score"], 4)) for r in out.collect())
    for threshold in (0.6, 0.9):
        want = sorted((str(d), str(i), round(round(s, 6), 4)) for d, i, s in brute.bm25_hits(texts, items, threshold, 0.5, 0.5))
        assert want and hits(decontam.contaminated(docs, bench(items), threshold=threshold)) == want
        assert hits(decontam.contaminated(docs, bench(items), threshold=threshold, max_items=9)) == want
    long = [(99, " ".join(f"long{k}" for k in range(3000)))]
    some = hits(decontam.contaminated(docs, bench(items)))
    assert [x[:2] for x in hits(decontam.contaminated(docs, bench(items + long)))] == [x[:2] for x in some]
    clean = decontam.decontaminate(docs, bench(items), max_items=25)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in texts if str(d) not in {x[0] for x in some})
    assert decontam.contaminated(docs.limit(0), bench(items)).collect() == [] == decontam.contaminated(docs, bench(items).limit(0)).collect()


def test_decontamination_other_ids_and_edits(spark):
    """Ids of any type, a word replaced in the middle of a short question, a very long text."""
    item = "which of the rivers of the old land runs to the northern sea before winter? the grey one"
    edit = item.replace("land", "world")
    docs = spark.createDataFrame([("a", f"so {edit} yes"), ("b", "nothing here"), ("c", "pad word " * 200_000 + item)], "doc_id string, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([("q1", item)], "item_id string, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [("a", "q1"), ("c", "q1")]


def test_wand_returns_all_above_threshold():
    import random

    import numpy as np

    rng = random.Random(2)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 30)))) for i in range(300)]
    (index,) = decontam.build_indexes(items, decontam.own_statistics([t for _, t in items]))
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 40))))
        score = np.zeros(len(items))
        for t in terms:
            lo, hi = index.at[t], index.at[t + 1]
            score[index.items[lo:hi]] += index.weights[lo:hi]
        for threshold in (0.2, 0.5, 0.8):
            clear = {i for i in np.flatnonzero(abs(score - threshold) > 1e-9) if score[i] >= threshold}
            assert {i for i, _ in decontam.search(index, terms, threshold) if abs(score[i] - threshold) > 1e-9} == clear


def test_url_filters(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, queries.op10_url_filters(spark, small).collect())) == sorted(map(key, con.sql(queries.OP10_SQL).fetchall()))
    urls = [(1, "http://WWW.Example.com/en/x?q"), (2, "https://a.example.com/en/"), (3, "http://notexample.com/en/"), (4, None), (5, "no url"), (6, "http://x.net/es/1"), (6, "http://x.net/es/1"), (7, "http://x.net"), (8, "http://spam-farm.example.org/"), (9, "http://"), (10, "http://com#f")]
    out = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id bigint, url string")).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert out == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "notexample.com", "/en/", "com/", "allow"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "x.net", "/es/1", "net/es/", "block"), (7, "x.net", "", None, "allow"), (8, "spam-farm.example.org", "/", None, "block"), (9, "", "", None, "allow"), (10, "com", "", None, "allow"),
    }


def test_url_patterns(spark, monkeypatch):
    """Anchors, wildcards, separators, rules without a token, ties, clashing names and empty tables, by either path."""
    urls = [(1, "http://a.ads7.example/x"), (2, "http://x.org/Login|a"), (3, "http://x.org/q/wp-login.php?a=1"), (4, "http://x.org/wp-login.php5"), (5, "http://x.org/track/9/8/click"), (6, "http://x.org/track/9/clicks"),
            (7, "http://tracker.x.org"), (8, "http://my.tracker.x.org"), (9, "http://x.org/a.b(c)"), (10, "http://x.org/zz"), (11, None), (11, None), (12, "http://" + "a" * 100_000 + ".org/zz")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    for clash in ("host", "path", "rule", "verdict", "token", "regex", "name"):
        pages = pages.withColumn(clash, F.lit("clash"))
    rules = [("||ads*.example^", "block", None), ("/wp-login.php|", "block", None), ("/track/*/click^", "block", None), ("|tracker.", "block", None), ("a.b(c)", "block", None), ("zz", "block", "zz"), ("/zz", "allow", "yy"), (None, "block", None), ("zz", "block", "zz")]
    table = spark.createDataFrame(rules, "pattern string, verdict string, name string")
    want = [(1, None, "block"), (2, None, "allow"), (3, None, "block"), (4, None, "allow"), (5, None, "block"), (6, None, "allow"), (7, None, "block"), (8, None, "allow"), (9, None, "block"), (10, "yy", "allow"), (11, None, "allow"), (11, None, "allow"), (12, "yy", "allow")]
    for few in (2_000, 0):
        monkeypatch.setattr(url_filter, "FEW", few)
        got = url_filter.filter_urls(pages, rules=table).select("page_id", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert url_filter.filter_urls(pages.limit(0)).collect() == []
        assert {r["verdict"] for r in url_filter.filter_urls(pages, rules=table.limit(0)).collect()} == {"allow"}


def test_many_url_rules(spark):
    """A hundred thousand rules from a table, of which a thousand have no token."""
    rules = spark.range(99_000).select(F.concat(F.lit("||h"), "id", F.lit(".example^")).alias("pattern"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("name"))
    wild = spark.range(1_000).select(F.concat(F.lit("*"), F.translate(F.col("id").cast("string"), "0123456789", "!$&'(),;@~"), F.lit("*")).alias("pattern"), F.lit("block").alias("verdict"), F.concat(F.lit("w"), "id").alias("name"))
    urls = [(1, "http://h7.example/a"), (2, "http://h98999.example"), (3, "http://h99000.example/"), (4, "http://x.org/a(b"), (5, "http://x.org/$&'"), (6, None)]
    got = url_filter.filter_urls(spark.createDataFrame(urls, "page_id bigint, url string"), rules=rules.unionByName(wild)).collect()
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow"}


def test_pipeline(spark, small, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in queries.op2_quality(spark, small).collect() if r["kept"]}
    texts = {i: t for i, t in rows if i in kept}
    parts = brute.near_components(list(texts.items()), 5)
    leaks = {r["doc_id"] for r in queries.op9_decontamination(spark, small).collect()}
    want = {i for i, (_, c) in parts.items() if i == c} - leaks
    out = corpus_pipeline.run(spark, small)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert {r["doc_id"] for r in got} <= want
    counts = {}
    for r in got:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3
    total = sum(len(brute.WORD.findall(texts[i])) for i in want)
    assert abs(sum(len(brute.WORD.findall(r["text"])) for r in got) - total) < 0.02 * total


def test_pipeline_awkward_rows(spark, nasty, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names; tables without rows."""
    import corpus_pipeline

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "source")
    docs = nasty.unionByName(real, allowMissingColumns=True)
    leak = next(r.text for r in quality.filter_quality(real.where("source = 'src1'")).orderBy("doc_id").collect() if 30 < len(r.text.split()) < 400)
    item = spark.createDataFrame([(1, " ".join(leak.split()[:25])), (None, None)], "item_id bigint, text string")
    for name, d, b in (("some", docs, item), ("none", docs.limit(0), item), ("no_items", docs, item.limit(0))):
        at = str(tmp_path / name)
        d.write.parquet(f"{at}/documents.parquet")
        b.write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.columns == [*docs.columns, "shard", "slot"]
        got = out.collect()
        if name == "none":
            assert got == []
            continue
        assert len({r["doc_id"] for r in got if r["doc_id"]}) > 100
        assert (leak in {r["text"] for r in got}) <= (name == "no_items")
        places = [(r["shard"], r["slot"]) for r in got]
        assert len(set(places)) == len(places)
