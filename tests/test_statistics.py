"""Queries without SQL against brute force on whole small tables."""

import math
import re
import unicodedata
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import registry
from sievework.plans._base import scored, table
from sievework.plans.metric_queries import GRID
from test_units import plain_normalize

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def rows(spark, tiny):
    return scored(spark, tiny).toPandas()


def at_most(k, n, p):
    """P(X <= k) of a binomial, term by term."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def limits(k, n):
    """The two-sided 95 % exact interval, by bisection."""

    def root(f):
        lo, hi = 1e-12, 1 - 1e-12
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return lo

    return (0.0 if k == 0 else root(lambda p: 1 - at_most(k - 1, n, p) < 0.025)), (1.0 if k == n else root(lambda p: at_most(k, n, p) > 0.025))


def test_clopper_pearson(spark, tiny, rows):
    got = {r["lang"]: r for r in QUERIES["a24_clopper_pearson"](spark, tiny).collect()}
    assert set(got) == set(rows.lang)
    for lang, g in rows.groupby("lang"):
        k, n = int((g.prob >= 0.5).sum()), len(g)
        assert (got[lang]["k"], got[lang]["n"]) == (k, n)
        assert (got[lang]["low"], got[lang]["high"]) == pytest.approx(limits(k, n), abs=2e-6)


def test_mcnemar(spark, tiny, rows):
    a, b = ((rows[c] >= 0.5) == (rows.label == 1) for c in ("prob", "prob_b"))
    x, y = int((a & ~b).sum()), int((~a & b).sum())
    p = min(1.0, 2 * sum(math.comb(x + y, i) for i in range(min(x, y) + 1)) / 2 ** (x + y))
    r = QUERIES["a26_mcnemar_exact"](spark, tiny).first()
    assert (r["a_only"], r["b_only"]) == (x, y) and r["p_value"] == pytest.approx(p, abs=2e-6)


def f1(y, p):
    den = 2 * (y & p).sum(-1) + (y ^ p).sum(-1)
    return 2 * (y & p).sum(-1) / den


def test_bootstraps_against_resampled_rows(spark, tiny, rows):
    """The queries resample cells; here whole rows are drawn."""
    y, a, b = (rows.label == 1).to_numpy(), (rows.prob >= 0.5).to_numpy(), (rows.prob_b >= 0.5).to_numpy()
    pick = np.random.default_rng(7).integers(0, len(y), (4000, len(y)))
    fa, fb = f1(y[pick], a[pick]), f1(y[pick], b[pick])
    one = QUERIES["a27_bootstrap_f1"](spark, tiny).first()
    assert one["f1"] == pytest.approx(f1(y, a)) and (one["low"], one["high"]) == pytest.approx(tuple(np.percentile(fa, [2.5, 97.5])), abs=0.02)
    pair = {r["metric"]: r for r in QUERIES["a28_paired_bootstrap"](spark, tiny).collect()}
    assert pair["f1"]["delta"] == pytest.approx(f1(y, a) - f1(y, b))
    assert (pair["f1"]["low"], pair["f1"]["high"]) == pytest.approx(tuple(np.percentile(fa - fb, [2.5, 97.5])), abs=0.02)
    assert pair["f1"]["p_a_le_b"] == pytest.approx((fa <= fb).mean(), abs=0.04)
    clean = ~y
    assert pair["fpr"]["delta"] == pytest.approx(a[clean].mean() - b[clean].mean())
    over = (clean[pick] & a[pick]).sum(1) / clean[pick].sum(1) - (clean[pick] & b[pick]).sum(1) / clean[pick].sum(1)
    assert (pair["fpr"]["low"], pair["fpr"]["high"]) == pytest.approx(tuple(np.percentile(over, [2.5, 97.5])), abs=0.02)


def test_water_filling(spark, tiny):
    """No category above its size or the cap, those not full within one row of each other, nothing left undealt."""
    sizes = Counter(r["lang"] for r in table(spark, tiny, "documents").select("lang").collect())
    got = QUERIES["t10_water_filling"](spark, tiny).collect()
    taken = Counter(r["lang"] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got) == min(200, sum(min(n, 80) for n in sizes.values()))
    full = {k for k, n in sizes.items() if taken[k] == min(n, 80)}
    rest = [taken[k] for k in sizes if k not in full]
    assert all(taken[k] <= min(n, 80) for k, n in sizes.items()) and (not rest or max(rest) - min(rest) <= 1)


def edited(key, text):
    """The five random edits in plain Python."""
    import hashlib

    c = list(text)
    digests = [hashlib.md5(f"{key}:{i}".encode()).hexdigest() for i in range(len(c))]
    h = [[int(d[8 * k : 8 * k + 8], 16) for d in digests] for k in range(4)]
    looks = dict(zip("aeorcxisl", "\u0430\u0435\u043e\u0440\u0441\u0445\u0456\u0455\u04cf"))
    leet = dict(zip("aeiost", "431057"))
    pick = lambda k, places, n: set(sorted(places, key=lambda i: h[k][i])[:n])
    out = {}
    for name, k, table_, rate in (("lookalike", 0, looks, 0.15), ("digit", 1, leet, 0.3)):
        may = [i for i, v in enumerate(c) if v in table_ or v.lower() in table_ and v.isascii()]
        drawn = pick(k, may, max(1, int((len(c) if k == 0 else len(may)) * rate)))
        out[name] = "".join(table_[v.lower()] if i in drawn else v for i, v in enumerate(c))
    drawn, typo, i = pick(2, range(len(c)), max(1, int(len(c) * 0.05))), [], 0
    while i < len(c):
        if i not in drawn:
            typo.append(c[i])
        elif h[2][i] % 2 and i + 1 < len(c) and i + 1 not in drawn:
            typo += [c[i + 1], c[i]]
            i += 1
        i += 1
    out["typo"] = "".join(typo)
    out["case"] = "".join((v.upper() if h[3][i] % 2 else v.lower()) if v.isascii() else v for i, v in enumerate(c))
    drawn = pick(3, range(len(c)), 5)
    out["mark"] = "".join(v + "\u200b\u200c\u200d\ufeff"[h[3][i] % 4] * (i in drawn) for i, v in enumerate(c))
    return out


def test_random_edits(spark, tiny):
    import hashlib

    want = Counter()
    for r in table(spark, tiny, "conversations").collect():
        for name, text in edited(f"{r['conv_id']}:{r['turn']}", r["text"] or "").items():
            want[r["conv_id"], r["turn"], name, len(text), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = QUERIES["p02_random_edits"](spark, tiny).collect()
    assert Counter((r["conv_id"], r["turn"], r["edit"], r["n_chars"], r["digest"]) for r in got) == want


def test_random_edits_awkward(spark):
    """Null, empty, one letter, nothing that can change, characters beyond 16 bits, line feeds, repeated rows, 200,000 letters."""
    from sievework.operators import edits

    texts = [None, "", "a", "zzz", "\U0001f600\nA\u00e9\U0001f680s", "tt", "a\tb", "a\tb", "Sea " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, t string, edits_ string")
    for r in edits.random_edits(df, "t", F.col("k").cast("string")).collect():
        got = {e["edit"]: e["changed"] for e in r["edits"]}
        assert got == edited(str(r["k"]), r["t"] or "")
        if len(r["t"] or "") > 1000:
            assert sum(a != b for a, b in zip(got["lookalike"], r["t"])) == 30_000 and len(got["mark"]) == 200_005


def test_perturbations_undone(spark, tiny):
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turn = str.maketrans(lower + upper, lower[13:] + lower[:13] + upper[13:] + upper[:13])
    change = {
        "double_space": lambda t: re.sub("[ \t\n\x0b\f\r]+", "  ", t), "rot13": lambda t: t.translate(turn), "url_encode": lambda t: quote(t, safe=""),
        "full_width": lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), "leet": lambda t: t.translate(str.maketrans("aeiost", "431057")),
        "zero_width": lambda t: re.sub("([a-z])", "\\1\u200b", t), "case": lambda t: "".join(c.swapcase() if c.isascii() else c for c in t), "nfkd": lambda t: unicodedata.normalize("NFKD", t),
    }
    settle = lambda t: re.sub("[ \t\n\x0b\f\r]+", " ", plain_normalize(t).lower()).strip(" ")
    texts = [r["text"] for r in table(spark, tiny, "documents").select("text").collect()]
    want = {k: (len(texts), sum(settle(f(t)) == settle(t) for t in texts)) for k, f in change.items()}
    got = {r["perturbation"]: (r["n"], r["recovered"]) for r in QUERIES["p01_roundtrip"](spark, tiny).collect()}
    assert got == want and got["zero_width"] == (len(texts), len(texts))


def test_staged_normaliser_equals_expression(spark):
    from pyspark.sql import functions as F

    from sievework.functions import text as x

    texts = [None, "", "ab\b\bc", "Jung vf gur cebprff", "hello%20world", b"plain words in hexadecimal".hex(), "cаt", "ｃａｔ", "long " * 5000, "long " * 2]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string").withColumn("u", F.upper("t"))
    staged = x.normalize_columns(t, "t", "u").orderBy("i").collect()
    assert staged == t.select("i", x.normalize(F.col("t")).alias("t"), x.normalize(F.col("u")).alias("u")).orderBy("i").collect()
