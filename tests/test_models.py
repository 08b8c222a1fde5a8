"""Fitted models against NumPy: text model, calibration, conformal bound, probes; splits that keep groups whole."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import registry
from sievework.operators import calibration, metrics, model, probes, splits

QUERIES = registry.queries()
SIGMOID = lambda z: 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    calm, rude = [f"calm{k}" for k in range(60)], [f"rude{k}" for k in range(25)]
    rows = []
    for k in range(400):
        y = int(rng.random() < 0.25)
        words = [rng.choice(calm) for _ in range(rng.randrange(3, 40))] + [rng.choice(rude) for _ in range(rng.randrange(1, 5) if y or rng.random() < 0.1 else 0)]
        rng.shuffle(words)
        rows.append((k, " ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words), y))
    return spark.createDataFrame(rows, "id long, text string, y int")


def test_model_is_the_optimum_and_scores_held_out_texts(spark, texts):
    table = model.fit(texts, "text", "y")
    assert [f.simpleString() for f in table.schema] == ["bucket:int", "weight:bigint"] or table.columns == ["bucket", "weight"]
    w, b = np.zeros(model.DIM), 0.0
    for r in table.collect():
        if r["bucket"] < 0:
            b = r["weight"] / 1e6
        else:
            w[r["bucket"]] = r["weight"] / 1e6
    rows = texts.select("id", "y", model.buckets(F.col("text")).alias("b")).collect()
    x = np.zeros((len(rows), model.DIM))
    for i, r in enumerate(rows):
        x[i, r["b"]] = 1 / math.sqrt(len(r["b"]))
    y = np.array([r["y"] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    slope = (SIGMOID(x @ w + b) - y) * weight / weight.sum()
    assert np.abs(x.T @ slope + 1e-4 * w).max() < 1e-4 and abs(slope.sum()) < 1e-4
    made = model.Model.of(table)
    got = {r["id"]: r["p"] for r in texts.select("id", made.probability(F.col("text")).alias("p")).collect()}
    assert all(abs(got[r["id"]] - SIGMOID(x[i] @ w + b)) < 2e-6 for i, r in enumerate(rows))
    held = model.held_out(texts, "id", "text", "y")
    assert held.select("id").join(texts.where(model.train_part(F.col("id"))), "id").isEmpty()
    assert metrics.auroc(held.withColumnRenamed("y", "label")).first()["auroc"] > 0.65


def test_model_of_odd_tables(spark, texts):
    """One class, null and empty texts, null labels: defined scores."""
    one = model.Model.of(model.fit(texts.where("y = 0"), "text", "y"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "calma " * 9), (4, "1 2 3")], "id long, text string")
    p = {r["id"]: r["p"] for r in odd.select("id", one.probability(F.col("text")).alias("p")).collect()}
    assert max(p.values()) < 0.01
    both = model.Model.of(model.fit(texts.unionByName(spark.createDataFrame([(900, None, 1), (901, "x", None)], "id long, text string, y int")), "text", "y"))
    p = {r["id"]: r["p"] for r in odd.select("id", both.probability(F.col("text")).alias("p")).collect()}
    assert p[1] == p[2] == p[4] and all(0 <= v <= 1 for v in p.values())


def test_model_queries_on_small_tables(spark, small):
    block = {r["lang"]: r for r in QUERIES["a05_model_metrics"](spark, small).collect()}
    scores = QUERIES["m03_model_scores"](spark, small).toPandas()
    assert (block["all"]["tp"] + block["all"]["fn"], block["all"]["fp"] + block["all"]["tn"]) == ((scores.label == 1).sum(), (scores.label == 0).sum())
    assert block["all"]["auroc"] > 0.7
    top = max(QUERIES["w01_model_curve"](spark, small).collect(), key=lambda r: r["tp"] + r["fp"])
    assert (top["tp"], top["fp"]) == (top["pos"], top["neg"])
    points = {r["metric"]: r for r in QUERIES["a27_model_intervals"](spark, small).collect()}
    assert points["auroc"]["point"] == pytest.approx(block["all"]["auroc"], abs=5e-3) and points["auroc"]["low"] <= points["auroc"]["point"] <= points["auroc"]["high"]


def overconfident(spark, n=6000, factor=4.0):
    rng = np.random.default_rng(3)
    z = rng.normal(size=n) * 1.5
    y = rng.random(n) < SIGMOID(z)
    return spark.createDataFrame([(i, float(SIGMOID(factor * a)), int(b)) for i, (a, b) in enumerate(zip(z, y))], "id long, p double, y int")


def test_temperature_against_a_fine_grid(spark):
    df = overconfident(spark)
    half = df.where(calibration.first_half(F.col("id"))).toPandas()
    z, y = np.log(half.p.clip(1e-7, 1 - 1e-7) / (1 - half.p.clip(1e-7, 1 - 1e-7))).to_numpy(), half.y.to_numpy()
    grid = np.geomspace(0.05, 20, 4000)
    best = grid[np.argmin([(np.logaddexp(0, z / t) - y * z / t).mean() for t in grid])]
    got, rest = calibration.calibrated(df, "id", "p", "y")
    assert got == pytest.approx(best, rel=0.01) and got == pytest.approx(4.0, rel=0.15)
    report = {r["score"]: r for r in calibration.calibration_report(df, "id", "p", "y").collect()}
    assert report["after"]["nll"] < report["before"]["nll"] and report["after"]["ece"] < report["before"]["ece"] / 2 and report["after"]["brier"] < report["before"]["brier"]
    other = rest.toPandas()
    p = SIGMOID(np.log(other.p.clip(1e-7, 1 - 1e-7) / (1 - other.p.clip(1e-7, 1 - 1e-7))) / got)
    tenth = np.minimum((p * 10).astype(int), 9)
    assert report["after"]["brier"] == pytest.approx(((p - other.y) ** 2).mean(), abs=1e-9)
    assert report["after"]["ece"] == pytest.approx(sum(abs((p - other.y)[tenth == k].sum()) for k in range(10)) / len(p), abs=1e-9)
    assert calibration.best_temperature(*(np.zeros(0),) * 3) > 0
    assert calibration.best_temperature(np.array([1.0]), np.array([5.0]), np.array([5.0])) == pytest.approx(0.05, rel=1e-3)


def plain_upper(k, n, delta):
    """The exact limit from the binomial's terms."""
    lo, hi = 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def test_conformal_bound_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 5 == 0), float(np.round(rng.beta(4, 2) if i % 5 == 0 else rng.beta(2, 4), 4))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int, prob double")
    first = {r["id"] for r in df.where(calibration.first_half(F.col("id"))).collect()}
    cal, test, bad = ([p for i, y, p in rows if f(i, y)] for f in (lambda i, y: not y and i in first, lambda i, y: not y and i not in first, lambda i, y: y))
    for r in calibration.conformal(df, "id", [0.001, 0.05, 0.2]).collect():
        tau, bound = None, None
        for t in calibration.SEQUENCE:
            u = plain_upper(sum(p >= t for p in cal), len(cal), 0.05)
            if u > r["alpha"]:
                break
            tau, bound = t, u
        share = lambda xs: sum(p >= tau for p in xs) / len(xs) if tau is not None else 0.0  # noqa: E731, B023
        assert r["tau"] == tau and (r["n_calibration"], r["n_test"]) == (len(cal), len(test))
        assert (r["test_rate"], r["recall"]) == pytest.approx((share(test), share(bad)))
        assert r["bound"] == (None if bound is None else pytest.approx(bound, abs=1e-9))
        if r["alpha"] == 0.2:
            assert r["test_rate"] <= 0.2
    assert {r["tau"] for r in calibration.conformal(df.limit(0), "id", [0.1]).collect()} == {None}


def vectors(spark, n=500, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    concept = (x[:, 0] + 0.8 * x[:, 1] ** 3 + 0.5 * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(int)
    task = (x[:, 3] + 0.6 * x[:, 0] + 0.5 * rng.normal(size=n) > 0.4).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(concept[i]), int(task[i])) for i in range(n)], "id long, v array<double>, concept int, task int").repartition(3)
    return df, x, concept.astype(float), task.astype(float)


def test_deflation_against_numpy(spark):
    """Every round anew from the projected rows themselves."""
    df, x, c, t = vectors(spark)
    m = probes.moments(df, "v", ["concept", "task"], 6)
    got = probes.deflate(*probes.centred(m, 6), rounds=3, least=0.0)
    x0, c0, t0 = x - x.mean(0), c - c.mean(), t - t.mean()
    r2 = lambda a, y: 1 - ((y - a @ np.linalg.lstsq(a, y, rcond=1e-8)[0]) ** 2).sum() / (y**2).sum()
    ridge = lambda a, y: np.linalg.solve(a.T @ a + np.eye(6), a.T @ y)
    task = ridge(x0, t0) / np.linalg.norm(ridge(x0, t0))
    now, seen = x0.copy(), []
    assert got.concept[0] == pytest.approx(r2(now, c0), abs=1e-8)
    for k, w in enumerate(got.directions):
        v = ridge(now, c0)
        for u in (task, *seen):
            v = v - (v @ u) * u
        v /= np.linalg.norm(v)
        assert np.abs(v - w).max() < 1e-6
        seen.append(v)
        now = now - np.outer(now @ v, v)
        assert got.concept[k + 1] == pytest.approx(r2(now, c0), abs=1e-7) and got.task[k + 1] == pytest.approx(r2(now, t0), abs=1e-7)
    assert len(got.directions) == 3 and all(b <= a + 1e-9 for a, b in zip(got.concept, got.concept[1:])) and got.concept[1] < got.concept[0] / 3
    assert got.task[-1] > 0.8 * got.task[0]
    p = {r["id"]: r["p"] for r in probes.project(df, "v", got.directions, "p").select("id", "p").collect()}
    want = x - sum(np.outer(x @ w, w) for w in got.directions)
    assert max(np.abs(np.array(p[i]) - want[i]).max() for i in p) < 1e-9


def newton(x, y, weight, reg):
    """Weighted logistic regression with an intercept that is not penalised."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([reg] * x.shape[1] + [0.0])
    share = weight / weight.sum()
    for _ in range(60):
        p = SIGMOID(a @ w)
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + penalty + 1e-12 * np.eye(len(w)), a.T @ (share * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def step_ap(y, p):
    out, pos = 0.0, (y == 1).sum()
    for cut in np.unique(p)[::-1]:
        at = p >= cut
        out += ((p == cut) & (y == 1)).sum() / pos * (y[at] == 1).mean()
    return out


def test_grid_search_against_numpy(spark):
    df, x, _, y = vectors(spark, 300, 4, 5)
    grid = [1e-3, 1e-1, 10.0]
    got = probes.grid_search(df, "id", "v", "task", grid, folds=3)
    fold = np.array([r["f"] for r in df.select("id", (splits.hash32(F.col("id")) % 3).alias("f")).orderBy("id").collect()])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = []
    for c in grid:
        aps = []
        for k in range(3):
            w = newton(x[fold != k], y[fold != k], weight[fold != k], 1 / (c * len(y) * 2 / 3))
            aps.append(step_ap(y[fold == k], x[fold == k] @ w[:-1] + w[-1]))
        want.append(float(np.mean(aps)))
    assert [v for _, v in got.table] == pytest.approx(want, abs=2e-3)
    assert got.best == grid[int(np.argmax(want))]
    held = probes.held_out_probe(df, "id", "v", "task", 1.0)
    assert held.count() == sum(n - math.floor(n * 0.7) for n in ((y == 1).sum(), (y == 0).sum()))
    assert metrics.auroc(held).first()["auroc"] > 0.75


def test_groups_stay_whole_and_labels_keep_their_shares(spark):
    """Groups of many labels, of one, of one row and of a third of all rows in no group of their own."""
    rng = random.Random(11)
    rows = []
    for g in range(1500):
        kinds = rng.choice((["a"], ["b"], ["a", "b"], ["a", "b", "c"], [None, "c"]))
        rows += [(g if g else None, rng.choice(kinds), i) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "g long, label string, split2 long").repartition(4)
    got = splits.group_split(df, F.col("g"), "label")
    assert got.columns == [*df.columns, "split"] and got.count() == len(rows)
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n <> 1").isEmpty()
    counts = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    for label in ("a", "b", "c", None):
        n = sum(v for (k, _), v in counts.items() if k == label)
        for split, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
            assert counts[label, split] / n == pytest.approx(share, abs=0.02)
    assert splits.group_split(df.limit(0), F.col("g"), "label").collect() == []


def test_conversations_are_in_one_split(spark, small):
    out = QUERIES["d12_group_split"](spark, small)
    assert out.groupBy("conv_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()


def test_ensemble_and_multiple_choice_against_pandas(spark, small):
    from sievework.operators import scoring
    from sievework.plans._base import table

    model_p = QUERIES["m03_model_scores"](spark, small).toPandas()
    words = table(spark, small, "documents").select(F.col("doc_id").alias("item_id"), scoring.score(F.col("text")).alias("a")).toPandas()
    s = model_p.merge(words, on="item_id")
    wa, wb = (s.a >= 0.5) != (s.label == 1), (s.prob >= 0.5) != (s.label == 1)
    for r in QUERIES["m10_ensemble_gate"](spark, small).collect():
        k = r["weight"]
        we = (k * s.a + (1 - k) * s.prob >= 0.5) != (s.label == 1)
        assert (r["n"], r["errors_a"], r["errors_b"], r["errors_ensemble"], r["both"]) == (len(s), wa.sum(), wb.sum(), we.sum(), (wa & wb).sum())
        assert r["complementarity"] == pytest.approx((wa ^ wb).sum() / (wa | wb).sum(), abs=1e-6) and r["gate"] == (we.sum() <= min(wa.sum(), wb.sum()))
    h = lambda x: int(__import__("hashlib").md5(f"42:{x}".encode()).hexdigest()[:8], 16)
    got = {r["lang"]: r for r in QUERIES["m16_mcq_deltas"](spark, small).collect()}
    for lang, g in model_p.groupby("lang"):
        pos, neg = ([p for _, _, p in sorted((h(i), i, p) for i, p in zip(g.item_id[g.label == y], g.prob[g.label == y]))] for y in (1, 0))
        questions = [(p, max(neg[3 * k : 3 * k + 3])) for k, p in enumerate(pos) if len(neg[3 * k : 3 * k + 3]) == 3]
        if not questions:
            assert lang not in got
            continue
        r = got[lang]
        assert (r["questions"], r["hit"], r["top"]) == (len(questions), pytest.approx(np.mean([a >= 0.5 for a, _ in questions]), abs=1e-6), pytest.approx(np.mean([a > b for a, b in questions]), abs=1e-6))


def test_bag_of_words_tells_what_can_be_told(spark):
    from sievework.operators import ml

    apart = [(k, f"calm harbour morning boats {'quiet' if k % 2 else 'storm'} water number{k % 7}", float(k % 2)) for k in range(80)]
    alike = [(k, "the same few words in every text", float(k % 2)) for k in range(80)]
    a, b = (ml.predictability(spark.createDataFrame(r, "id long, text string, y double"), "id", "text", "y").first() for r in (apart, alike))
    assert a["auroc"] > 0.9 and a["share"] > 0.5 and b["auroc"] < 0.75 and b["trivial"] == 0


def test_orchestrated_experiments_fail_alone(spark):
    from sievework.operators import scoring

    rows = scoring.run_all(spark, {"good": lambda: spark.range(3), "bad": lambda: spark.range(3).select("nothing")}).collect()
    assert [tuple(r) for r in rows] == [("good", "ok", 3, None), ("bad", "failed", None, "AnalysisException")]


def test_elimination_counts_the_predictable(spark, tiny):
    """M02's classes are M01's rows counted."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    rows = QUERIES["m01_bow_predictability"](spark, tiny).collect()
    assert {r["doc_id"] for r in rows} <= set(labels) and all(r["trivial"] == ((r["p_unsafe"] if labels[r["doc_id"]] else 1 - r["p_unsafe"]) > 0.9) for r in rows if abs(r["p_unsafe"] - 0.5) < 0.399)
    got = {int(r["label"]): r for r in QUERIES["m02_bow_elimination"](spark, tiny).collect()}
    left = {y: sum(labels[r["doc_id"]] == y and not r["trivial"] for r in rows) for y in got}
    for y, r in got.items():
        assert (r["n"], r["left"]) == (sum(labels[q["doc_id"]] == y for q in rows), left[y])
        assert r["weight"] == (None if not left[y] else pytest.approx(sum(left.values()) / (len(got) * left[y]), abs=1e-6))


def test_prepared_copies_stay_together(spark):
    from sievework.operators import builds

    df = spark.createDataFrame([(k, f"b{k % 90}", int(k % 9 == 0)) for k in range(900)], "id long, base string, label int")
    got = builds.prepare(df, "base")
    assert got.count() == 900 and got.groupBy("base").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts["held_out"] == 160 and got.where("split = 'held_out' AND label = 1").isEmpty()
    weights = {(r["split"], r["label"]): r for r in builds.summary(got).collect()}
    train = {y: weights["train", y]["n"] for y in (0, 1)}
    assert all(weights["train", y]["weight"] == pytest.approx(sum(train.values()) / (2 * n), abs=1e-6) for y, n in train.items())
