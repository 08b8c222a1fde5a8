"""Resampled metrics, batch packing and contrastive loss against brute force, with sizes, ties and hot groups."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import registry
from sievework.operators import batches, contrast, resampled
from sievework.plans._base import scored

QUERIES = registry.queries()


def plain_metrics(y, p):
    """The seven metrics of labels and scores, written out."""
    pos, neg = np.sort(p[y == 1]), np.sort(p[y == 0])
    below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
    out = {"auroc": (below + upto).mean() / 2 / len(neg) if len(pos) and len(neg) else np.nan}
    cuts = np.unique(pos)
    tp, fp = len(pos) - np.searchsorted(pos, cuts), len(neg) - np.searchsorted(neg, cuts)
    steps = np.searchsorted(pos, cuts, "right") - np.searchsorted(pos, cuts)
    out["ap"] = (steps * tp / (tp + fp)).sum() / len(pos) if len(pos) else np.nan
    tenth = np.minimum((p * 10).astype(int), 9)
    out["ece"] = sum(abs((y[tenth == k] - p[tenth == k]).sum()) for k in range(10)) / len(y)
    a, b, c, d = (int(((p >= 0.5) == f).astype(int)[y == t].sum()) for f, t in ((True, 1), (True, 0), (False, 0), (False, 1)))
    n = a + b + c + d
    chance = ((a + b) * (a + d) + (c + d) * (c + b)) / n**2
    out |= {"f1": 2 * a / (2 * a + b + d) if 2 * a + b + d else np.nan, "kappa": ((a + c) / n - chance) / (1 - chance) if chance != 1 else np.nan, "fpr": b / (b + c) if b + c else np.nan, "recall": a / (a + d) if a + d else np.nan}
    return out


def test_intervals_against_resampled_rows(spark, small):
    """All rows drawn anew 3,000 times, in pairs, against Poisson weights: ends within a hundredth."""
    rows = scored(spark, small).toPandas()
    y, both = rows.label.to_numpy(), {c: rows[c].to_numpy() for c in ("prob", "prob_b")}
    got = {(r["score"], r["metric"]): r for r in resampled.intervals(scored(spark, small), "item_id", "label", ["prob", "prob_b"], replicates=3000).collect()}
    assert len(got) == 21
    rng, drawn = np.random.default_rng(5), {k: [] for k in got}
    for _ in range(3000):
        pick = rng.integers(0, len(y), len(y))
        each = {c: plain_metrics(y[pick], p[pick]) for c, p in both.items()}
        for m in each["prob"]:
            for c in both:
                drawn[c, m].append(each[c][m])
            drawn["prob - prob_b", m].append(each["prob"][m] - each["prob_b"][m])
    exact = {c: plain_metrics(y, p) for c, p in both.items()}
    for (score, m), r in got.items():
        point = exact[score][m] if score in exact else exact["prob"][m] - exact["prob_b"][m]
        assert r["point"] == pytest.approx(point, abs=2e-3)
        values = np.array(drawn[score, m])
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.nanpercentile(values, [2.5, 97.5])), abs=0.01)
        assert r["p_not_above"] == pytest.approx((values <= 0).mean(), abs=0.03) and r["n_valid"] == 3000


def test_intervals_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same draws however rows are dealt and merged; no rows, one class, nulls and custom metrics; four times the rows
    halve the width, and the arrays that move stay as they are."""
    make = lambda n: spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(997)) / 997.0).alias("p"))
    df = make(2000)
    table = lambda out: sorted(map(str, out.collect()))
    one = table(resampled.intervals(df.coalesce(1), "id", "y", ["p"], replicates=300))
    assert table(resampled.intervals(df.repartition(7), "id", "y", ["p"], replicates=300)) == one
    monkeypatch.setattr(resampled, "STEP", 5000)
    monkeypatch.setattr(resampled, "FAN_IN", 2)
    assert table(resampled.intervals(df.repartition(9), "id", "y", ["p"], replicates=300)) == one
    width = lambda d: (lambda r: r["high"] - r["low"])(resampled.intervals(d, "id", "y", ["p"], {"auroc": resampled.auroc}, replicates=300).first())
    assert width(make(32_000)) == pytest.approx(width(make(8000)) / 2, rel=0.2)
    assert resampled.intervals(df.limit(0), "id", "y", ["p"]).collect() == []
    flat = resampled.intervals(df.where("y = 1").unionByName(spark.createDataFrame([(-1, None, 0.5), (-2, 1, None)], "id bigint, y int, p double")), "id", "y", ["p"], {"auroc": resampled.auroc, "share": lambda n, p, s: p.sum(0) / (p.sum(0) + n.sum(0))}, replicates=50).collect()
    assert {r["metric"]: (r["point"], r["n_valid"]) for r in flat} == {"auroc": (None, 0), "share": (1.0, 50)}


def test_poisson_weights():
    w = resampled.weights(np.arange(4000, dtype=np.uint64) * np.uint64(2654435761), 1, 501, 42)
    share = np.bincount(w.ravel(), minlength=8)[:8] / w.size
    want = np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040])
    assert np.abs(share - want).max() < 1e-3
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def plain_packing(groups, alone, size):
    """(group → batch, singleton → batch): one pass, as a loader would."""
    at, level, places, free = 0, 0, {}, []
    for g, n in groups:
        if level + n > size:
            free += [at] * (size - level)
            at, level = at + 1, 0
        level += n
        places[g] = at
    while len(free) < len(alone):
        if level == size:
            at, level = at + 1, 0
        free.append(at)
        level += 1
    return places, dict(zip(alone, free))


@pytest.mark.parametrize(("block", "size"), [(100_000, 8), (7, 8), (1, 5), (40, 32)])
def test_packing_equals_a_sequential_one(spark, monkeypatch, block, size):
    monkeypatch.setattr(batches, "BLOCK", block)
    rng = random.Random(size)
    groups = {g: rng.choice((1, 2, 3, 4, 5, 8, 9)) for g in range(300)}
    rows = [(k, g) for g, n in groups.items() for _ in range(n) for k in [rng.random()]] + [(rng.random(), None) for _ in range(700)]
    df = spark.createDataFrame([(i, g, f"x{i}") for i, (_, g) in enumerate(rows)], "id bigint, g bigint, batches string").repartition(5)
    got = batches.pack(df, F.col("g"), "id", size).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["id", "g", "batches", "batch"]
    h = lambda x: int(__import__("hashlib").md5(f"42:{x}".encode()).hexdigest()[:8], 16)
    order = sorted((g for g, n in groups.items() if n <= size), key=lambda g: (h(g), str(g)))
    alone = sorted((i for i, (_, g) in enumerate(rows) if g is None), key=lambda i: (h(i), i))
    places, filled = plain_packing([(g, groups[g]) for g in order], alone, size)
    assert {(r["id"], r["batch"]) for r in got} == {(i, filled[i] if g is None else places.get(g)) for i, (_, g) in enumerate(rows)}
    held = {}
    for r in got:
        held[r["batch"]] = held.get(r["batch"], 0) + 1
    held.pop(None, None)
    assert max(held.values()) <= size and sorted(held) == list(range(len(held)))
    assert sum(n < size for n in held.values()) <= 1  # singletons fill all gaps


def test_packing_of_empty_parts(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "id bigint, g bigint")
    assert sorted(r["batch"] for r in batches.pack(df, F.col("g"), "id", 2).collect()) == [0, 0, 1]
    assert batches.pack(df.limit(0), F.col("g"), "id", 2).collect() == []
    big = spark.createDataFrame([(k, 1) for k in range(5)] + [(9, 2)], "id bigint, g bigint")
    assert {(r["id"], r["batch"]) for r in batches.pack(big, F.col("g"), "id", 3).collect()} == {*((k, None) for k in range(5)), (9, 0)}


def test_transitions_compose():
    rng = np.random.default_rng(3)
    for size in (1, 5, 32):
        sizes = rng.integers(1, size + 1, 200)
        level, closed, room = batches.transitions(sizes, size)
        for start in range(size + 1):
            _, end, shut, left = batches.packed(sizes, size, start)
            assert (level[start], closed[start], room[start]) == (end, len(shut), sum(left))


def plain_losses(v, groups, labels, temperature):
    z = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in range(len(v)):
        near = [j for j in range(len(v)) if j != i and groups[j] == groups[i] is not None and labels[j] == labels[i]]
        every = [j for j in range(len(v)) if j != i and groups[j] == groups[i]]
        if groups[i] is not None and near:
            lse = lambda js: np.logaddexp.reduce(z[js] @ z[i] / temperature)
            out[i] = lse(every) - lse(near)
    return out


@pytest.mark.parametrize(("block", "tile"), [(8192, 1024), (16, 5)])
@pytest.mark.parametrize("temperature", [0.1, 0.001])
def test_contrastive_loss_against_numpy(spark, monkeypatch, block, tile, temperature):
    """Groups of one, of two and of hundreds (several blocks); rows of no group; exponents that would underflow."""
    monkeypatch.setattr(contrast, "BLOCK", block)
    monkeypatch.setattr(contrast, "TILE", tile)
    rng = np.random.default_rng(1)
    n = 260
    v = rng.normal(size=(n, 8))
    v[7] = v[8]
    groups = [None if i % 13 == 0 else 1 if i < 150 else 2 if i < 152 else 3 if i == 152 else 4 + i % 5 for i in range(n)]
    labels = [int(x) for x in rng.integers(0, 3, n)]
    df = spark.createDataFrame([(i, v[i].tolist(), groups[i], labels[i]) for i in range(n)], "id bigint, v array<double>, grp int, label int").repartition(3)
    got = {r["id"]: (r["group"], r["loss"]) for r in contrast.row_losses(df, "id", "v", F.col("grp"), "label", temperature).collect()}
    want = plain_losses(v, groups, labels, temperature)
    assert set(got) == set(want)
    for i, loss in want.items():
        assert got[i][0] == str(groups[i]) and got[i][1] == pytest.approx(loss, abs=1e-6, rel=1e-6)
    assert contrast.group_losses(df.limit(0), "id", "v", F.col("grp"), "label").collect() == []


def test_contrastive_loss_of_a_hot_group(spark):
    """One group of 20,000 rows: several units of work, with the loss of rows that are all alike known in closed form."""
    df = spark.range(20_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"), F.lit("all").alias("grp"), (F.col("id") % 4).alias("label"))
    began = time.time()
    got = contrast.group_losses(df, "id", "v", F.col("grp"), "label").first()
    assert got["anchors"] == 20_000 and got["loss"] == pytest.approx(np.log(19_999 / 4_999), abs=1e-9)
    assert time.time() - began < 240


def test_names_are_registered_once():
    from sievework.plans._base import Plan

    plan = Plan()

    def q(spark, d): ...

    plan()(q)
    with pytest.raises(ValueError, match="registered twice"):
        plan()(q)
    assert "s11_derived_cache" in QUERIES
