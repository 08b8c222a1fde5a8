"""Line numbers over files of several blocks, shuffled listings, bad lines with their places, and positional joins."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.sources import ordered


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of about 300 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files(tmp_path, sizes, seed=1):
    rng, out = random.Random(seed), {}
    for k, n in enumerate(sizes):
        p = tmp_path / f"{'zmab'[k % 4]} part%{k}.txt"
        rows = [f"{k}-{i} " + "x" * rng.randrange(60) if rng.random() < 0.9 else "" for i in range(n)]
        p.write_text("\n".join(rows) + ("\n" if n else ""))
        out[str(p)] = rows
    return out


def test_numbers_follow_files_and_lines(spark, small_blocks, tmp_path):
    made = files(tmp_path, [200, 3, 0, 57, 120])
    paths = list(made)
    random.Random(4).shuffle(paths)
    read = ordered.lines(spark, [p.replace("%", "%") for p in paths])
    blocks = spark.read.text(paths).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert blocks > 20
    want = [(v, i + 1) for p in paths for i, v in enumerate(made[p])]
    got = sorted(read.rows.collect(), key=lambda r: r["number"])
    assert [(r["value"], r["line"]) for r in got] == want and [r["number"] for r in got] == list(range(len(want)))
    assert read.count == len(want)
    # a folder: by name; filters and joins after the numbers do not change them
    folder = ordered.lines(spark, str(tmp_path))
    by_name = [v for p in sorted(paths) for v in made[p]]
    some = folder.rows.where("value LIKE '0-%'").repartition(3).collect()
    assert sorted((r["number"], r["value"]) for r in some) == [(i, v) for i, v in enumerate(by_name) if v.startswith("0-")]


def test_a_change_between_the_passes_is_refused(spark, small_blocks, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("\n".join(f"line {i}" for i in range(300)))
    read = ordered.lines(spark, str(p))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "170")
    with pytest.raises(Exception, match="not cut as it was counted"):
        read.rows.collect()


def test_bad_lines_carry_file_and_line(spark, small_blocks, tmp_path):
    rows = ['{"id": 1, "t": "a"}', "", "  \t", "{broken", '{"id": "x"}', "[1]", '{"id": 2}', "null", '{"id": 3, "t": "' + "y" * 900 + '"}']
    (tmp_path / "one.jsonl").write_text("\n".join(rows))
    (tmp_path / "two.jsonl").write_text('{"id": 4}\nnot json')
    read = ordered.jsonl(spark, [str(tmp_path / "two.jsonl"), str(tmp_path / "one.jsonl")], "id long, t string")
    assert [(r["line"], r["number"], r["id"]) for r in read.rows.orderBy("number").collect()] == [(1, 0, 4), (1, 2, 1), (7, 8, 2), (9, 10, 3)]
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in read.bad.collect()) == [("one.jsonl", 4, "{broken"), ("one.jsonl", 5, '{"id": "x"}'), ("one.jsonl", 6, "[1]"), ("one.jsonl", 8, "null"), ("two.jsonl", 2, "not json")]


def test_zip_refuses_unequal_lengths(spark, small_blocks, tmp_path):
    for name, n in (("a", 90), ("b", 90), ("c", 89)):
        (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(n)) + "\n")
    a, b, c = (ordered.lines(spark, str(tmp_path / name)) for name in "abc")
    assert sorted(map(tuple, ordered.zipped(a, b).collect())) == [(i, f"a{i}", f"b{i}") for i in range(90)]
    with pytest.raises(ValueError, match="90 lines against 89"):
        ordered.zipped(a, c)


def test_first_lines_keep_file_order(spark, small_blocks, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(12), i) for i in range(400)]
    (tmp_path / "z.jsonl").write_text("\n".join(f'{{"k": {k}, "i": {i}}}' for k, i in rows[:250]))
    (tmp_path / "a.jsonl").write_text("\n".join(f'{{"k": {k}, "i": {i}}}' for k, i in rows[250:]))
    read = ordered.jsonl(spark, [str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl")], "k long, i long").rows
    want = {}
    for k, i in rows:
        want.setdefault(k, i)
    assert {r["k"]: r["i"] for r in ordered.first_lines(read, "k").collect()} == want


def test_tables_are_numbered_without_one_sorted_task(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("k"), F.lit(1).alias("number2")).repartition(6)
    got = ordered.numbered(df, ["k", "id"])
    rows = got.orderBy("k", "id").collect()
    assert [r["number"] for r in rows] == list(range(5000)) and got.columns == [*df.columns, "number"]
