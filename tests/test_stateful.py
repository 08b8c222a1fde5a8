"""Streams with state: restarts repeat nothing, keys are forgotten in time, silent and late runs are told apart."""

import time

import pytest

from sievework.streaming import stateful


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(stream, tmp_path, timers=False):
    q = stateful.to_files(stream, str(tmp_path / "q-out"), str(tmp_path / "q-checkpoint"), timers)
    if not q.awaitTermination(90):
        q.stop()
        raise AssertionError("the stream does not end")


def test_resume_repeats_nothing(spark, tmp_path):
    source, schema = tmp_path / "in", "rule string, kind string, n long"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    rows = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(str(tmp_path / "q-out")).collect()))
    line = lambda r, k, n: f'{{"rule": "{r}", "kind": "{k}", "n": {n}}}'
    put(source, "a.json", [line("R1", "safe", 5), line("R1", "safe", 3), line("R1", "bad", 9), line("R2", "safe", 1)])
    run(stateful.resume(read(), ["rule", "kind"], "n"), tmp_path)
    assert rows() == [("R1", "bad", 9), ("R1", "safe", 3), ("R2", "safe", 1)]
    before = rows()
    run(stateful.resume(read(), ["rule", "kind"], "n"), tmp_path)
    assert rows() == before
    put(source, "b.json", [line("R1", "safe", 0), line("R3", "safe", 7), line("R2", "safe", 2)])
    put(source, "c.json", [line("R3", "safe", 6), line("R2", "bad", 4)])
    run(stateful.resume(read(), ["rule", "kind"], "n"), tmp_path)
    assert rows() == sorted([*before, ("R2", "bad", 4), ("R3", "safe", 7)])


def test_resume_forgets_in_time(spark, tmp_path):
    source = tmp_path / "in"
    read = lambda: spark.readStream.schema("k string, n long").json(str(source))
    put(source, "a.json", ['{"k": "x", "n": 1}'])
    run(stateful.resume(read(), ["k"], "n", ttl_ms=1000), tmp_path)
    time.sleep(2)
    put(source, "b.json", ['{"k": "x", "n": 2}'])
    run(stateful.resume(read(), ["k"], "n", ttl_ms=1000), tmp_path)
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "q-out")).collect()) == [1, 2]


def test_watch_reports_silent_and_late_runs(spark, tmp_path):
    source = tmp_path / "log"
    read = lambda: stateful.watch(spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)), "30 minutes", "10 minutes")
    at = lambda h, m: f"2024-05-01T{h:02d}:{m:02d}:00Z"
    out = lambda: sorted((r["run"], r["at"].strftime("%H:%M"), r["kind"], r["status"], r["step"], r["lines"]) for r in spark.read.parquet(str(tmp_path / "q-out")).collect())
    put(source, "1.log", [f"{at(10, 0)} a step=load status=running", f"{at(10, 1)} b step=load status=running", f"{at(10, 2)} a step=train", "no log line", f"{at(10, 3)} c step=load status=running"])
    run(read(), tmp_path, timers=True)
    assert out() == [("a", "10:02", "progress", "running", "train", 2), ("b", "10:01", "progress", "running", "load", 1), ("c", "10:03", "progress", "running", "load", 1)]
    # b goes on; a line of a comes late but within bounds and does not set it back; c ends; then time passes
    put(source, "2.log", [f"{at(10, 9)} b step=test", f"{at(10, 1)} a step=load", f"{at(10, 9)} c status=complete"])
    run(read(), tmp_path, timers=True)
    put(source, "3.log", [f"{at(10, 55)} d step=load status=running"])
    run(read(), tmp_path, timers=True)
    got = out()
    assert ("b", "10:09", "progress", "running", "test", 2) in got and ("a", "10:02", "progress", "running", "train", 3) in got and ("c", "10:09", "over", "complete", "load", 2) in got
    assert [r for r in got if r[2] == "silent"] == [("a", "10:02", "silent", "running", "train", 3), ("b", "10:09", "silent", "running", "test", 2)]
    # a is too late now and dropped; b is heard of again, then silent again
    put(source, "4.log", [f"{at(10, 3)} a step=test", f"{at(10, 58)} b step=done"])
    run(read(), tmp_path, timers=True)
    put(source, "5.log", [f"{at(12, 0)} e step=load"])
    run(read(), tmp_path, timers=True)
    more = [r for r in out() if r not in got]
    assert ("b", "10:58", "back", "running", "done", 3) in more and ("b", "10:58", "silent", "running", "done", 3) in more and ("d", "10:55", "silent", "running", "load", 1) in more
    assert not any(r[0] in "ac" for r in more)
    before = out()
    run(read(), tmp_path, timers=True)
    assert out() == before


@pytest.fixture(autouse=True)
def _utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
