"""The jobs on copies of the tables: growing input, reruns, crashes, odd rows, and the command line."""

import json
import math
import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import track_features, turn_series
from jobs.common import settings

from .test_queries import SF, duck  # noqa: F401  a fixture

ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    return None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", ["job1_track_features", "job2_turn_series"])
def test_job_equals_its_sql(spark, duck, name):  # noqa: F811
    from jobs.queries import ORACLE, QUERIES

    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert rows_of(df) == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)


# ---- track_features ----


@pytest.fixture
def place(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def arrive(spark, rows, folder, name):
    """One more file in the folder, as a detector would leave it."""
    rows.coalesce(1).write.mode("append").parquet(folder)


def track(spark, place, **more):
    return track_features.run(spark, track_features.DEFAULTS | more, place("events"), place("out"), place("state"))


def whole(spark, place, events):
    """The output of one run over all of `events`, in folders of its own."""
    events.write.mode("overwrite").parquet(place("all"))
    track_features.run(spark, track_features.DEFAULTS, place("all"), place("out-all"), place("state-all"))
    return rows_of(track_features.output_of(spark, place("out-all")))


def files(tmp_path, *bucket):
    return {p: p.stat().st_mtime_ns for b in bucket for p in (tmp_path / "out" / f"bucket={b}").glob("part-*")}


def test_features_take_only_what_is_new(spark, place, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    first, later = events.where("event_id < 600"), events.where("event_id >= 600 and user_id < 12")
    arrive(spark, first, place("events"), "a")
    assert track(spark, place)["read"] == 600
    assert rows_of(track_features.output_of(spark, place("out"))) == whole(spark, place, first)
    cells = {r[0] for r in track_features.output_of(spark, place("out")).select("bucket").distinct().collect()}
    other = files(tmp_path, *cells - {0})
    arrive(spark, later, place("events"), "b")
    done = track(spark, place)
    assert done["read"] == later.count() and done["batches"] == 1
    assert rows_of(track_features.output_of(spark, place("out"))) == whole(spark, place, first.union(later))
    assert files(tmp_path, *cells - {0}) == other and other  # cells without news were not touched
    before = files(tmp_path, *cells)
    assert track(spark, place) == {"batches": 0, "read": 0, "written": 0} and files(tmp_path, *cells) == before


def test_features_in_small_batches_and_delivered_twice(spark, place):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 400")
    for k in range(4):
        arrive(spark, events.where(f"event_id % 4 = {k}"), place("events"), k)
    arrive(spark, events.where("event_id % 5 = 0"), place("events"), "again")
    assert track(spark, place, files_per_batch=2)["batches"] == 3
    assert rows_of(track_features.output_of(spark, place("out"))) == whole(spark, place, events)


def test_features_survive_a_death_in_the_middle_of_a_batch(spark, place, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 500")
    arrive(spark, events.where("event_id < 300"), place("events"), "a")
    track(spark, place)
    arrive(spark, events.where("event_id >= 300"), place("events"), "b")
    real = track_features.features
    monkeypatch.setattr(track_features, "features", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(Exception, match="died"):
        track(spark, place)
    monkeypatch.setattr(track_features, "features", real)
    assert track(spark, place)["batches"] == 1
    assert rows_of(track_features.output_of(spark, place("out"))) == whole(spark, place, events)


def test_features_of_odd_rows_against_a_loop(spark, place):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda f, s=0: t0 + timedelta(seconds=21600 * f + s)
    rows = [(k, at(k), 3, float(k * k)) for k in (0, 1, 2, 3, 5, 6, 7, 8)] + [(20, at(2, 5), 3, 9.0), (21, at(11), 4, 1.0), (22, at(-1), 3, 5.0), (None, at(1), 3, 1.0), (23, None, 3, 1.0), (24, at(1), None, 1.0), (25, at(1), 3, None), (26, at(0), 30, 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").withColumn("bucket", F.lit("own"))
    arrive(spark, df, place("events"), "a")
    track(spark, place)
    got = {(r.id, r.t): r for r in track_features.output_of(spark, place("out")).collect()}
    found = defaultdict(list)
    for i, ts, user, v in rows:
        if None not in (i, ts, user, v) and ts >= t0:
            found[user, int((ts - t0).total_seconds() // 21600)].append((v, v * 0.5 + i % 17, float(i % 29)))
    mean = {k: tuple(sum(c) / len(v) for c in zip(*v, strict=True)) for k, v in found.items()}
    assert set(got) == {(3, t) for t in range(12)} | {(4, t) for t in range(12)} | {(30, 0)}
    place_in_run = 0
    for t in range(12):
        r, p = got[3, t], mean.get((3, t))
        assert r.present == (p is not None) and (p is None or (r.x, r.y, r.z) == pytest.approx(p)) and r.cell_id == 0 and r.bucket == 0
        near = [mean[3, u][0] for u in range(t - 2, t + 3) if (3, u) in mean]
        assert r.x_avg == (pytest.approx(sum(near) / len(near)) if near else None)
        a, b = mean.get((3, t - 1)), mean.get((3, t + 1))
        if p and a and b:
            d, e = [x - y for x, y in zip(p, a, strict=True)], [x - y for x, y in zip(b, p, strict=True)]
            cos = sum(x * y for x, y in zip(d, e, strict=True)) / math.hypot(*d) / math.hypot(*e)
            place_in_run += 1
            assert (r.norm, r.angle, r.kept, r.place) == (pytest.approx(math.hypot(*d), abs=1e-5), pytest.approx(math.acos(cos) / math.pi, abs=1e-5), cos >= 0.7, place_in_run)
            place_in_run = place_in_run if cos >= 0.7 else 0
        else:
            assert (r.norm, r.angle, r.kept, r.place) == (None,) * 4
            place_in_run = 0


def test_features_of_an_empty_table(spark, place):
    arrive(spark, spark.read.parquet(f"{SF}/events.parquet").where("false"), place("events"), "a")
    track(spark, place)
    assert track_features.output_of(spark, place("out")).count() == 0


def test_settings_are_checked():
    assert settings('{"buckets": 4}', track_features.DEFAULTS)["buckets"] == 4
    with pytest.raises(ValueError, match="bukets"):
        settings('{"bukets": 4}', track_features.DEFAULTS)


@pytest.mark.parametrize("job", [track_features, turn_series])
def test_config_files_hold_the_defaults(job):
    name = job.__name__.split(".")[-1]
    assert settings((ROOT / "jobs" / f"{name}.json").read_text(), job.DEFAULTS) == job.DEFAULTS == json.loads((ROOT / "jobs" / f"{name}.json").read_text())


# ---- turn_series ----


def test_series_of_odd_turns(spark, place):
    rows = [(1, 0, "user", "a b c"), (1, 3, "assistant", " d\te\nf g h "), (1, 3, "user", "i"), (1, 5, "user", None), (1, 6, "user", ""), (2, 2, None, "x y"), (3, 0, "u", "one"), (None, 0, "u", "x"), (4, None, "u", "x"), (5, -1, "u", "x"), (6, 0, "u", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("words", F.lit("own")).write.parquet(place("turns"))
    for _ in range(2):
        done = turn_series.run(spark, turn_series.DEFAULTS, place("turns"), place("out"))
        assert done == {"read": 11, "written": 12}
    got = rows_of(turn_series.output_of(spark, place("out")), ["conv_id", "t", "present", "role", "n_rows", "words", "words_filled", "words_avg", "scaled", "change"])
    assert got == sorted([
        (1, 0, True, "user", 1, 3.0, 3.0, 3.0, 0.5, None), (1, 1, False, None, None, None, 4.5, 4.5, None, None), (1, 2, False, None, None, None, 5.25, 4.5, None, None),
        (1, 3, True, "assistant", 2, 6.0, 6.0, 6.0, 1.0, None), (1, 4, False, None, None, None, 3.0, 3.0, None, None), (1, 5, True, "user", 1, None, 1.5, 3.0, None, None), (1, 6, True, "user", 1, 0.0, 0.0, 0.0, 0.0, None),
        (2, 0, False, None, None, None, None, 2.0, None, None), (2, 1, False, None, None, None, None, 2.0, None, None), (2, 2, True, None, 1, 2.0, 2.0, 2.0, None, None),
        (3, 0, True, "u", 1, 1.0, 1.0, 1.0, None, None), (6, 0, True, "u", 1, None, None, None, None, None),
    ], key=repr)


def test_series_replace_an_older_output_as_a_whole(spark, place):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    turns.write.parquet(place("a"))
    turns.where("conv_id % 16 = 3").write.parquet(place("b"))
    turn_series.run(spark, turn_series.DEFAULTS, place("a"), place("out"))
    turn_series.run(spark, turn_series.DEFAULTS, place("b"), place("out"))
    assert {r[0] for r in turn_series.output_of(spark, place("out")).select("part").distinct().collect()} == {3}
    turns.where("false").write.parquet(place("c"))
    assert turn_series.run(spark, turn_series.DEFAULTS, place("c"), place("out")) == {"read": 0, "written": 0}


def test_series_read_texts_once(spark, place):
    plan = turn_series.series(turn_series.turns(spark.read.parquet(f"{SF}/conversations.parquet")), turn_series.DEFAULTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_command_line_of_both_jobs(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    out = run("jobs.turn_series", "--config", f"file://{ROOT}/jobs/turn_series.json", "--conversations", f"{SF}/conversations.parquet", "--output", f"file://{tmp_path}/series")
    assert out.returncode == 0 and "read 87 rows" in out.stderr and len(list((tmp_path / "series").glob("part=*"))) > 3
    for n in (1000, 0):
        out = run("jobs.track_features", "--events", f"{SF}/events.parquet", "--output", f"file://{tmp_path}/features", "--checkpoint", f"file://{tmp_path}/state")
        assert out.returncode == 0 and f"read {n} detections" in out.stderr
