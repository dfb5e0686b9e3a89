"""Resampled volumes against interpolation by numpy; the edit log against replays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import edits, resample


def rows_of(v, t=0):
    return [(t, *map(int, p), float(v[tuple(p)])) for p in np.argwhere(np.ones_like(v))]


def along(v, axis, factor):
    n = v.shape[axis]
    m = max(1, int(np.rint(n * factor)))
    at = np.clip((np.arange(m) + 0.5) / factor - 0.5, 0, n - 1)
    return np.apply_along_axis(lambda line: np.interp(at, np.arange(n), line), axis, v)


@pytest.mark.parametrize("factors", [(1, 0.23, 0.23), (2.0, 0.5, 1.7), (0.4, 3, 1), (1, 1, 1), (0.01, 0.9, 1.1)])
def test_resampling_equals_interpolation_line_by_line(spark, factors):
    rng = np.random.default_rng(1)
    stacks = {0: rng.normal(size=(3, 17, 22)), 5: rng.normal(size=(1, 9, 1))}
    df = spark.createDataFrame([r for t, v in stacks.items() for r in rows_of(v, t)], "t int, z int, y int, x int, value double")
    got = {}
    for r in resample.resample(df, factors).collect():
        got.setdefault(r.t, {})[r.z, r.y, r.x] = r.value
    for t, v in stacks.items():
        want = v
        for axis, f in enumerate(factors):
            want = along(want, axis, f) if f != 1 else want
        assert set(got[t]) == set(np.ndindex(want.shape)) and all(abs(got[t][p] - want[p]) < 1e-9 for p in got[t])


@pytest.mark.parametrize("factors", [(1, 0.23, 0.23), (2.0, 0.5, 1.7), (0.01, 0.9, 1.1)])
def test_labels_come_back_to_every_place(spark, factors):
    shape = (3, 17, 22)
    small = [max(1, int(np.rint(n * f))) for n, f in zip(shape, factors, strict=True)]
    rng = np.random.default_rng(2)
    v = rng.integers(1, 99, small)
    df = spark.createDataFrame([(7, *map(int, p), int(v[tuple(p)])) for p in np.argwhere(v)], "t int, z int, y int, x int, label int")
    got = {(r.z, r.y, r.x): r.label for r in resample.labels_back(df, factors, spark.createDataFrame([(7, *shape)], "t int, nz int, ny int, nx int")).collect()}
    place = [np.clip(np.ceil((np.arange(n) + 0.5) * f - 1).astype(int), 0, m - 1) for n, f, m in zip(shape, factors, small, strict=True)]
    assert got == {p: int(v[tuple(place[k][p[k]] for k in range(3))]) for p in np.ndindex(shape)}


POINTS = [(i, t, 0.0, float(i), float(t)) for i in range(12) for t in range(5)]


def test_any_version_is_its_replay(spark, tmp_path):
    rng = random.Random(2)
    log, points = f"file://{tmp_path}/log", spark.createDataFrame(POINTS, "id long, t int, z double, y double, x double")
    assert edits.read(spark, log).count() == 0
    versions = [[(rng.randrange(14), rng.randrange(6), rng.choice(["put", "put", "cut"]), 1.0, 2.0, float(10 * v + k), k) for k in range(9)] for v in range(1, 5)]
    for v, some in enumerate(versions, 1):
        for _ in range(2):  # appended again: it replaces itself
            edits.append(spark.createDataFrame(some, edits.EDITS), log, v)
    state = {(i, t): p for i, t, *p in POINTS}
    for v in range(5):
        for i, t, kind, *p, _ in sorted(versions[v - 1], key=lambda e: e[-1]) if v else ():
            state.pop((i, t), None)
            if kind == "put":
                state[i, t] = p
        got = {(r.id, r.t): [r.z, r.y, r.x] for r in edits.as_of(points, edits.read(spark, log), v).collect()}
        assert got == state
    with pytest.raises(Exception, match="no such kind"):
        edits.append(spark.createDataFrame([(1, 1, "burn", 0.0, 0.0, 0.0, 0)], edits.EDITS), log, 9)


def test_refresh_makes_touched_parts_only(spark, tmp_path):
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    points = spark.createDataFrame(POINTS, "id long, t int, z double, y double, x double")
    owner = points.select("id", F.floor(F.col("id") / 3).cast("int").alias("cell")).distinct()
    make = lambda p: p.groupBy("cell", "t").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    make(edits.as_of(points, edits.read(spark, log), 0).join(owner, "id")).write.partitionBy("cell").parquet(out)
    stamp = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("cell=*/part-*")}
    before = stamp()
    edits.append(spark.createDataFrame([(4, 2, "cut", None, None, None, 0), (10, 9, "put", 0.0, 0.0, 7.0, 1)], edits.EDITS), log, 1)
    edits.append(spark.createDataFrame([(5, 1, "put", 0.0, 0.0, 99.0, 0)], edits.EDITS), log, 2)
    table = lambda v: sorted(tuple(r) for r in make(edits.as_of(points, edits.read(spark, log), v).join(owner, "id")).select("cell", "t", "n", "x").collect())
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(out).select("cell", "t", "n", "x").collect())
    assert edits.refresh(points, edits.read(spark, log), 0, 1, owner, "cell", make, out) == 2 and read() == table(1)
    middle = stamp()
    assert {k: v for k, v in middle.items() if "cell=0" in str(k) or "cell=2" in str(k)} == {k: v for k, v in before.items() if "cell=0" in str(k) or "cell=2" in str(k)}
    assert edits.refresh(points, edits.read(spark, log), 1, 2, owner, "cell", make, out) == 1 and read() == table(2)
    assert edits.refresh(points, edits.read(spark, log), 2, 2, owner, "cell", make, out) == 0
    assert {k: v for k, v in stamp().items() if "cell=3" in str(k)} == {k: v for k, v in middle.items() if "cell=3" in str(k)}
    with pytest.raises(ValueError, match="parts"):
        edits.refresh(points, edits.read(spark, log), 0, 2, owner, "cell", make, out, most=1)
