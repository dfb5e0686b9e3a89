"""Splitting touching objects against a whole-frame reference by loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.model import Scale
from trackweave.operators import suppression, watershed

ONE = Scale(1.0, 1.0, 1.0)


def reference(places, scale, reach, depth):
    """The rule over a set of (z, y, x): label of each."""
    s = (scale.z, scale.y, scale.x)
    r = [int(reach / k) + 1 for k in s]
    near = sorted((sum((o * k) ** 2 for o, k in zip(off, s, strict=True)), off) for off in itertools.product(*[range(-n, n + 1) for n in r]))
    d2 = {p: next((min(v, reach**2) for v, off in near if tuple(a + o for a, o in zip(p, off, strict=True)) not in places), reach**2) for p in places}
    around = [o for o in itertools.product((-1, 0, 1), repeat=3)]

    def top(p):
        while True:
            q = min((tuple(a + o for a, o in zip(p, off, strict=True)) for off in around if tuple(a + o for a, o in zip(p, off, strict=True)) in places), key=lambda q: (-d2[q], q))
            if q == p:
                return p
            p = q

    hill = {p: top(p) for p in places}
    saddle = {}
    for p in places:
        for axis in range(3):
            q = tuple(a + (k == axis) for k, a in enumerate(p))
            if q in places and hill[p] != hill[q]:
                pair = tuple(sorted((hill[p], hill[q])))
                saddle[pair] = max(saddle.get(pair, 0), min(d2[p], d2[q]))
    first = {h: h for h in hill.values()}
    for _ in first:
        for (a, b), low in saddle.items():
            if math.sqrt(min(d2[a], d2[b])) - math.sqrt(low) < depth:
                first[a] = first[b] = min(first[a], first[b])
    number = {f: n + 1 for n, f in enumerate(sorted(set(first.values())))}
    return {p: number[first[hill[p]]] for p in places}


def balls(centres, radius):
    c = np.array(centres)
    grid = np.stack(np.meshgrid(*[np.arange(c[:, k].max() + radius + 2) for k in range(3)], indexing="ij"), -1)
    return {tuple(map(int, p)) for p in np.argwhere((np.linalg.norm(grid[..., None, :] - c, axis=-1) < radius).any(-1))}


def labels(spark, frames, *args, **more):
    rows = spark.createDataFrame([(t, *p) for t, places in frames.items() for p in places], "t int, z int, y int, x int").withColumns({"label": F.lit("own"), "place": F.lit(1)})
    out = {}
    for r in watershed.split_touching(rows, *args, **more).collect():
        out.setdefault(r.t, {})[r.z, r.y, r.x] = r.label
    return out


def test_two_overlapping_balls_are_two_objects(spark):
    two, one = balls([(9, 9, 9), (9, 9, 20)], 8), balls([(9, 9, 9)], 8)
    got = labels(spark, {0: two, 1: one}, ONE, 20.0, 1.0, tile=16)
    assert set(got[0].values()) == {1, 2} and set(got[1].values()) == {1} and len(got[0]) == len(two)
    assert all(got[0][p] == got[0][9, 9, 9] for p in two if p[2] < 13) and all(got[0][p] == got[0][9, 9, 20] for p in two if p[2] > 16)


@pytest.mark.parametrize("tile", [5, 11, 64])
def test_tiles_do_not_change_labels(spark, tile):
    rng = np.random.default_rng(3)
    frames = {
        0: balls([(6, 6, 6), (6, 6, 14), (7, 15, 10)], 5), 1: {tuple(map(int, p)) for p in np.argwhere(rng.random((9, 14, 13)) < 0.8)},
        2: set(itertools.product(range(4), range(17), range(12))), 3: {(0, 0, 0)}, 4: {(2, 2, k) for k in range(30)},
    }
    for scale, reach, depth in ((ONE, 4.0, 0.6), (Scale(0.75, 0.173, 0.173), 0.8, 0.05)):
        assert labels(spark, frames, scale, reach, depth, tile=tile) == {t: reference(p, scale, reach, depth) for t, p in frames.items()}


def test_no_foreground_and_negative_places(spark):
    none = spark.createDataFrame([], "t int, z int, y int, x int")
    assert watershed.split_touching(none).count() == 0
    with pytest.raises(Exception, match="places must be"):
        labels(spark, {0: {(0, 0, -1)}})


@pytest.mark.parametrize("seed", range(3))
def test_suppression_is_the_sequential_greedy_rule(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(160):
        low = rng.uniform(-30, 30, 3)
        high = low + rng.uniform(2, 14, 3)
        rows.append((int(k % 3), k, float(rng.choice([0.4, 0.6, 0.6, 0.7, rng.random()])), *map(float, low), *map(float, high)))

    def iou(a, b):
        common = math.prod(max(0.0, min(a[6 + k], b[6 + k]) - max(a[3 + k], b[3 + k])) for k in range(3))
        size = lambda r: math.prod(r[6 + k] - r[3 + k] for k in range(3))
        return common / (size(a) + size(b) - common)

    kept = []
    for r in sorted((r for r in rows if r[2] >= 0.5), key=lambda r: (-r[2], r[1])):
        if not any(o[0] == r[0] and iou(o, r) > 0.1 for o in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "t int, id int, score double, z0 double, y0 double, x0 double, z1 double, y1 double, x1 double")
    got = suppression.suppress(df, least=0.5, most=0.1)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(kept) and len(kept) < sum(r[2] >= 0.5 for r in rows)


def test_suppression_of_nothing_and_of_flat_boxes(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 2, 0.8, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "t int, id int, score double, z0 double, y0 double, x0 double, z1 double, y1 double, x1 double")
    assert suppression.suppress(df).count() == 2 and suppression.suppress(df.limit(0)).count() == 0


def test_hills_hold_one_tile_and_its_halo(spark):
    rows = spark.createDataFrame([(0, z, y, x) for z, y, x in itertools.product(range(3), range(40), range(40))], "t int, z int, y int, x int")
    plan = watershed.hills(rows, ONE, 2.0, 8)
    assert plan.count() == rows.count() and plan.where(F.col("away")).count() > 0
