"""Operators against plain Python loops that state the semantics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import scalars as S
from trackweave.operators import aggregates, curation, kinematics, linking, persistence, spatial, spine, stats, tables, tracking, voxel
from trackweave.sources import shared

POINT = "id long, cell_id long, t int, x double, y double, z double"


def series(spark, values, column="v"):
    return spark.createDataFrame([(0, t, v) for t, v in enumerate(values)], f"cell_id int, t int, {column} double")


def in_order(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("t").select(*columns).collect()]


def test_densify_fills_heads_gaps_and_tails(spark):
    rows = spark.createDataFrame([(1, 7, 1, 1.0), (1, 7, 4, 4.0), (2, 7, 0, 9.0), (2, 7, 5, 8.0)], "id long, cell_id long, t int, v double")
    got = {(r.id, r.t): (r.cell_id, r.v, r.present) for r in spine.densify(rows, "id", same=("cell_id",)).collect()}
    assert set(got) == {(i, t) for i in (1, 2) for t in range(6)}
    assert got[1, 0] == (7, None, False) and got[1, 4] == (7, 4.0, True) and got[1, 5] == (7, None, False) and got[2, 3] == (7, None, False)
    again = spine.densify(spine.densify(rows, "id", same=("cell_id",)).drop("present"), "id", same=("cell_id",))
    assert again.count() == 12  # already dense series stay as they are


def test_densify_keeps_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 2, 3.0)], "id long, t int, v double")
    assert sorted((r.t, r.v) for r in spine.densify(rows, "id").where("present").collect()) == [(0, 1.0), (0, 2.0), (2, 3.0)]
    assert spine.densify(rows.limit(0), "id").count() == 0


def loop_gapfill(values):
    v, last = list(values), next((x for x in reversed(values) if x is not None), None)
    for i, x in enumerate(v):
        if x is None:
            nxt = next((y for y in values[i + 1 :] if y is not None), None)
            prev = v[i - 1] if i else last
            v[i] = None if nxt is None or prev is None else (prev + nxt) / 2
    return v


@pytest.mark.parametrize("values,want", [((4.0, None, None, 8.0), [4, 6, 7, 8]), ((None, 2.0, 10.0), [6, 2, 10])])
def test_gapfill_golden(spark, values, want):
    assert in_order(spine.gapfill_midpoint(series(spark, values), ["v"], ["cell_id"]), "v") == want


def test_gapfill_is_the_loop(spark):
    rng = random.Random(3)
    for _ in range(6):
        values = [None if rng.random() < 0.5 else float(rng.randint(0, 64)) for _ in range(14)]
        got = in_order(spine.gapfill_midpoint(series(spark, values), ["v"], ["cell_id"]), "v")
        assert got == pytest.approx(loop_gapfill(values)), values


def test_leading_gap_without_wrap_stays(spark):
    assert in_order(spine.gapfill_midpoint(series(spark, (None, 2.0, None)), ["v"], ["cell_id"], wrap=False), "v") == [None, 2.0, None]


def loop_smooth(n):
    out = []
    for t in range(len(n)):
        w = n[max(0, t - 2) : min(len(n) - 1, t + 3)]
        top = max(w.count(x) for x in w)
        out.append(float(min(x for x in w if w.count(x) == top)) if top > 1 else float(np.median(w)))
    return out


def test_smoothing_is_the_loop(spark):
    rng = random.Random(5)
    for n in ([1, 1, 2, 4, 4, 9], [rng.randint(0, 4) for _ in range(30)]):
        rows = spark.createDataFrame([(0, t, v) for t, v in enumerate(n)], "cell_id int, t int, n int")
        assert in_order(spine.smooth_counts(rows, ["cell_id"]), "n_smooth") == loop_smooth(n)


def loop_runs(cos):
    c, out = 1, []
    for x in cos:
        kept = x is not None and x >= 0.7
        out.append((kept, c))
        c = c + 1 if kept else 1
    return out


def test_run_counter(spark):
    rng = random.Random(1)
    for cos in ([0.9, 0.8, None, 0.9, 0.1], [rng.choice([None, 0.7, 0.9, 0.1]) for _ in range(60)]):
        rows = spark.createDataFrame([(1, t, x) for t, x in enumerate(cos)], "id long, t int, cos double")
        assert in_order(persistence.run_counter(rows), "kept", "c") == loop_runs(cos)


def test_run_length_histogram_is_numpy(spark):
    rng = random.Random(2)
    cos = {i: [rng.choice([0.9, 0.9, 0.1]) for _ in range(50)] for i in (1, 2)} | {3: [0.1] * 5, 4: [0.9, 0.1] * 5}
    rows = spark.createDataFrame([(i, t, x) for i, v in cos.items() for t, x in enumerate(v)], "id long, t int, cos double")
    got = persistence.runlength_hist(persistence.run_counter(rows)).collect()
    for i, v in cos.items():
        lengths = [c for kept, c in loop_runs(v) if not kept]
        want, _ = np.histogram(lengths, bins=max(1, max(lengths) - 1), density=True)
        assert [r.density for r in sorted((r for r in got if r.id == i), key=lambda r: r.bin)] == pytest.approx(list(want))


def test_directions_and_angles(spark):
    at = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0)]
    rows = spark.createDataFrame([(1, 0, t, *map(float, p)) for t, p in enumerate(at)], POINT)
    got = in_order(kinematics.directions(rows), "t", "inner", "angle", "norm")
    assert [g[2] for g in got[1:6]] == pytest.approx([0.5, 0.0, 1.0, None, None])
    assert [g[1] for g in got] == [False] + [True] * 5 + [False] and got[0][3] is None
    assert [r.speed for r in kinematics.speed(rows).orderBy("t").collect()] == [1, 1, 1, 1, 0, 1]


def test_golden_angles_and_rounding(spark):
    row = spark.range(1).select(
        S.angle_over_pi(F.lit(0.0)).alias("a"), S.angle_over_pi(F.lit(1.0000000001)).alias("b"), S.angle_over_pi(F.lit(-1.5)).alias("c"), S.angle_over_pi(F.lit(None).cast("double")).alias("n"),
        S.round_even(F.lit(2.5)).alias("r"), S.trunc(F.lit(-1.7)).alias("t"), S.trunc(F.lit(2.9)).alias("u"),
    ).first()
    assert tuple(row) == (0.5, 0.0, 1.0, None, 2.0, -1, 2)


def test_correlation_is_pairwise_complete_and_null_for_constants(spark):
    rng = np.random.default_rng(0)
    v = {i: [None if rng.random() < 0.3 else float(rng.normal()) for _ in range(20)] for i in (1, 2)} | {3: [1.0] * 20}
    rows = spark.createDataFrame([(i, 0, t, x) for i, xs in v.items() for t, x in enumerate(xs)], "id long, cell_id long, t int, v double")
    got = {(r.id_a, r.id_b): r.r_v for r in stats.correlation(rows, ["v"]).collect()}
    pair = np.array([(a, b) for a, b in zip(v[1], v[2]) if a is not None and b is not None])
    assert got[1, 2] == pytest.approx(np.corrcoef(pair.T)[0, 1]) and got[1, 1] == pytest.approx(1.0) and got[3, 1] is None and len(got) == 9


def test_two_predictor_fit_is_least_squares(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50), rng.normal(size=50)
    v = 2 * a - 3 * b + 1 + rng.normal(size=50) / 10
    rows = spark.createDataFrame([(0, float(x), float(y), float(z)) for x, y, z in zip(a, b, v)] + [(0, 1.0, 1.0, None), (1, 1.0, 2.0, 3.0)], "cell_id int, a double, b double, v double")
    got = {r.cell_id: r for r in stats.ols(rows, "a", "b", "v").collect()}
    want = np.linalg.lstsq(np.column_stack([a, b, np.ones(50)]), v, rcond=None)[0]
    assert (got[0].slope_a, got[0].slope_b, got[0].intercept) == pytest.approx(tuple(want)) and got[1].slope_a is None


def test_intensity_threshold(spark):
    samples = {0: [5] * 8, 1: [0, 0, 0, 0, 0, 0, 10, 20], 2: []}
    rows = spark.createDataFrame(list(samples.items()), "t int, values array<int>")
    got = {r.t: (r["size"], r.fluo) for r in voxel.fluo_threshold(rows).collect()}
    assert got[0] == (0, None) and got[2] == (0, None)
    limit = np.mean(samples[1]) + 1.15 * np.std(samples[1])
    assert got[1] == (sum(x > limit for x in samples[1]), np.mean([x for x in samples[1] if x > limit]))


def test_offsets():
    assert len(voxel.offsets()) == 79 and len(voxel.offsets(flat=True)) == 37
    assert max(abs(d[0]) for d in voxel.offsets()) == 1 and max(abs(d[1]) for d in voxel.offsets()) == 3


def test_nearest_ties_go_to_the_smallest_id_and_empty_frames_to_null(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)], "id long, t int, x double, y double, z double")
    n = spark.createDataFrame([(9, 0, 1.0, 0.0, 0.0), (4, 0, -1.0, 0.0, 0.0)], "target_id long, t int, x double, y double, z double")
    assert {(r.id, r.nuc_id, r.dist) for r in spatial.nearest(p, n).collect()} == {(1, 4, 1.0), (2, None, None)}


def test_cubes_find_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-20, 20, (60, 3)), rng.uniform(-20, 20, (60, 3))
    frame = lambda m, name: spark.createDataFrame([(k, k % 2, *map(float, v)) for k, v in enumerate(m)], f"{name} long, t int, x double, y double, z double")
    got = {(r.id, r.target_id) for r in spatial.radius_pairs(frame(a, "id"), frame(b, "target_id"), 7.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if i % 2 == j % 2 and np.linalg.norm(a[i] - b[j]) < 7}
    near = {r.id: r.nuc_id for r in spatial.nearest_within(frame(a, "id"), frame(b, "target_id"), 7.0).collect()}
    full = {r.id: (r.nuc_id, r.dist) for r in spatial.nearest(frame(a, "id"), frame(b, "target_id")).collect()}
    assert near == {i: n for i, (n, d) in full.items() if d < 7}


def test_nearest_compares_few_targets_in_several_tasks(spark):
    rng, calls = np.random.default_rng(5), spark.sparkContext.accumulator(0)
    frame = lambda name: spark.createDataFrame([(k, 0, *map(float, v)) for k, v in enumerate(rng.uniform(-20, 20, (400, 3)))], f"{name} long, t int, x double, y double, z double")

    @F.udf("double")
    def far(*v):
        calls.add(1)
        return math.dist(v[:3], v[3:])

    assert len(spatial.nearest_of(frame("id"), frame("target_id"), ["t"], far(*"xyz", "_x", "_y", "_z"), dict.fromkeys("xyz", 1.0)).collect()) == 400
    assert calls.value < 50 * 400
    assert shared.spread(spark.range(50), 20).rdd.getNumPartitions() == 3 and shared.spread(spark.range(0)).count() == 0


def test_mutual_links_in_a_crowd_sort_no_pairs(spark):
    """Every point is within reach of all others; places without a number and ties included."""
    rng = np.random.default_rng(8)
    rows = [(k, k % 3, *map(float, v)) for k, v in enumerate(rng.integers(-9, 9, (90, 3)))] + [(900, 0, math.nan, 0.0, 0.0), (901, 1, None, 0.0, 0.0), (902, 1, math.inf, 0.0, 0.0)]
    links = linking.mutual_links(spark.createDataFrame(rows, "id long, t int, x double, y double, z double"), 1000.0)
    at = {t: [(i, x) for i, u, *x in rows[:90] if u == t] for t in range(3)}
    best = lambda x, t: min((math.dist(x, y), i) for i, y in at[t])[1]
    want = {(t, i, best(x, t + 1)) for t in (0, 1) for i, x in at[t] if best(dict(at[t + 1])[best(x, t + 1)], t) == i}
    assert {(r.t, r.id_a, r.id_b) for r in links.collect()} == want
    assert "Window" not in links._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_points,n_targets,spread", [(150, 300, "even"), (150, 300, "far"), (40, 3, "even"), (60, 200, "line"), (30, 100, "one place")])
def test_nearest_by_cubes_is_the_nearest(spark, n_points, n_targets, spread):
    """Against all pairs: even and crowded frames, points far from all targets, flat ones; whole numbers give ties."""
    rng = np.random.default_rng(n_points)
    a, b = rng.integers(-40, 40, (n_points, 3)).astype(float), rng.integers(-40, 40, (n_targets, 3)).astype(float)
    if spread == "far":
        a, b = a * 50, b / 20
    elif spread == "line":
        a[:, 1:], b[:, 1:] = 0, 0
    elif spread == "one place":
        b[:] = 5
    p = [(k, k % 3, *map(float, v)) for k, v in enumerate(a)] + [(9000, 0, None, 1.0, 1.0), (9001, 7, 1.0, 1.0, 1.0)]
    n = [(k, k % 2, *map(float, v)) for k, v in enumerate(b)] + [(9999, 0, None, 0.0, 0.0)]
    want = {(i, t): None for i, t, *_ in p}
    for i, t, *x in p[:n_points]:
        near = [(math.dist(x, y), j) for j, u, *y in n[:n_targets] if u == t]
        want[i, t] = min(near, default=None)
    points, targets = spark.createDataFrame(p, "id long, t int, x double, y double, z double"), spark.createDataFrame(n, "target_id long, t int, x double, y double, z double")
    got = {(r.id, r.t): None if r.nuc_id is None else (r.dist, r.nuc_id) for r in spatial.nearest(points, targets).collect()}
    assert {k: v and v[1] for k, v in got.items()} == {k: v and v[1] for k, v in want.items()}
    assert all(v is None or abs(v[0] - want[k][0]) < 1e-9 for k, v in got.items())
    inner = {(r.id, r.t) for r in spatial.nearest(points, targets, keep="inner").collect()}
    assert inner == {k for k, v in want.items() if v is not None}


def test_nearest_voxel_is_the_nearest(spark):
    rng = np.random.default_rng(1)
    labels = [(t, z, y, x, int(rng.integers(0, 4))) for t in range(2) for z in range(5) for y in range(7) for x in range(9)]
    spots = [(t, 100 * t + k, *map(int, rng.integers(0, 5, 3))) for t in range(3) for k in range(40)]
    chosen = {(0, 1), (0, 2), (1, 3)}
    cols = "t int, z int, y int, x int, label int"
    got = voxel.nearest_voxel(spark.createDataFrame(spots, "t int, id long, z int, y int, x int"), spark.createDataFrame(labels, cols), spark.createDataFrame(sorted(chosen), "t int, label int"))
    for r in got.collect():
        t, _, *p = next(s for s in spots if s[1] == r.id)
        dist = lambda v: math.sqrt(sum(((a - b) * c) ** 2 for a, b, c in zip(p, v, (0.75, 0.173, 0.173), strict=True)))  # noqa: E731, B023
        near = min(((round(dist(v[1:4]), 9), v[4]) for v in labels if v[0] == t and (t, v[4]) in chosen), default=(None, None))
        assert (r.dist_nuc if r.dist_nuc is None else round(r.dist_nuc, 9), r.nuc_id) == near


def test_null_models_differ_between_cells_and_take_frames_from_a_table(spark):
    cos = spark.createDataFrame([(c, i, 1, 0.5) for c in (0, 1) for i in (1, 2)], "cell_id long, id long, t int, cos double")
    table = spark.createDataFrame([(1, 0.2), (2, 0.5)], "c int, prob double")
    rows = persistence.null_models(cos, table, spark.range(1).select(F.lit(12).alias("n_frames"))).collect()
    by = {c: [r.cos for r in rows if r.cell_id == c and r.model == "uniform"] for c in (0, 1)}
    assert len(by[0]) == len(by[1]) == 20 and not set(by[0]) & set(by[1])


def test_registration_round_trip(spark):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(k, 0, k % 5, *map(float, rng.integers(0, 99, 3))) for k in range(30)], POINT)
    ref = spark.createDataFrame([(t, float(t), 2.0, 3.0) for t in range(5)], "t int, x double, y double, z double")
    back = spatial.unregister(spatial.register(p, ref), ref).select("id", "x", "y", "z")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in p.select("id", "x", "y", "z").collect()}


def test_priority_candidates(spark):
    n = spark.createDataFrame([(14, 0), (5, 0), (59, 1), (14, 1), (583, 30)], "id long, t int").withColumns({c: F.lit(0.0) for c in "xyz"})
    c = spark.createDataFrame([(7, 0, 29, 0, 59), (7, 0, 29, 1, 14), (7, 30, 99, 0, 583), (7, 0, 99, 2, 5)], "cell_id long, t_lo int, t_hi int, prio int, id long")
    assert {(r.t, r.id) for r in spatial.by_priority(c, n).collect()} == {(0, 14), (1, 59), (30, 583)}


EXAMPLES = [
    ("ID 8\n342: 7\n183: Disappear in 6\n134: 4 Reappear", [(342, 349, 8, 8), (183, 342, 7, 7), (134, 183, None, 6), (-1, 134, 4, 4)]),
    ("ID 5\n349: nan\n332: 5 Appear\n\n100: Disappear\n", [(332, 349, None, None), (100, 332, 5, 5), (-1, 100, None, None)]),
]


@pytest.mark.parametrize("text,want", EXAMPLES)
def test_curation_examples(spark, text, want):
    got = curation.intervals(curation.parse(spark.createDataFrame([(1, text)], "cell_id long, text string")), 349)
    assert [(r.t_lo, r.t_hi, r.raw_id, r.merge_id) for r in got.orderBy(F.desc("t_hi")).collect()] == want


def test_curation_applies_and_merges(spark):
    points = spark.createDataFrame([(i, t) for i in (4, 6, 7, 8) for t in (0, 134, 135, 183, 184, 342, 343, 349)], "id long, t int").withColumns({c: F.col("id").cast("double") for c in "xyz"})
    edits = curation.intervals(curation.parse(spark.createDataFrame([(1, EXAMPLES[0][0])], "cell_id long, text string")), 349)
    numbered = curation.numbered(edits, [3, 8])
    raw = {(r.id, r.t): r.x for r in curation.apply(numbered, points).collect()}
    merged = {(r.id, r.t): r.x for r in curation.apply(numbered, points, merged=True).collect()}
    assert raw == {(2, 0): 4, (2, 134): 4, (2, 184): 7, (2, 342): 7, (2, 343): 8, (2, 349): 8}
    assert merged == raw | {(2, 135): 6, (2, 183): 6}


def test_curation_errors(spark):
    up = curation.parse(spark.createDataFrame([(1, "ID 8\n10: 7\n20: 6")], "cell_id long, text string"))
    with pytest.raises(Exception, match="frames ascend in block 8"):
        curation.intervals(up, 349).collect()
    ok = curation.intervals(curation.parse(spark.createDataFrame([(1, "ID 8\n10: 7")], "cell_id long, text string")), 349)
    with pytest.raises(Exception, match="block id not in the list: 8"):
        curation.numbered(ok, [1]).collect()


def test_null_nucleus_counts_once_and_has_no_spots(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 0, None), (0, 1, 2)], "cell_id long, t int, nuc_id long")
    assert {(r.t, r.n) for r in rows.groupBy("cell_id", "t").agg(aggregates.distinct_nuclei().alias("n")).collect()} == {(0, 2), (1, 1)}
    assert {(r.t, r.n) for r in rows.groupBy("cell_id", "t").agg(aggregates.distinct_nuclei(False).alias("n")).collect()} == {(0, 1), (1, 1)}
    assert {(r.t, r.nuc_id, r.n) for r in aggregates.per_nucleus(rows).collect()} == {(0, 1, 2), (0, None, 0), (1, 2, 1)}


def test_nucleus_positions(spark):
    rows = spark.createDataFrame([(0, 3, 1.0, 2), (1, 3, 1.0, 2), (1, 4, 5.0, 1), (2, 9, 1.0, 1), (2, 7, 2.0, 2), (2, 5, 3.0, 4), (2, 1, 9.0, 8)], "t int, nuc_id long, x double, n long")
    got = {(r.t, r.position): (r.label, r.n) for r in aggregates.nucleus_positions(rows).collect()}
    assert got == {(0, "left"): (3, 2), (1, "left"): (3, 2), (1, "right"): (4, 1), (2, "left"): (9, 1), (2, "middle"): (5, 6), (2, "right"): (1, 8)}


def test_nucleus_positions_list_their_spots(spark):
    rows = spark.createDataFrame([(0, 9, 1.0, 1, [4]), (0, 7, 2.0, 2, [8, 3]), (0, 5, 3.0, 2, [2, 6]), (0, 1, 9.0, 1, [5]), (1, 3, 1.0, 2, [7, 1])], "t int, nuc_id long, x double, n long, spots array<long>")
    got = {(r.t, r.position): (r.label, r.n, r.spots) for r in aggregates.nucleus_positions(rows).collect()}
    assert got == {(0, "left"): (9, 1, [4]), (0, "middle"): (5, 4, [2, 3, 6, 8]), (0, "right"): (1, 1, [5]), (1, "left"): (3, 2, [1, 7])}


def test_relabel_and_nearest_voxel(spark):
    labels = spark.createDataFrame([(0, 0, 0, x, 1 if x < 3 else 2, 9) for x in range(6)], "t int, z int, y int, x int, label int, value int")
    seeds = spark.createDataFrame([(0, 7, 0.0, 0.0, 0.0), (0, 8, 0.0, 0.0, 0.173 * 2.4), (0, 9, 99.0, 0.0, 0.0)], "t int, id long, z double, y double, x double")
    assert {(r.x, r.track_id) for r in voxel.relabel_by_seed(labels, seeds).collect()} == {(0, 8), (1, 8), (2, 8)}
    spots = spark.createDataFrame([(0, 1, 0, 0, 0), (0, 2, 0, 0, 5), (1, 3, 0, 0, 0)], "t int, id long, z int, y int, x int")
    chosen = spark.createDataFrame([(0, 2)], "t int, label int")
    got = {r.id: (r.nuc_id, r.dist_nuc) for r in voxel.nearest_voxel(spots, labels, chosen).collect()}
    assert got[1] == (2, pytest.approx(3 * 0.173)) and got[2] == (2, 0.0) and got[3] == (None, None)


def test_lift_takes_the_first_maximum(spark):
    v = spark.createDataFrame([(0, z, 1, 2, val) for z, val in enumerate([1, 9, 9, 3])], "t int, z int, y int, x int, value int")
    s = spark.createDataFrame([(0, 5, 2.9 * 0.173, 1.2 * 0.173), (0, 6, 99.0, 0.0)], "t int, id long, position_x double, position_y double")
    assert [(r.id, r.z, r.position_z) for r in voxel.lift(s, v).collect()] == [(5, 1, 0.75)]


def test_links_chains_and_gaps(spark):
    rows = [(10, 0, 0.0), (11, 1, 0.4), (12, 2, 0.8), (20, 0, 50.0), (21, 2, 50.2), (30, 1, 0.9)]
    p = spark.createDataFrame([(i, t, x, 0.0, 0.0, 0) for i, t, x in rows], "id long, t int, x double, y double, z double, movie int")
    links = linking.mutual_links(p, 5.0)
    assert {(r.id_a, r.id_b) for r in links.collect()} == {(10, 11), (30, 12)}
    assert linking.chains(p, links).count() == 6
    assert {(r.id, r.head, r.place) for r in linking.chains(p, links, 3).collect()} == {(10, 10, 0), (11, 10, 1), (12, 30, 1), (20, 20, 0), (21, 21, 0), (30, 30, 0)}
    track = {r.id: r.track for r in linking.link_frames(p, "movie", 5.0).collect()}
    assert track[20] == track[21] and track[10] == track[11] and len(set(track.values())) == 3
    lost = {r.id: r.track for r in linking.link_frames(p, "movie", 5.0, max_lost=0).collect()}
    assert lost[20] != lost[21]


def test_dense_relabel(spark):
    p = spark.createDataFrame([(x,) for x in (70000, 5, 5, 9, 200000, None)], "id long")
    assert {(r.id, r.new_id) for r in linking.dense_relabel(p, width=1000).collect()} == {(5, 1), (9, 2), (70000, 3), (200000, 4)}
    pts = spark.createDataFrame([(7, 0), (9, 0)], "id long, t int")
    graph = spark.createDataFrame([(9, 7)], "child long, parent long")
    moved, edges = linking.relabel_points(pts, graph)
    assert {r.id for r in moved.collect()} == {1, 2} and [tuple(r) for r in edges.collect()] == [(2, 1)]


def test_null_models_follow_one_stream(spark):
    prob = {1: 0.2, 2: 0.5}
    a, b = persistence.simulate([1, 2], 20, prob)
    assert persistence.simulate([1, 2], 20, prob) == (a, b) and len(a) == len(b) == 36
    rng = random.Random(42)
    assert a[0][2] == math.cos(rng.uniform(0, 2 * math.pi))
    cos = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 1, 0.5)], "cell_id long, id long, t int, cos double")
    table = spark.createDataFrame([(1, 0.2), (2, 0.5)], "c int, prob double")
    got = {(r.model, r.id, r.t): r.cos for r in persistence.null_models(cos, table, 20).collect()}
    assert got == {("uniform", *x[:2]): x[2] for x in a} | {("t_prob", *x[:2]): x[2] for x in b}


def test_edits_are_a_superset(spark):
    p = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0)], "id long, t int, x double")
    out = tables.apply_point_edits(p, p.where("id = 1"), spark.createDataFrame([(3, 0, 1.0)], "id long, t int, x double"))
    assert {r.id for r in out.collect()} == {2, 3}


def test_segmentation_finds_components(spark):
    on = {(0, 0, 0), (0, 0, 1), (0, 2, 2), (1, 2, 2)}
    rows = [(0, z, y, x, 100 if (z, y, x) in on else 0) for z in range(2) for y in range(3) for x in range(3)]
    got = {(r.z, r.y, r.x): r.label for r in voxel.segment(spark.createDataFrame(rows, "t int, z int, y int, x int, value int")).collect()}
    assert set(got) == on and got[0, 0, 0] == got[0, 0, 1] != got[0, 2, 2] == got[1, 2, 2]


def flood(on):
    """Labels of 6-connected components by their first place, from 1."""
    label = {}
    for start in sorted(on):
        if start not in label:
            n, todo = 1 + max(label.values(), default=0), [start]
            while todo:
                p = todo.pop()
                if p in on and p not in label:
                    label[p] = n
                    todo += [tuple(v + s * (k == j) for j, v in enumerate(p)) for k in range(3) for s in (-1, 1)]
    return label


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_segmentation_does_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(8)
    on = {t: {tuple(int(v) for v in p) for p in np.argwhere(rng.random((7, 8, 9)) < share)} for t, share in ((0, 0.3), (4, 0.45))}
    rows = [(t, z, y, x, 100 if (z, y, x) in on[t] else 0) for t in on for z in range(7) for y in range(8) for x in range(9)]
    rows += [(9, 0, 0, x, 5) for x in range(4)]  # a flat frame has no foreground
    got = voxel.segment(spark.createDataFrame(rows, "t int, z int, y int, x int, value int"), tile=tile).collect()
    assert {(r.t, r.z, r.y, r.x): r.label for r in got} == {(t, *p): n for t in on for p, n in flood(on[t]).items()}
    assert voxel.segment(spark.createDataFrame([], "t int, z int, y int, x int, value int"), tile=tile).collect() == []


def test_selection_backfills_only_if_asked(spark):
    n = spark.createDataFrame([(7, 1, 0.0), (7, 3, 0.0)], "id long, t int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    p = spark.createDataFrame([(k, t, float(k)) for k in (1, 30) for t in range(5)], "id long, t int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    c = spark.createDataFrame([(0, 0, 9, 0, 7)], "cell_id long, t_lo int, t_hi int, prio int, id long")
    got = lambda **k: {(r.t, r.id) for r in spatial.select_spots(p, n, c, p.select("t").distinct(), **k).collect()}
    assert got() == {(1, 1), (3, 1)} and got(backfill=True) == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_linking_in_a_moving_frame(spark):
    rows = [(0, t, 10 * t + k, 50.0 * t + 5 * k) for t in range(4) for k in range(2)]
    p = spark.createDataFrame(rows, "cell_id long, t int, id long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    ref = spark.createDataFrame([(0, t, 50.0 * t) for t in range(4)], "cell_id long, t int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r.id: (r.track, r.x) for r in linking.link_registered(p, ref, "cell_id", 2.0).collect()}
    assert len({v[0] for v in got.values()}) == 2 and len({got[10 * t][0] for t in range(4)}) == 1 and got[31][1] == 155.0


def test_simulated_runs_pool_by_model(spark):
    rows = [("u", 1, t, c) for t, c in enumerate([0.9, 0.1, 0.9])] + [("v", 1, t, 0.9) for t in range(2)]
    df = spark.createDataFrame(rows, "model string, k long, t int, cos double").withColumn("id", F.struct("model", "k"))
    got = {(r.model, r.c): (r.p1, r.b1) for r in persistence.persistence_prob(persistence.run_counter(df), "model").collect()}
    assert got == {("u", 1): (2, 0), ("v", 1): (1, 0), ("v", 2): (1, 0)}


def test_nucleus_text_round_trip(spark):
    rows = [(1, 0, 5, 35), (1, 0, 3, None), (1, 10, 5, 36), (2, 2, 7, 1)]
    df = spark.createDataFrame(rows, "cell_id long, t int, id long, nuc_id long")
    text = curation.nucleus_lines(df)
    assert {r.cell_id: r.text for r in text.collect()} == {1: "T: 0\n3: nan\n5: 35\nT: 10\n5: 36\n", 2: "T: 2\n7: 1\n"}
    assert {tuple(r) for r in curation.nucleus_text(text).collect()} == set(rows)


def test_two_dimensions_have_z_zero(spark):
    p = spark.createDataFrame([(k, t, float(10 * k + t), 1.0, 9.0 * k * t, 0) for k in (1, 2) for t in range(3)], "id long, t int, x double, y double, z double, movie int")
    flat = tables.project(p, two_d=True).withColumn("movie", F.lit(0))
    assert {r.z for r in flat.collect()} == {0.0}
    named = flat.withColumn("id", F.col("id") * 100 + F.col("t"))
    track = {r.id: r.track for r in linking.link_frames(named, "movie", 3.0).collect()}
    assert track[100] == track[101] == track[102] != track[200] == track[202]


def test_missing_frames_and_moving_average(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 3, 4.0), (2, 1, 5.0)], "id long, t int, v double")
    assert {tuple(r) for r in spine.missing_frames(rows).collect()} == {(1, 1), (1, 2), (2, 0), (2, 2), (2, 3)}
    avg = {(r.id, r.t): r.v_avg for r in spine.moving_avg(spine.densify(rows, "id"), ["v"], ["id"]).collect()}
    assert avg[1, 1] == 2.5 and avg[1, 0] == 1.0 and avg[2, 3] == 5.0


def test_intensity_correction_scales_back(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, t, float(rng.normal()), 0.0, float(rng.integers(0, 9)), float(rng.uniform(5, 9))) for i in (1, 2) for t in range(12)]
    df = spark.createDataFrame(rows, "id long, cell_id long, t int, x double, y double, z double, fluo double")
    top = max(r[5] for r in rows)
    lo = {i: min(r[6] for r in rows if r[0] == i) for i in (1, 2)}
    hi = {i: max(r[6] for r in rows if r[0] == i) for i in (1, 2)}
    norm = np.array([(r[6] - lo[r[0]]) / (hi[r[0]] - lo[r[0]]) for r in rows])
    x = np.column_stack([[top - r[5] for r in rows], [r[2] for r in rows], np.ones(len(rows))])
    for log in (False, True):
        b = np.linalg.lstsq(x, np.log1p(norm) if log else norm, rcond=None)[0]
        ratio = np.exp(b[2]) / np.exp(x @ b) if log else b[2] / (x @ b)
        want = {(r[0], r[2]): v * q * (hi[r[0]] - lo[r[0]]) + lo[r[0]] for r, v, q in zip(rows, norm, ratio)}
        got = {(r.id, r.t): r.fluo_corr for r in stats.zt_correction(df, log).collect()}
        assert got == pytest.approx(want)


CONFIG = {
    "MotionModel": {
        "states": 6, "measurements": 3, "accuracy": 2.0, "prob_not_assign": 0.1, "max_lost": 2,
        "P": {"sigma": 10.0, "matrix": np.eye(6).ravel().tolist()}, "G": {"sigma": 0.1, "matrix": [0.5, 0.5, 0.5, 1, 1, 1]}, "R": {"sigma": 0.5, "matrix": np.eye(3).ravel().tolist()},
    },
    "HypothesisModel": {"hypotheses": ["P_link", "P_branch"], "dist_thresh": 6, "time_thresh": 4},
}


def moving(spark, rows):
    return spark.createDataFrame([(m, i, t, float(x), float(y), 0.0) for m, i, t, x, y in rows], "movie int, id long, t int, x double, y double, z double")


def test_motion_carries_tracks_past_each_other(spark):
    rows = [(0, 100 * k + t, t, 3 * t if k else 30 - 3 * t, k) for t in range(11) for k in (0, 1)]
    how = tracking.Tracker.of(CONFIG)
    got = {r.id: r.track for r in tracking.link_motion(moving(spark, rows), "movie", how).collect()}
    assert len({got[t] for t in range(11)}) == 1 == len({got[100 + t] for t in range(11)}) and got[0] != got[100]


def test_motion_gaps_divisions_and_lineage(spark):
    how = tracking.Tracker.of(CONFIG)
    assert how.max_lost == 2 and how.gap_dist == 6 and how.gap_time == 4 and how.divide
    rows = [(1, t, t, 0, 0) for t in range(4)] + [(1, 10 * t + k, t, 5.5 * (2 * k - 1) + (t - 4) * (2 * k - 1), 0) for t in range(4, 7) for k in (0, 1)]
    rows += [(2, t, t, t, 0) for t in (0, 1, 2, 5, 6)] + [(3, 0, 0, 0, 0), (3, 1, 4, 1, 0), (3, 2, 9, 1, 0)]
    p = moving(spark, rows).unionByName(spark.createDataFrame([(2, 99, None, 0.0, 0.0, 0.0), (2, 98, 1, None, 0.0, 0.0), (2, 97, 1, float("nan"), 0.0, 0.0)], "movie int, id long, t int, x double, y double, z double"))
    tracks = tracking.link_motion(p, "movie", how)
    got = {(r.movie, r.id): (r.track, r.parent) for r in tracks.collect()}
    assert got[1, 3] == (1, None) and {got[1, 60][1], got[1, 61][1]} == {1} and got[1, 60][0] != got[1, 61][0]
    assert {v for k, v in got.items() if k[0] == 2} == {(1, None)}  # lost for two frames
    assert got[3, 0] == got[3, 1] == (1, None) and got[3, 2] == (2, None)  # an end and a start four frames apart are joined, five are not
    assert {(r.track, r.first_t, r.last_t, r.n, r.parent) for r in tracking.lineage(tracks, "movie").where("movie = 1").collect()} == {(1, 0, 3, 4, None), (2, 4, 6, 3, 1), (3, 4, 6, 3, 1)}
    assert tracking.link_motion(p.limit(0), "movie", how).collect() == []


def test_motion_in_a_moving_frame_and_without_parameters(spark):
    rows = [(0, 10 * t + k, t, 500 * t + 5 * k, 0) for t in range(4) for k in (0, 1)]
    ref = spark.createDataFrame([(0, t, 500.0 * t, 0.0, 0.0) for t in range(4)], "movie int, t int, x double, y double, z double")
    got = {r.id: (r.track, r.x) for r in tracking.link_motion_registered(moving(spark, rows), ref, "movie", tracking.Tracker.of({})).collect()}
    assert len({v[0] for v in got.values()}) == 2 and got[0][0] == got[30][0] and got[31][1] == 1505.0


def test_direction_covariance(spark):
    rng = np.random.default_rng(2)
    at = rng.normal(size=(5, 4, 3))
    df = spark.createDataFrame([(i, 0, t, *map(float, at[i, t])) for i in range(5) for t in range(4) if (i, t) != (4, 2)], "id long, cell_id long, t int, x double, y double, z double")
    got = {r.t: r for r in stats.direction_covariance(spine.densify(df, "id", same=("cell_id",))).collect()}
    for t in range(3):
        steps = (at[:, t + 1] - at[:, t])[: 5 if t == 0 else 4]
        c = np.cov(steps.T)
        assert [got[t][k] for k in ("var_x", "var_y", "var_z", "cov_xy", "cov_xz", "cov_yz")] == pytest.approx([c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]])
        assert got[t].n == len(steps)
