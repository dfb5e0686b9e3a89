"""Tracking by blocks of frames and by global hypotheses, against one-group forms and enumeration."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import graphs, tracking
from trackweave.operators import hypotheses as H
from trackweave.plans import fixtures as fx
from trackweave.plans.queries import tracker

from .test_queries import SF

MODEL = H.Model()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- graphs ----


def test_roots_and_components_against_loops(spark):
    rng = random.Random(4)
    parent = {k: rng.randrange(k) for k in range(1, 120) if rng.random() < 0.9} | {k: k - 1 for k in range(200, 260)}

    def up(k):
        return up(parent[k]) if k in parent else k

    edges = spark.createDataFrame(list(parent.items()), "child int, parent int")
    assert rows_of(graphs.roots(edges)) == sorted(((k, up(k)) for k in parent), key=repr)
    assert rows_of(graphs.roots(edges.limit(0))) == []
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    least = {x: x for e in links for x in e}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert rows_of(graphs.components(spark.createDataFrame(links, "u int, v int"))) == sorted(least.items(), key=repr)
    assert rows_of(graphs.components(spark.createDataFrame([], "u int, v int"))) == []


@pytest.mark.parametrize("seed", range(3))
def test_chosen_is_the_sequential_greedy_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(30) / 10, rng.sample(range(25), rng.choice([1, 2, 2, 3]))) for k in range(70)]
    used, want = set(), []
    for k, _, sides in sorted(rows, key=lambda r: (r[1], r[0])):
        if not used & set(sides):
            used |= set(sides)
            want.append(k)
    df = spark.createDataFrame(rows, "k int, d double, sides array<int>")
    assert sorted(r.k for r in graphs.chosen(df, [F.col("d"), F.col("k")], ["k"]).collect()) == sorted(want)


# ---- blocks of frames ----


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(3)
    for n, m, d in ((0, 5, 3), (40, 60, 3), (30, 30, 2), (1, 1, 3)):
        a, b = rng.normal(0, 20, (n, d)), rng.normal(0, 20, (m, d))
        i, j = tracking.near(a, b, 7.0)
        want = [(x, y) for x in range(n) for y in range(m) if np.linalg.norm(a[x] - b[y]) < 7]
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize(("block", "overlap"), [(50, 20), (10, 5), (7, 0), (3, 9), (1000, 0)])
def test_blocks_give_the_tracks_of_whole_movies(spark, block, overlap):
    points, how = fx.traj(spark, SF), tracker()
    want = rows_of(tracking.link_whole(points, "cell_id", how))
    assert rows_of(tracking.link_motion(points, "cell_id", how, block, overlap)) == want


def made_movie(seed=1, frames=60):
    """Cells that move smoothly, vanish for a while and divide."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    cells = [(rng.uniform(0, 300, 3), rng.normal(0, 2, 3), 0) for _ in range(8)]
    for t in range(frames):
        nxt = []
        for place, speed, wait in cells:
            if wait == 0:
                rows.append(("m", n, t, *map(float, place)))
                n += 1
            if rng.random() < 0.02 and len(cells) < 25:
                side = rng.normal(0, 1, 3)
                side *= 25 / np.linalg.norm(side)
                nxt += [(place + side, speed + side / 25, 0), (place - side, speed - side / 25, 0)]
            else:
                nxt.append((place + speed, speed + rng.normal(0, 0.2, 3), max(0, wait - 1) if wait else int(rng.random() < 0.02) * int(rng.integers(1, 9))))
        cells = nxt
    return rows


def test_blocks_of_a_movie_with_gaps_and_divisions(spark):
    points = spark.createDataFrame(made_movie(), "movie string, id int, t int, x double, y double, z double").repartition(5)
    how = tracker()
    want = rows_of(tracking.link_whole(points, "movie", how))
    assert len({r[3] for r in want}) > 15 and any(r[4] is not None for r in want)
    for block, overlap in ((10, 6), (4, 2), (25, 1)):
        assert rows_of(tracking.link_motion(points, "movie", how, block, overlap)) == want


def test_a_group_holds_no_more_than_a_block_and_its_overlap(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(set(), Sets())
    real = tracking.follow_block

    def seen(table, *a):
        t = [t for t, kind in zip(table.column("t").to_pylist(), table.column("kind").to_pylist(), strict=True) if kind == tracking.POINT]
        sizes.add({(min(t), max(t))})
        return real(table, *a)

    monkeypatch.setattr(tracking, "follow_block", seen)
    tracking.fragments(fx.traj(spark, SF), "cell_id", tracker(), 10, 5).count()
    assert len(sizes.value) >= 9 and max(b - a for a, b in sizes.value) < 15


def test_seams_that_disagree_are_followed_again(spark):
    """A track that is lost over a block's whole overlap is known to the block only from the one before it."""
    rows = [("m", 10 * t + k, t, 50.0 * k + 2 * t, 0.0, 0.0) for t in range(30) for k in (0, 1) if not (k == 1 and 7 <= t <= 10)]
    points = spark.createDataFrame(rows, "movie string, id int, t int, x double, y double, z double")
    how = tracker()
    want = rows_of(tracking.link_whole(points, "movie", how))
    assert len({r[3] for r in want}) == 2
    assert rows_of(tracking.link_motion(points, "movie", how, 10, 2)) == want


def test_tracks_of_odd_points(spark):
    rows = [("a", 1, 0, 0.0, 0.0, 0.0), ("a", 1, 1, 1.0, 0.0, 0.0), ("a", None, 2, 2.0, 0.0, 0.0), (None, 1, 0, 0.0, 0.0, 0.0), ("b", 5, -30, 0.0, 0.0, 0.0), ("b", 5, 400, 0.0, 0.0, 0.0), ("b", 6, 400, float("inf"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "movie string, id int, t int, x double, y double, z double").withColumns({"name": F.lit("own"), "block": F.lit(1.5)})
    assert rows_of(tracking.link_motion(points, "movie", tracker())) == [("a", 1, 0, 1, None), ("a", 1, 1, 1, None), ("b", 5, -30, 1, None), ("b", 5, 400, 2, None)]


# ---- hypotheses ----


def named_points(spark, runs, movie="m"):
    """runs: lists of (t, x, y, z), one fragment each; movie may also be a list of each one's movie."""
    movies = movie if isinstance(movie, list) else [movie] * len(runs)
    rows = [(movies[k], k, t, float(x), float(y), float(z), (run[0][0], k)) for k, run in enumerate(runs) for t, x, y, z in run]
    return spark.createDataFrame(rows, "movie string, id int, t int, x double, y double, z double, name struct<t: int, id: int>")


def all_covers(offers):
    """The greatest sum over all ways to explain every end and start once, from all offers, by enumeration."""
    claims = []
    for kind, name, to, score in offers:
        ends = {"P_FP": [("s", name), ("e", name)], "P_init": [("s", name)], "P_term": [("e", name)], "P_dead": [("e", name)]}.get(kind, [("e", name)] + [("s", c) for c in to])
        claims.append((frozenset(ends), score))
    todo = sorted({x for c, _ in claims for x in c})

    def go(open_):
        if not open_:
            return 0.0
        first = min(open_)
        return max((s + go(open_ - c) for c, s in claims if first in c and c <= open_), default=-math.inf)

    return go(frozenset(todo))


def made_fragments(seed):
    rng = random.Random(seed)
    return [[(t0 + t, rng.randrange(40), rng.randrange(40), rng.randrange(9)) for t in range(rng.randrange(1, 4))] for t0 in (rng.randrange(0, 5) for _ in range(rng.randrange(3, 10)))]


def offers_of(named, model):
    return [(r.movie, r.kind, tuple(r.name), tuple(tuple(c) for c in r.to), r.score) for r in H.offers_of(named, "movie", model).collect()]


@pytest.mark.parametrize("model", [MODEL, H.Model(relax=False, segmentation_miss_rate=0.0, theta_time=1.0, theta_dist=2.0), H.Model(lambda_dist=0.5, theta_time=2.0, apop_thresh=2, apoptosis_rate=0.3, eta=1e-6), H.Model(hypotheses=("P_FP", "P_init", "P_term", "P_link"))])
def test_optimum_equals_enumeration(spark, model):
    """40 movies of up to 9 fragments; enumeration takes all offers, also those that the operator leaves out as never better."""
    runs = {f"m{seed}": made_fragments(seed) for seed in range(40)}
    named = named_points(spark, [r for some in runs.values() for r in some], [m for m, some in runs.items() for _ in some])
    offers = offers_of(named, model)
    taken = H.optimum(H.offers_of(named, "movie", model)).collect()
    of = {(0, name): movie for movie, kind, name, *_ in offers if kind == "P_FP"}
    for m in runs:
        got = [r for r in taken if of[0, tuple(r.name)] == m]
        assert sum(r.score for r in got) == pytest.approx(all_covers([o[1:] for o in offers if o[0] == m]), abs=1e-6), m
        claimed = [("e", tuple(r.name)) for r in got if r.kind != "P_init"] + [("s", tuple(r.name)) for r in got if r.kind in ("P_init", "P_FP")] + [("s", tuple(c)) for r in got for c in r.to]
        assert len(claimed) == len(set(claimed)) == 2 * len(runs[m])
    assert all(r.proved for r in taken)
    kinds = {r.kind for r in taken}
    assert "P_link" in kinds and ("P_branch" in kinds or model.hypotheses[-1] == "P_link" or not model.relax)
    explained = H.explained(H.optimum(H.offers_of(named, "movie", model))).collect()
    assert len(explained) == len(of) and all(r.start_by and r.end_by and r.proved for r in explained)


def test_best_equals_enumeration_and_says_when_it_gave_up():
    rng = random.Random(8)
    for _ in range(300):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        end, begin = np.array([-rng.uniform(0, 25) for _ in range(n)]), np.array([-rng.uniform(0, 25) for _ in range(m)])
        claims = sorted({(rng.randrange(n), *sorted(rng.sample(range(m), 2))) if m > 1 and rng.random() < 0.5 else (rng.randrange(n), rng.randrange(m), -1) for _ in range(rng.randrange(0, 9))})
        claims = [(-rng.uniform(0, 9), *c) for c in claims]
        best = -math.inf
        for size in range(len(claims) + 1):
            for some in itertools.combinations(claims, size):
                ends, starts = [c[1] for c in some], [x for c in some for x in c[2:] if x >= 0]
                if len(set(ends)) == len(ends) and len(set(starts)) == len(starts):
                    best = max(best, sum(c[0] for c in some) + sum(e for k, e in enumerate(end) if k not in ends) + sum(b for k, b in enumerate(begin) if k not in starts))
        taken, proved = H.best(end, begin, claims)
        ends, starts = [claims[c][1] for c in taken], [x for c in taken for x in claims[c][2:] if x >= 0]
        value = sum(claims[c][0] for c in taken) + sum(e for k, e in enumerate(end) if k not in ends) + sum(b for k, b in enumerate(begin) if k not in starts)
        assert proved and value == pytest.approx(best, abs=1e-6) and len(set(starts)) == len(starts) and len(set(ends)) == len(ends)
    assert H.best(np.array([-1.0]), np.array([-1.0]), [(-0.5, 0, 0, -1)], nodes=0) == ([], False)
    assert H.best(np.array([-1.0]), np.array([-1.0, -2.0]), []) == ([], True)


def test_assignment_has_the_least_cost_and_its_prices_prove_it():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (6, 6), (5, 9)):
        cost = rng.uniform(-5, 5, (n, m))
        column, u, v = H.assignment(cost)
        assert cost[np.arange(n), column].sum() == pytest.approx(min(sum(cost[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(m), n)))
        assert (cost - u[:, None] - v[None] > -1e-9).all() and (v < 1e-12).all() and u.sum() + v.sum() == pytest.approx(cost[np.arange(n), column].sum())


def test_large_components_are_explained_without_one_task(spark):
    named = named_points(spark, made_fragments(2) + made_fragments(3))
    got = H.optimum(H.offers_of(named, "movie", MODEL), most=0).collect()
    claimed = [("e", r.name) for r in got if r.kind != "P_init"] + [("s", r.name) for r in got if r.kind in ("P_init", "P_FP")] + [("s", c) for r in got for c in r.to]
    assert len(claimed) == len(set(claimed)) == 2 * named.select("name").distinct().count()
    assert any(not r.proved for r in got) and sum(r.score for r in got) < 0


def test_matched_is_the_assignment_and_its_prices_prove_it():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 5), (6, 6), (9, 5), (20, 25)):
        i, j = np.nonzero(rng.random((n, m)) < 0.5)
        w = rng.uniform(-1, 5, len(i))
        cost = np.full((n, m + n), np.inf)
        cost[i, j], cost[np.arange(n), m + np.arange(n)] = -w, 0
        column, *_ = H.assignment(cost)
        by, due, price = H.matched(i, j, w, n, m)
        links = by[by >= 0]
        assert (i[links] == np.flatnonzero(by >= 0)).all() and len(set(j[links])) == len(links)
        assert w[links].sum() == pytest.approx(-cost[np.arange(n), column].sum()) == pytest.approx(due.sum() + price.sum())
        assert (due[i] + price[j] > w - 1e-9).all() and (due > -1e-9).all() and (price > -1e-9).all()


def test_the_optimum_does_not_depend_on_the_size_of_a_component(spark):
    """A chain of 2,200 ends and starts in which taking the best link first leaves one end and one start over."""
    n = 1100
    links = [("P_link", (0, k), [(1, x)], s) for k in range(n) for x, s in ((k, -3.0), (k + 1, -2.999)) if x < n]
    alone = [(kind, (t, k), [], -10.0) for t in (0, 1) for k in range(n) for kind in ("P_init", "P_term")]
    offers = spark.createDataFrame(links + alone, "kind string, name struct<t: int, id: int>, to array<struct<t: int, id: int>>, score double")
    got = H.optimum(offers).collect()
    assert {(r.name.id, r.to[0].id) for r in got if r.kind == "P_link"} == {(k, k) for k in range(n)} and len(got) == 3 * n
    assert all(r.proved for r in got) and sum(r.score for r in got) == pytest.approx(-23.0 * n)


def test_best_of_many_parts_is_proved_part_by_part():
    """80 copies of a part where divisions claim each other's starts: together they would take more steps than there are."""
    end, begin, claims = [], [], []
    for c in range(80):
        e, s = len(end), len(begin)
        end += [-4.0] * 4
        begin += [-9.0] * 6
        claims += [(-1.0 - 0.1 * ((c + x) % 5), e + x % 4, *sorted((s + x % 6, s + (x + y) % 6))) for x in range(4) for y in (1, 2, 3)]
        claims += [(-2.0, e + x, s + x, -1) for x in range(4)]
    taken, proved = H.best(np.array(end), np.array(begin), claims, nodes=60)
    assert proved
    for c in range(80):
        mine = [x for x in range(len(claims)) if claims[x][1] // 4 == c]
        best = -math.inf
        for size in range(5):
            for some in itertools.combinations(mine, size):
                ends, starts = [claims[x][1] for x in some], [b for x in some for b in claims[x][2:] if b >= 0]
                if len(set(ends)) == len(ends) and len(set(starts)) == len(starts):
                    best = max(best, sum(claims[x][0] for x in some) - 4.0 * (4 - len(ends)) - 9.0 * (6 - len(starts)))
        some = [x for x in taken if x in mine]
        starts = [b for x in some for b in claims[x][2:] if b >= 0]
        assert sum(claims[x][0] for x in some) - 4.0 * (4 - len(some)) - 9.0 * (6 - len(starts)) == pytest.approx(best)


def test_optimum_closes_gaps_divides_and_drops_false_detections(spark):
    line = lambda a, b: [(t, 600.0 + t, 150.0, 25.0) for t in range(a, b)]
    mother = [(t, 100.0, 100.0, 25.0) for t in range(0, 12)]
    first, second = ([(t, 100.0 + s * (5 + t - 12), 100.0, 25.0) for t in range(12, 40)] for s in (-1, 1))
    noise = [[(20, 400.0, 150.0, 25.0)]]
    runs = [line(0, 15), line(16, 40), mother, first, second, *noise, [(t, 900.0 * (t % 2), 300.0 * (t % 2), 25.0) for t in range(40)]]
    got = {tuple(r.name)[1]: r for r in H.explained(H.optimum(H.offers_of(named_points(spark, runs), "movie", H.Model(dist_thresh=60.0)))).collect()}
    assert got[0].end_by == "P_link" and [tuple(c)[1] for c in got[0].to] == [1] and got[1].start_by == "P_link"
    assert got[2].end_by == "P_branch" and {tuple(c)[1] for c in got[2].to} == {3, 4} and got[3].start_by == got[4].start_by == "P_branch"
    assert got[5].start_by == got[5].end_by == "P_FP" and got[6].start_by == "P_init" and got[6].end_by == "P_term"


def test_link_optimum_names_tracks_and_parents(spark):
    points = spark.createDataFrame(made_movie(), "movie string, id int, t int, x double, y double, z double")
    got = H.link_optimum(points, "movie", tracker(), MODEL, block=20, overlap=10).collect()
    assert len(got) == points.count() and {r.track for r in got} == set(range(1, len({r.track for r in got}) + 1))
    first = {}
    for r in sorted(got, key=lambda r: (r.t, r.id)):
        first.setdefault(r.track, (r.t, r.id))
    assert [first[k] for k in sorted(first)] == sorted(first.values())
    last = {k: max(r.t for r in got if r.track == k) for k in first}
    assert all(last[r.parent] < first[r.track][0] for r in got if r.parent is not None) and any(r.parent is not None for r in got)


def test_model_from_a_config():
    m = H.Model.of({"HypothesisModel": {"hypotheses": ["P_FP", "P_init", "P_term", "P_link"], "lambda_link": 5.0, "relax": False, "name": "x"}})
    assert m.hypotheses == ("P_FP", "P_init", "P_term", "P_link") and m.lambda_link == 5.0 and not m.relax and m.theta_time == 5.0 and H.Model.of({}) == H.Model()


from pyspark.accumulators import AccumulatorParam  # noqa: E402


class Sets(AccumulatorParam):
    def zero(self, value):
        return set()

    def addInPlace(self, a, b):
        return a | b


def test_rounds_over_graphs_broadcast_nothing(spark, monkeypatch):
    """A broadcast goes through the driver, so a round must not make any, however small its tables are."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    materialise = graphs.materialise
    monkeypatch.setattr(graphs, "materialise", written)
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "u int, v int")
    assert {r.root for r in graphs.components(edges).collect()} == {0}
    assert graphs.roots(edges.toDF("parent", "child")).where("root = 0").count() == 9
    assert {r.u for r in graphs.chosen(edges.withColumn("sides", F.array("u", "v")), [F.col("u")], ["u"]).collect()} == {0, 2, 4, 6, 8}
    assert {r.node for r in graphs.first_of_neighbours(edges.select(F.col("u").alias("node")), [F.col("node")], edges.toDF("a", "b").where("b < 9")).collect()} == {0, 2, 4, 6, 8}
    assert len(plans) > 20 and not any("Broadcast" in p for p in plans)


def test_few_pairs_are_those_of_cubes(monkeypatch):
    rng = np.random.default_rng(3)
    assert tracking.FEW_PAIRS >= 30 * 40
    for reach in (1.0, 4.0, 100.0):
        a, b = rng.integers(0, 12, (30, 3)).astype(float), rng.integers(0, 12, (40, 3)).astype(float)
        whole = tracking.near(a, b, reach)
        monkeypatch.setattr(tracking, "FEW_PAIRS", 0)
        cubes = tracking.near(a, b, reach)
        monkeypatch.undo()
        assert all(np.array_equal(x, y) for x, y in zip(whole, cubes, strict=True)) and len(whole[0])
