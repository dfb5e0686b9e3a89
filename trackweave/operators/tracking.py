"""Linking by motion: a constant-velocity (or any linear) filter predicts each open track, beliefs assign the frame's points,
and ended tracks are joined over gaps or split into two. Parameters come from a tracker's JSON.

A movie is cut by time into blocks that are followed in parallel (`fragments`). A block first goes through some frames before its
own, so that it knows the open tracks; where these agree with those that the block before it ends with, their names are joined, and
where they do not, the block is followed again from the latter. Joins over gaps and divisions are chosen in rounds over the pairs
of ends and starts that cubes of space bring together. So no group holds more than a block, and the result is that of following
the whole movie at once (`link_whole`).

This is a documented substitute for an external Bayesian tracker; it claims no equality with one. What it keeps is the model:
matrices, assignment beliefs, search radius, gaps and divisions. `hypotheses` joins fragments by a global optimum instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .graphs import chosen, roots
from .spatial import radius_pairs, register


@dataclass(frozen=True)
class Tracker:
    """move (states x states) and see (measures x states) are the motion; spread is the first covariance, drift what a step
    adds to it, noise that of a measure. Beliefs are integrated within `accuracy` of a point; a point is taken if its belief
    exceeds `prob_not_assign` times that of a point exactly where it was predicted. Tracks end after max_lost frames without a
    point. Ends and starts at most gap_dist and gap_time frames apart are joined."""

    move: np.ndarray
    see: np.ndarray
    spread: np.ndarray
    drift: np.ndarray
    noise: np.ndarray
    accuracy: float = 7.5
    prob_not_assign: float = 0.1
    max_lost: int = 5
    reach: float = 100.0
    gap_dist: float = 40.0
    gap_time: int = 2
    divide: bool = True

    @classmethod
    def of(cls, config: dict, reach: float = 100.0) -> Tracker:
        """From the JSON that sources.readers.read_config returns. Missing parts keep their defaults; a matrix may have a
        sigma that scales it; drift is G'G. Divisions are sought if the hypotheses name P_branch."""
        m, h = config.get("MotionModel", {}), config.get("HypothesisModel", {})
        n, k = int(m.get("states", 6)), int(m.get("measurements", 3))
        still = np.eye(n) + np.eye(n, k=k)

        def matrix(name: str, shape: tuple[int, int], default: np.ndarray) -> np.ndarray:
            part = m.get(name)
            return default if part is None else np.asarray(part["matrix"], float).reshape(shape) * float(part.get("sigma", 1.0))

        g = matrix("G", (1, n), np.full((1, n), 1.0))
        return cls(
            matrix("A", (n, n), still), matrix("H", (k, n), np.eye(k, n)), matrix("P", (n, n), np.eye(n)), g.T @ g, matrix("R", (k, k), np.eye(k)),
            float(m.get("accuracy", 7.5)), float(m.get("prob_not_assign", 0.1)), int(m.get("max_lost", 5)), float(m.get("max_search_radius", reach)),
            float(h.get("dist_thresh", 40.0)), int(h.get("time_thresh", 2)), "P_branch" in h.get("hypotheses", ["P_branch"]),
        )


def belief(off: np.ndarray, sigma: np.ndarray, accuracy: float) -> np.ndarray:
    """Chance of a normal with `sigma` to fall within accuracy of `off`, over all axes (the last one)."""
    phi = lambda v: 0.5 * (1 + np.array([erf(x) for x in (v / sqrt(2)).ravel().tolist()]).reshape(v.shape))
    return np.prod(phi((off + accuracy) / sigma) - phi((off - accuracy) / sigma), axis=-1) if off.size else np.zeros(off.shape[:-1])


FEW_PAIRS = 4096  # so many are compared at once rather than by cubes


def near(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a and b closer than reach, by ascending a and b: cubes of that edge meet their neighbours only."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    if len(a) * len(b) <= FEW_PAIRS:
        return np.nonzero(np.linalg.norm(a[:, None] - b[None], axis=2) < reach)
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    cell_a, cell_b = (np.floor((p - low) / reach).astype(np.int64) + 1 for p in (a, b))
    step = np.concatenate(([1], np.cumprod(np.maximum(cell_a.max(axis=0), cell_b.max(axis=0))[:-1] + 2)))
    key_a, key_b = cell_a @ step, cell_b @ step
    order = np.argsort(key_b, kind="stable")
    key_b = key_b[order]
    found = []
    for off in np.ndindex(*[3] * a.shape[1]):
        at = key_a + (np.array(off) - 1) @ step
        first, n = np.searchsorted(key_b, at), np.searchsorted(key_b, at, "right")
        n = n - first
        i = np.repeat(np.arange(len(a)), n)
        j = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        close = np.linalg.norm(a[i] - b[j], axis=1) < reach
        found.append((i[close], j[close]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order]


def assign(seen: np.ndarray, sigma: np.ndarray, points: np.ndarray, how: Tracker) -> list[tuple[int, int]]:
    """(track, point) pairs by descending belief; ties go to the older track, then the earlier point."""
    i, j = near(seen, points, how.reach)
    b = belief(seen[i] - points[j], sigma[i], how.accuracy) / belief(np.zeros_like(sigma), sigma, how.accuracy)[i]
    good = b > how.prob_not_assign
    i, j, b = i[good], j[good], b[good]
    order = np.lexsort((j, i, -b))
    pairs, tracks, taken = [], set(), set()
    for track, point in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if track not in tracks and point not in taken:
            tracks.add(track)
            taken.add(point)
            pairs.append((track, point))
    return pairs


@dataclass(frozen=True)
class Open:
    """Tracks that may go on, older ones first, as they stand after frame `at`: names and last points (both the index of a point, or
    what the caller means by a number below 0), state, covariance, and frames since the last point."""

    at: int
    name: np.ndarray
    last: np.ndarray
    state: np.ndarray
    cov: np.ndarray
    lost: np.ndarray


def follow(times: np.ndarray, places: np.ndarray, how: Tracker, begin: int = 0, end: int | None = None, held: Open | None = None) -> tuple[np.ndarray, Open | None]:
    """Points begin..end, sorted by frame and id, from the open tracks `held` on: each one's track, named by the index of its first
    point, and the tracks that are open then."""
    end = len(times) if end is None else end
    if begin == end:
        return np.zeros(0, np.int64), held
    track = np.full(end - begin, -1)
    n = len(how.move)
    o = held or Open(int(times[begin]), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, n)), np.zeros((0, n, n)), np.zeros(0, np.int64))
    at, name, last, state, cov, lost = o.at, o.name, o.last, o.state, o.cov, o.lost
    edges = begin + np.concatenate(([0], np.flatnonzero(np.diff(times[begin:end])) + 1, [end - begin]))
    for first, stop in zip(edges, edges[1:], strict=False):
        gap = int(times[first]) - at
        for _ in range(min(gap, how.max_lost + 1)):
            state, cov = state @ how.move.T, how.move @ cov @ how.move.T + how.drift
        lost, at = lost + gap, int(times[first])
        keep = lost <= how.max_lost + 1
        state, cov, name, last, lost = state[keep], cov[keep], name[keep], last[keep], lost[keep]
        here = places[first:stop]
        s = how.see @ cov @ how.see.T + how.noise
        pairs = assign(state @ how.see.T, np.sqrt(np.diagonal(s, axis1=1, axis2=2)), here, how)
        own = np.full(stop - first, -1)
        new = np.ones(stop - first, bool)
        if pairs:
            i, j = np.array(pairs).T
            gain = cov[i] @ how.see.T @ np.linalg.inv(s[i])
            state[i] += np.einsum("nsm,nm->ns", gain, here[j] - state[i] @ how.see.T)
            cov[i] = cov[i] - gain @ how.see @ cov[i]
            lost[i] = 0
            last[i] = first + j
            own[j], new[j] = name[i], False
        new = np.flatnonzero(new)
        own[new] = first + new
        track[first - begin : stop - begin] = own
        state = np.concatenate([state, here[new] @ how.see])
        cov = np.concatenate([cov, np.repeat(how.spread[None], len(new), 0)])
        name, last = np.concatenate([name, first + new]), np.concatenate([last, first + new])
        lost = np.concatenate([lost, np.zeros(len(new), np.int64)])
    return track, Open(at, name, last, state, cov, lost)


def join_tracks(times: np.ndarray, places: np.ndarray, track: np.ndarray, how: Tracker) -> tuple[np.ndarray, dict[int, int]]:
    """Track numbers after ends and starts are joined, and the parent of each track that a division gave. An end with two
    starts in the next frame on opposite sides of it divides into the two nearest such; others are joined by ascending
    distance."""
    tracks, head = np.unique(track, return_index=True)
    tail = len(track) - 1 - np.unique(track[::-1], return_index=True)[1]
    gap = times[head][None] - times[tail][:, None]
    off = places[head][None] - places[tail][:, None]
    far = np.linalg.norm(off, axis=2)
    e, s = np.nonzero((gap > 0) & (gap <= how.gap_time) & (far < how.gap_dist))
    order = np.lexsort((s, e, far[e, s]))
    e, s = e[order], s[order]
    parent: dict[int, int] = {}
    ended: set[int] = set()
    begun: set[int] = set()
    if how.divide:
        found = []
        for end in np.unique(e):
            near = [b for b in s[e == end] if gap[end, b] == 1]
            sides = [(far[end, a] + far[end, b], a, b) for k, a in enumerate(near) for b in near[k + 1 :] if off[end, a] @ off[end, b] < 0]
            if sides:
                found.append((*min(sides), end))
        for _, a, b, end in sorted(found):
            if a not in begun and b not in begun:
                begun |= {a, b}
                ended.add(end)
                parent |= {int(tracks[a]): int(tracks[end]), int(tracks[b]): int(tracks[end])}
    into = {int(k): int(k) for k in tracks}
    for a, b in zip(e, s, strict=True):
        if a not in ended and b not in begun:
            ended.add(a)
            begun.add(b)
            into[int(tracks[b])] = int(tracks[a])

    def first(k: int) -> int:
        while into[k] != k:
            k = into[k]
        return k

    return np.array([first(int(k)) for k in track], np.int64), {k: first(v) for k, v in parent.items()}


def located(points: DataFrame, key: str, how: Tracker) -> DataFrame:
    """(key, id, t, x, y, z) of the points that have a movie, a frame and a place; what the tracker does not measure is 0."""
    known = points.where(" and ".join(f"{c} is not null" for c in (key, "id", "t", *"xyz"))).where(" and ".join(f"not isnan({c}) and abs({c}) < double('{inf}')" for c in "xyz"))
    return known.select(key, "id", "t", *[(F.col(c).cast("double") if k < len(how.see) else F.lit(0.0)).alias(c) for k, c in enumerate("xyz")])


def link_whole(points: DataFrame, key: str, how: Tracker) -> DataFrame:
    """link_motion with each movie as one group: for short movies, and to hold the blocks against."""
    kinds = dict(points.dtypes)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t", "ascending"), ("id", "ascending")])
        times = rows.column("t").to_numpy().astype(np.int64)
        places = np.stack([rows.column(c).to_numpy() for c in "xyz"], axis=1)[:, : len(how.see)]
        number = np.unique(follow(times, places, how)[0], return_inverse=True)[1]
        track, parent = join_tracks(times, places, number, how)
        order = {k: n + 1 for n, k in enumerate(dict.fromkeys(track.tolist()))}
        parents = [order.get(parent.get(k, -1)) for k in track.tolist()]
        return pa.table({key: rows.column(key), "id": rows.column("id"), "t": rows.column("t"), "track": pa.array([order[k] for k in track.tolist()], pa.int64()), "parent": pa.array(parents, pa.int64())})

    return located(points, key, how).groupBy(key).applyInArrow(run, f"{key} {kinds[key]}, id {kinds['id']}, t {kinds['t']}, track long, parent long")


POINT, BEFORE, AFTER = 0, 1, 2  # rows of a block: its points, the tracks open before its first frame and after its last


def follow_block(rows: pa.Table, key: str, length: int, how: Tracker) -> pa.Table:
    """Points of a block, with some of frames before it or with the tracks open before it -> its own points under their
    tracks' names, and the tracks open before and after it."""
    block, kind = rows.column("block")[0].as_py(), rows.column("kind").to_numpy()
    given, points = rows.filter(pa.array(kind == BEFORE)).sort_by("n"), rows.filter(pa.array(kind == POINT)).sort_by([("t", "ascending"), ("id", "ascending")])
    times = points.column("t").to_numpy().astype(np.int64)
    begin = int(np.searchsorted(times, block * length))
    if begin == len(times):
        return rows.slice(0, 0)
    places = np.stack([points.column(c).to_numpy() for c in "xyz"], axis=1)[:, : len(how.see)]
    held, m, n = None, len(given), len(how.move)
    if m:
        state, cov = (np.array(given.column(c).to_pylist(), float) for c in ("state", "cov"))
        below = -1 - np.arange(m)  # point -1 - k is the k-th given track's
        held = Open(given.column("at")[0].as_py(), below, below, state.reshape(m, n), cov.reshape(m, n, n), given.column("lost").to_numpy().astype(np.int64))
    before = follow(times, places, how, 0, begin, held)[1]
    track, after = follow(times, places, how, begin, None, before)

    head = np.concatenate([given.column("name").to_pylist(), [{"t": int(t), "id": i, "block": block, key: rows.column(key)[0].as_py()} for t, i in zip(times, points.column("id").to_pylist(), strict=True)]])
    at_t = np.concatenate([given.column("t").to_numpy(), points.column("t").to_numpy()])
    at_id = np.concatenate([np.array(given.column("id").to_pylist(), object), np.array(points.column("id").to_pylist(), object)])
    place_of = lambda k: np.where(k < 0, -1 - k, m + k)
    out = {c: [] for c in rows.column_names}

    def add(kind: int, name: np.ndarray, point: np.ndarray, **more) -> None:
        k = len(name)
        known = {key: [rows.column(key)[0].as_py()] * k, "block": [block] * k, "kind": [kind] * k, "name": head[place_of(name)].tolist(), "t": at_t[place_of(point)].tolist(), "id": at_id[place_of(point)].tolist(), **more}
        for c in out:
            out[c] += known.get(c, [None] * k)

    own = np.arange(begin, len(times))
    add(POINT, track, own, **{c: points.column(c).to_numpy()[begin:].tolist() for c in "xyz"})
    for kind, o in ((BEFORE, before), (AFTER, after)):
        if o is not None:
            live = o.lost + (int(times[begin]) - o.at if kind == BEFORE else 0) <= how.max_lost + 1
            add(kind, o.name[live], o.last[live], n=list(range(int(live.sum()))), at=[o.at] * int(live.sum()), lost=o.lost[live].tolist(), state=o.state[live].tolist(), cov=o.cov[live].reshape(-1, n * n).tolist())
    return pa.table({c: pa.array(v, rows.schema.field(c).type) for c, v in out.items()})


def fragments(points: DataFrame, key: str, how: Tracker, block: int = 50, overlap: int = 20, same: float = 1e-6) -> DataFrame:
    """(key, id, t, x, y, z, name): the track that each point is in before ends and starts are joined. name is a struct that tells
    tracks apart and sorts by first frame and id. Frames are cut into blocks of `block`, each warmed up by `overlap` frames before it;
    two blocks agree if the same tracks are open between them and numbers differ by at most `same`, relatively."""
    kinds = dict(points.dtypes)
    name = f"struct<t: {kinds['t']}, id: {kinds['id']}, block: long, {key}: {kinds[key]}>"
    schema = f"{key} {kinds[key]}, block long, kind int, id {kinds['id']}, t {kinds['t']}, x double, y double, z double, name {name}, n int, at long, lost long, state array<double>, cov array<double>"
    run = lambda rows: rows.groupBy(key, "block").applyInArrow(lambda table: follow_block(table, key, block, how), schema)
    own = materialise(located(points, key, how).withColumn("block", F.floor(F.col("t") / block).cast("long")), "motion-points")
    nothing = {c: F.lit(None).cast(k) for c, k in [("name", name), ("n", "int"), ("at", "long"), ("lost", "long"), ("state", "array<double>"), ("cov", "array<double>")]}
    as_points = lambda rows: rows.select(key, "block", F.lit(POINT).alias("kind"), "id", "t", *"xyz", *[v.alias(c) for c, v in nothing.items()])
    place = Window.partitionBy(key).orderBy("block")
    blocks = own.groupBy(key, "block").agg(F.min("t").alias("first_t")).select(key, "block", "first_t", F.lag("block").over(place).alias("before"))
    blocks = materialise(blocks, "motion-blocks")
    warm = own.withColumn("block", F.explode(F.sequence("block", F.floor((F.col("t") + overlap) / block).cast("long"))))
    parts = materialise(run(as_points(warm)), "motion")

    def handed(parts: DataFrame) -> DataFrame:
        """What each block gets from the one before it: that one's open tracks, without those that end before its first frame."""
        after = blocks.where("before is not null").join(parts.where(F.col("kind") == AFTER).withColumnRenamed("block", "before"), [key, "before"])
        return after.where(F.col("lost") + F.col("first_t") - F.col("at") <= how.max_lost + 1)

    number = F.row_number().over(Window.partitionBy(key, "block").orderBy("n"))
    while True:
        mine = parts.where(F.col("kind") == BEFORE).select(key, "block", number.alias("k"), F.struct("name", "id", "t", "lost", "state", "cov").alias("a"))
        theirs = handed(parts).select(key, "block", number.alias("k"), F.struct("name", "id", "t", "lost", "state", "cov").alias("b"))
        both = materialise(mine.join(theirs, [key, "block", "k"], "full"), "motion-seams")
        apart = lambda c: F.exists(F.zip_with(f"a.{c}", f"b.{c}", lambda x, y: F.abs(x - y) > same * (1 + F.abs(y))), lambda d: d)
        equal = F.expr("a.id = b.id and a.t = b.t and a.lost = b.lost") & ~apart("state") & ~apart("cov")
        wrong = materialise(both.where(~F.coalesce(equal, F.lit(False))).select(key, "block").distinct(), "motion-again")
        if wrong.isEmpty():
            break
        given = handed(parts).join(wrong, [key, "block"], "left_semi").select(key, "block", F.lit(BEFORE).alias("kind"), "id", "t", *"xyz", *nothing)
        again = run(as_points(own.join(wrong, [key, "block"], "left_semi")).unionByName(given))
        parts = materialise(parts.join(wrong, [key, "block"], "left_anti").unionByName(again), "motion")
    renamed = roots(both.where("a.name <> b.name").select(F.col("a.name").alias("child"), F.col("b.name").alias("parent")))
    found = parts.where(F.col("kind") == POINT).select(key, "id", "t", *"xyz", "name")
    return found.join(renamed.withColumnRenamed("child", "name"), "name", "left").select(key, "id", "t", *"xyz", F.coalesce("root", "name").alias("name"))


def summary(named: DataFrame, key: str) -> DataFrame:
    """(key, name, n, head, tail): one row a fragment; head and tail are structs t, x, y, z of its first and last point."""
    here = F.struct("t", *"xyz")
    return named.groupBy(key, "name").agg(F.count("*").alias("n"), F.min_by(here, "t").alias("head"), F.max_by(here, "t").alias("tail"))


def gaps(found: DataFrame, key: str, dist: float, time: int) -> DataFrame:
    """(e, s, d, dt, off): ends and starts of fragments (see `summary`) that a gap of 1..time frames and less than dist parts; off
    is the way from the one to the other. An end goes to the frames it may reach, so frames and cubes join by equality."""
    tails = found.select(key, F.col("name").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(time))).alias("dt"), "tail.*")
    tails = tails.select(key, F.struct("id", "dt", *"xyz").alias("id"), (F.col("t") + F.col("dt")).alias("t"), *"xyz")
    heads = found.select(key, F.struct("name", *[F.col(f"head.{c}").alias(c) for c in "xyz"]).alias("target_id"), "head.*")
    pairs = radius_pairs(tails, heads, dist, [key, "t"])
    off = F.array(*[F.col(f"target_id.{c}") - F.col(f"id.{c}") for c in "xyz"])
    return pairs.select(key, F.col("id.id").alias("e"), F.col("target_id.name").alias("s"), F.col("dist").alias("d"), F.col("id.dt").alias("dt"), off.alias("off"))


def opposite(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) < 0


def sisters(pairs: DataFrame) -> DataFrame:
    """(e, a, b, da, db): two starts in the frame after an end, on opposite sides of it, the nearer one first."""
    one = pairs.where("dt = 1")
    a, b = (one.select("e", F.struct("d", "s").alias(c), F.col("off").alias(f"off_{c}")) for c in "ab")
    both = a.join(b, "e").where((F.col("a") < F.col("b")) & opposite("off_a", "off_b"))
    return both.select("e", F.col("a.s").alias("a"), F.col("b.s").alias("b"), F.col("a.d").alias("da"), F.col("b.d").alias("db"))


def joined(pairs: DataFrame, divide: bool) -> tuple[DataFrame, DataFrame]:
    """(child, parent) of fragments that go on from others, and of those that divisions give. An end with starts on opposite
    sides divides into the nearest two; then ends and starts are joined by ascending distance."""
    if divide:
        best = F.min(F.struct((F.col("da") + F.col("db")).alias("sum"), "a", "b")).alias("best")
        found = sisters(pairs).groupBy("e").agg(best).select("e", "best.*").withColumn("sides", F.array("a", "b"))
        taken = materialise(chosen(found, [F.col(c) for c in ("sum", "a", "b", "e")], ["e"]), "divisions")
        split = taken.select(F.explode("sides").alias("child"), F.col("e").alias("parent"))
        pairs = pairs.join(split.select(F.col("parent").alias("e")), "e", "left_anti").join(split.select(F.col("child").alias("s")), "s", "left_anti")
    else:
        split = pairs.select(F.col("s").alias("child"), F.col("e").alias("parent")).limit(0)
    claims = pairs.withColumn("sides", F.array(F.struct(F.lit("end").alias("side"), F.col("e").alias("name")), F.struct(F.lit("start").alias("side"), F.col("s").alias("name"))))
    links = chosen(claims, [F.col(c) for c in ("d", "e", "s")], ["e", "s"])
    return links.select(F.col("s").alias("child"), F.col("e").alias("parent")), split


def numbered(named: DataFrame, key: str, links: DataFrame, split: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(key, id, t, track, parent, name): fragments under the numbers of their tracks, from 1 in each movie by first frame and id.
    Tracks are ranked within the block of their first frame; only the blocks' counts are summed in one place."""
    up = materialise(roots(links), "track-names")
    first = lambda c: F.coalesce("root", c)
    whole = materialise(named.join(up.withColumnRenamed("child", "name"), "name", "left").select(key, "id", "t", "name", first("name").alias("root")), "tracks")
    tracks = whole.select(key, "root").distinct().withColumn("_b", F.col("root.block"))
    base = tracks.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    base = base.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(key, "_b").orderBy("root")) + F.col("_base")
    tracks = materialise(tracks.join(base, [key, "_b"]).select("root", number.cast("long").alias("track")), "track-numbers")
    mother = split.join(up.select(F.col("child").alias("parent"), "root"), "parent", "left").select(F.col("child").alias("root"), first("parent").alias("_m"))
    mother = mother.join(tracks.select(F.col("root").alias("_m"), F.col("track").alias("parent")), "_m").select("root", "parent")
    rows = whole.join(tracks, "root").join(mother, "root", "left")
    return rows.select(key, F.col("id").cast(kinds["id"]), F.col("t").cast(kinds["t"]), "track", "parent", "name")


def link_motion(points: DataFrame, key: str, how: Tracker, block: int = 50, overlap: int = 20) -> DataFrame:
    """(key, id, t, track, parent): points (key, id, t, x, y, z, unique by key, id and t) in tracks from 1, numbered within
    each movie by first frame and id; parent is the track that divided into this one, else NULL. Points with a missing movie,
    id, place or frame have no track and go. Movies are independent, and so are blocks of frames: `block` and `overlap` change the
    work, not the tracks."""
    named = materialise(fragments(points, key, how, block, overlap), "fragments")
    pairs = materialise(gaps(summary(named, key), key, how.gap_dist, how.gap_time), "gaps")
    links, split = joined(pairs, how.divide)
    return numbered(named, key, links, split, dict(points.dtypes)).drop("name")


def lineage(tracks: DataFrame, key: str) -> DataFrame:
    """(key, track, first_t, last_t, n, parent): one row a track, the edges of the division graph."""
    return tracks.groupBy(key, "track").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), F.max("parent").alias("parent"))


def link_motion_registered(points: DataFrame, reference: DataFrame, key: str, how: Tracker) -> DataFrame:
    """link_motion in the frame of a moving reference (key, t, x, y, z), with the original places: (key, id, t, track, parent,
    x, y, z). Frames without a reference are left out."""
    fixed = register(points, reference, [key, "t"]).select(key, "t", "id", *[F.col(f"{c}_reg").alias(c) for c in "xyz"])
    return link_motion(fixed, key, how).join(points.select(key, "t", "id", *"xyz"), [key, "t", "id"])
