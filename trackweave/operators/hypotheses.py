"""Joining fragments of tracks by a global optimum: every end and every start is explained once, and the explanations' log-likelihoods
have the greatest sum.

A fragment's start is explained by P_init (it begins there) or by what goes on into it, its end by P_term (it leaves), P_dead (it
dies), P_link (it goes on as one later start) or P_branch (it divides into two starts of the next frame on opposite sides of it);
P_FP explains both at once as a false detection. With alpha the miss rate and n a fragment's points, a fragment is false with
probability alpha^n, and each explanation of a true one's end or start has half of ln(1 - alpha^n) on top:

  P_FP      n ln alpha
  P_init    ln max(exp(-frames since the movie's first / lambda_time) below theta_time, exp(-distance from the border /
            lambda_dist) below theta_dist, eta); without `relax` only where one of the first two is in reach
  P_term    the same with the frames until the movie's last, at the fragment's end
  P_dead    ln apoptosis_rate, for fragments of apop_thresh points or more
  P_link    -distance x frames / lambda_link, closer than dist_thresh, at most time_thresh frames apart
  P_branch  -mean distance of the two / lambda_branch, both closer than dist_thresh

No probability counts as less than eta. What cannot be better than others that explain the same goes (`kept`); the rest falls
apart into connected components, which are local in time and space, and tasks solve components of any size the same way (`best`):
an assignment without divisions gives prices; what no change can make better under these is left (`moats`), and divisions are
branched on in the parts that remain. `proved` is false where `nodes` steps did not settle such a part. A component is one task's,
in memory that grows with its offers.
"""

from __future__ import annotations

import heapq
import sys
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .graphs import chosen, components
from .tracking import Tracker, fragments, gaps, numbered, sisters, summary

MISSING = 1e7  # what it costs to leave an end or a start without an explanation, where none stands alone


@dataclass(frozen=True)
class Model:
    """The defaults are those of a dividing cell's tracker."""

    hypotheses: tuple[str, ...] = ("P_FP", "P_init", "P_term", "P_link", "P_branch", "P_dead")
    lambda_time: float = 5.0
    lambda_dist: float = 3.0
    lambda_link: float = 10.0
    lambda_branch: float = 50.0
    eta: float = 1e-10
    theta_dist: float = 20.0
    theta_time: float = 5.0
    dist_thresh: float = 40.0
    time_thresh: int = 2
    apop_thresh: int = 5
    segmentation_miss_rate: float = 0.1
    apoptosis_rate: float = 0.001
    relax: bool = True

    @classmethod
    def of(cls, config: dict) -> Model:
        """From the JSON that sources.readers.read_config returns; what it lacks keeps its default."""
        h = config.get("HypothesisModel", {})
        given = {f.name: h[f.name] for f in fields(cls) if f.name in h}
        return cls(**given | ({"hypotheses": tuple(given["hypotheses"])} if "hypotheses" in given else {}))


def extent(named: DataFrame, key: str) -> DataFrame:
    """(key, first_t, last_t, lo, hi): the frames and the box of a movie's points."""
    box = lambda f: F.struct(*[f(c).alias(c) for c in "xyz"])
    return named.groupBy(key).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), box(F.min).alias("lo"), box(F.max).alias("hi"))


def border(place: str) -> Column:
    """Distance to the nearest side of the box; axes along which the box is flat have no sides, and 0 is the answer if all are."""
    sides = [F.when(F.col(f"hi.{c}") > F.col(f"lo.{c}"), F.least(F.col(f"{place}.{c}") - F.col(f"lo.{c}"), F.col(f"hi.{c}") - F.col(f"{place}.{c}"))) for c in "xyz"]
    return F.coalesce(F.least(*sides), F.lit(0.0))


def scored(found: DataFrame, box: DataFrame, pairs: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, kind, name, to, score): all that the model offers. found is tracking.summary, box is extent, pairs is tracking.gaps
    within the model's reach; to lists the fragments that P_link and P_branch go on into."""
    eta, none = F.lit(model.eta), found.select(F.array("name").alias("a")).schema["a"].dataType
    half = 0.5 * F.log(F.greatest(1 - F.pow(F.lit(float(model.segmentation_miss_rate)), F.col("n")), eta))

    def edge(frames: Column, place: str) -> tuple[Column, Column]:
        in_time, in_space = frames < model.theta_time, border(place) < model.theta_dist
        p = F.greatest(F.when(in_time, F.exp(-frames / model.lambda_time)), F.when(in_space, F.exp(-border(place) / model.lambda_dist)), eta)
        return F.log(p) + half, F.lit(model.relax) | in_time | in_space

    rows = found.join(box, key)
    begin, end = edge(F.col("head.t") - F.col("first_t"), "head"), edge(F.col("last_t") - F.col("tail.t"), "tail")
    offers = {
        "P_FP": (F.col("n") * F.log(F.greatest(F.lit(float(model.segmentation_miss_rate)), eta)), F.lit(True)),
        "P_init": begin, "P_term": end, "P_dead": (F.log(F.greatest(F.lit(float(model.apoptosis_rate)), eta)) + half, F.col("n") >= model.apop_thresh),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("score"), ok.alias("ok")) for k, (s, ok) in offers.items() if k in model.hypotheses])
    alone = rows.select(key, "name", F.explode(each).alias("o")).where("o.ok")
    out = alone.select(key, "o.kind", "name", F.array().cast(none).alias("to"), "o.score")
    halves = found.select("name", half.alias("half"))
    of = lambda c: halves.select(F.col("name").alias(c), F.col("half").alias(f"half_{c}"))
    movie = found.select(key, F.col("name").alias("e"))
    if "P_link" in model.hypotheses:
        score = -F.col("d") * F.col("dt") / model.lambda_link + F.col("half_e") + F.col("half_s")
        links = pairs.join(of("e"), "e").join(of("s"), "s")
        out = out.unionByName(links.select(key, F.lit("P_link").alias("kind"), F.col("e").alias("name"), F.array("s").alias("to"), score.alias("score")))
    if "P_branch" in model.hypotheses:
        score = -(F.col("da") + F.col("db")) / (2 * model.lambda_branch) + F.col("half_e") + F.col("half_a") + F.col("half_b")
        both = sisters(pairs).join(of("e"), "e").join(of("a"), "a").join(of("b"), "b").join(movie, "e")
        out = out.unionByName(both.select(key, F.lit("P_branch").alias("kind"), F.col("e").alias("name"), F.array("a", "b").alias("to"), score.alias("score")))
    return out


def alternatives(offers: DataFrame) -> DataFrame:
    """(name, begin, end, end_kind): the best that explains a fragment's start, and its end, on its own; NULL where nothing does."""
    end = F.max(F.when(F.col("kind").isin("P_term", "P_dead"), F.struct("score", "kind"))).alias("_e")
    return offers.groupBy("name").agg(F.max(F.when(F.col("kind") == "P_init", F.col("score"))).alias("begin"), end).select("name", "begin", F.col("_e.score").alias("end"), F.col("_e.kind").alias("end_kind"))


def kept(offers: DataFrame, alone: DataFrame) -> DataFrame:
    """(kind, name, to, score, gain): links, divisions and false detections that are better than all that could stand in their
    place; gain is how much they beat what explains each of their ends and starts on its own."""
    at = lambda side, c: alone.select(F.col("name").alias(c), F.col(side).alias(f"{side}_{c}"))
    gain = lambda *sides: F.col("score") - sum((F.coalesce(s, F.lit(-MISSING)) for s in sides), F.lit(0.0))
    false = offers.where("kind = 'P_FP'").join(alone, "name").select("kind", "name", "to", "score", gain(F.col("begin"), F.col("end")).alias("gain"))
    links = offers.where("kind = 'P_link'").select("kind", F.col("name").alias("e"), F.col("to")[0].alias("s"), "to", "score").join(at("end", "e"), "e").join(at("begin", "s"), "s")
    links = links.select("kind", F.col("e").alias("name"), "to", "score", gain(F.col("end_e"), F.col("begin_s")).alias("gain")).where("gain > 0")
    split = offers.where("kind = 'P_branch'").select("kind", F.col("name").alias("e"), F.col("to")[0].alias("a"), F.col("to")[1].alias("b"), "to", "score")
    split = split.join(at("end", "e"), "e").join(at("begin", "a"), "a").join(at("begin", "b"), "b")
    split = split.select("kind", F.col("e").alias("name"), "to", "score", gain(F.col("end_e"), F.col("begin_a"), F.col("begin_b")).alias("gain"), "a", "b")
    one = lambda c: links.select("name", F.col("to")[0].alias(c), F.col("gain").alias(f"link_{c}"))  # noqa: E731  a link to one of the two, the other begins
    split = split.join(one("a"), ["name", "a"], "left").join(one("b"), ["name", "b"], "left").where("gain > greatest(0, coalesce(link_a, 0), coalesce(link_b, 0))")
    return false.where("gain > 0").unionByName(links).unionByName(split.select("kind", "name", "to", "score", "gain"))


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column of each row in the assignment of least cost (rows <= columns, each row has a finite one), and prices u, v
    with u[i] + v[j] <= cost[i, j], equal where assigned, v <= 0, and 0 where free. Shortest augmenting paths over a whole matrix, to
    hold `matched` against."""
    n, m = cost.shape
    u, v, row_of, way = np.zeros(n), np.zeros(m), np.full(m, -1), np.zeros(m, int)
    for i in range(n):
        least, seen, at, row = np.full(m, np.inf), np.zeros(m, bool), -1, i
        while True:
            here = cost[row] - u[row] - v
            better = ~seen & (here < least)
            least[better], way[better] = here[better], at
            nxt = int(np.argmin(np.where(seen, np.inf, least)))
            step = least[nxt]
            u[i] += step
            u[row_of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            seen[nxt], at, row = True, nxt, row_of[nxt]
            if row < 0:
                break
        while at >= 0:
            before = way[at]
            row_of[at] = i if before < 0 else row_of[before]
            at = before
    column = np.full(n, -1)
    column[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return column, u, v


def matched(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`assignment` for links (i, j) that gain w over ends and starts on their own, of n ends and m starts: the link of each end or
    -1, and prices due and price, none below 0, with due[i] + price[j] >= w, equal where linked, and 0 where not. Searches stay
    among the links near an end, so memory grows with the links alone."""
    order = np.argsort(i, kind="stable")
    cut, link, to, worth = np.searchsorted(i[order], np.arange(n + 1)).tolist(), order.tolist(), j[order].tolist(), w[order].tolist()
    top = np.zeros(n)
    np.maximum.at(top, i, w)
    due, price, by, row_of = top.tolist(), [0.0] * m, [-1] * n, [-1] * m
    for source in range(n):
        reach: dict[int, float] = {}
        way: dict[int, tuple[int, int]] = {}
        done: dict[int, float] = {}
        rows, heap, row, here = [(source, 0.0)], [], source, 0.0
        least, last = due[source], (source, -1)
        while True:
            if here + due[row] < least:
                least, last = here + due[row], (row, -1)  # it stays on its own
            for x in range(cut[row], cut[row + 1]):
                c = to[x]
                d = here + due[row] + price[c] - worth[x]
                if c not in done and d < least and d < reach.get(c, np.inf):
                    reach[c], way[c] = d, (row, x)
                    if row_of[c] < 0:
                        least, last = d, (row, x)
                    else:
                        heapq.heappush(heap, (d, c))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            here, c = heapq.heappop(heap)
            done[c], row = here, row_of[c]
            rows.append((row, here))
        for r, d in rows:
            due[r] -= least - d
        for c, d in done.items():
            price[c] += least - d
        row, x = last
        while True:
            before, by[row] = by[row], x
            if x >= 0:
                row_of[to[x]] = row
            if row == source:
                break
            row, x = way[to[before]]
    return np.array([link[x] if x >= 0 else -1 for x in by], int), np.array(due), np.array(price)


def apart(sides: list[list[int]]) -> list[list[int]]:
    """Numbers of claims by connected component; a claim is the list of what it explains."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for some in sides:
        for x in some[1:]:
            root[find(x)] = find(some[0])
    out: dict[int, list[int]] = {}
    for c, some in enumerate(sides):
        out.setdefault(find(some[0]), []).append(c)
    return list(out.values())


def moats(sides: list[list[int]], slack: list[float], taken: set[int], loss: dict[int, float]) -> list[set[int]]:
    """Sets of ends and starts apart from each other such that only changes within one of them can make a solution better.

    Under prices every solution loses, against their bound, the slack of its claims and the price of what it leaves alone, none of
    which is below 0. Where a better solution differs, connected parts differ for themselves, and a part must add claims of less
    slack than it saves of the loss that is there (`loss`, by place). So a loss reaches no further than itself by paths that cost the
    slack of claims not taken, and losses whose reaches meet, or which a claim between them costs less than what they have left
    there, are one and reach as far as their sum."""
    of: dict[int, list[int]] = {}
    for c, some in enumerate(sides):
        for x in some:
            of.setdefault(x, []).append(c)
    root = {x: x for x in loss}
    seeds, budget, ball = {x: [x] for x in loss}, dict(loss), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def spread(g: int) -> dict[int, float]:
        at, heap, done = {x: 0.0 for x in seeds[g]}, [(0.0, x) for x in seeds[g]], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for c in of.get(x, ()):
                e = d if c in taken else d + max(slack[c], 0.0)
                if e < budget[g]:
                    for y in sides[c]:
                        if e < at.get(y, np.inf):
                            at[y] = e
                            heapq.heappush(heap, (e, y))
        return {x: budget[g] - d for x, d in at.items()}  # what is left there

    changed = set(seeds)
    while changed:
        for g in changed:
            ball[g] = spread(g)
        left: dict[int, dict[int, float]] = {}
        for g, some in ball.items():
            for x, rest in some.items():
                left.setdefault(x, {})[g] = rest
        meet = [list(some) for some in left.values() if len(some) > 1]
        for c in {c for x in left for c in of.get(x, ())}:
            most: dict[int, float] = {}
            for x in sides[c]:
                for g, rest in left.get(x, {}).items():
                    most[g] = max(rest, most.get(g, 0.0))
            if len(most) > 1 and (c in taken or sum(most.values()) > slack[c] - 1e-9):
                meet.append(list(most))
        changed = set()
        for some in meet:
            for g in some[1:]:
                a, b = find(some[0]), find(g)
                if a != b:
                    root[b] = a
                    seeds[a] += seeds.pop(b)
                    budget[a] += budget.pop(b)
                    ball.pop(b)
                    changed = (changed | {a}) - {b}
    return [set(some) for some in ball.values()]


def packed(i: np.ndarray, j: np.ndarray, k: np.ndarray, w: np.ndarray, left: list[int], floor: float = -np.inf, branched: bool = False) -> tuple[float, list[int], bool]:
    """The greatest sum of w over claims that share no end and no start, the claims, and whether that is proved; nothing at or below
    `floor` is looked for. left[0] is how many more steps may be taken; parts that are apart have each as many."""
    nodes = left[0]
    whole, parts = np.arange(len(w)), apart([[2 * a, 2 * b + 1] + ([2 * c + 1] if c >= 0 else []) for a, b, c in zip(i.tolist(), j.tolist(), k.tolist(), strict=True)])
    if len(parts) != 1:
        found = [(np.array(p), packed(i[p], j[p], k[p], w[p], left if branched else [nodes], branched=branched)) for p in parts]
        return sum(f[0] for _, f in found), [int(p[c]) for p, f in found for c in f[1]], all(f[2] for _, f in found)
    single = k < 0
    i = np.unique(i, return_inverse=True)[1]
    names = np.unique(np.concatenate([j, k[~single]]))
    j, k = np.searchsorted(names, j), np.where(single, -1, np.searchsorted(names, k))
    n, m = int(i.max()) + 1, len(names)
    top: list = [0.0, []]

    def offer(taken: list[int]) -> None:
        value = float(w[taken].sum())
        if value > top[0] + 1e-9:
            top[:] = [value, taken]

    def round_up(r: np.ndarray) -> None:
        """Claims by descending r, each if its end and starts are free: a solution to hold bounds against."""
        free_r, free_c, more = [True] * n, [True] * m, []
        for c in np.argsort(-r, kind="stable").tolist():
            a, b, d = int(i[c]), int(j[c]), int(k[c])
            if free_r[a] and free_c[b] and (d < 0 or free_c[d]):
                more.append(c)
                free_r[a] = free_c[b] = False
                if d >= 0:
                    free_c[d] = False
        offer(more)

    round_up(w)
    if left[0] <= 0:
        return *top, False
    left[0] -= 1
    links = np.flatnonzero(single)
    by, _, price = matched(i[links], j[links], w[links], n, m)
    offer(links[by[by >= 0]].tolist())
    low, held, turns = np.inf, (price, price), 80
    for turn in range(turns):  # prices of starts moved by subgradients; without divisions those of the links prove it at once
        r = w - price[j] - np.where(single, 0, price[k])
        due = np.zeros(n)
        np.maximum.at(due, i, r)
        value = price.sum() + due.sum()
        if value < low:
            low, held = value, (price, due)
        if low > top[0] + 1e-9 and (turn % 20 == 0 or turn == turns - 1):
            round_up(r)
        if low <= max(top[0], floor) + 1e-9:
            return *top, True
        pick = (r == due[i]) & (r > 0)
        used = np.bincount(j[pick], minlength=m) + np.bincount(k[pick & ~single], minlength=m)
        slope = np.where((price <= 0) & (used == 0), 0, 1 - used)
        size = float(slope @ slope)
        if not size:
            break
        price = np.maximum(0, price - (value - top[0]) / (1 + turn / 10) / size * slope)
    price, due = held
    slack = due[i] + price[j] + np.where(single, 0, price[k]) - w
    alive = low - slack > max(top[0], floor) + 1e-9  # a claim that falls short by more is in nothing better

    taken = set(top[1])
    sides = [[a, n + b] + ([n + c] if c >= 0 else []) for a, b, c in zip(i.tolist(), j.tolist(), k.tolist(), strict=True)]
    loss = {x: float(p) for x, p in enumerate(np.concatenate([due, price])) if p > 1e-9}
    for c in taken:
        for x in sides[c]:
            loss.pop(x, None)
        if slack[c] > 1e-9:
            loss[sides[c][0]] = float(slack[c])
    within = moats(sides, slack.tolist(), taken, loss)
    place = {x: g for g, some in enumerate(within) for x in some}
    group = [place.get(some[0], -1) if len({place.get(x, -1) for x in some}) == 1 else -1 for some in sides]
    own = np.where(alive | np.isin(whole, top[1]), group, -1)
    if (own < 0).any() or len(within) > 1:
        sure = True
        for g in range(len(within)):
            p = whole[own == g]
            mine = [c for c in top[1] if own[c] == g]
            value, more, proved = packed(i[p], j[p], k[p], w[p], left if branched else [nodes], float(w[mine].sum()), branched)
            sure &= proved
            if value > w[mine].sum() + 1e-9:
                offer([c for c in top[1] if own[c] != g] + p[more].tolist())
        return *top, sure
    split = np.flatnonzero(~single)
    b = int(split[np.argmin(slack[split])])
    free = whole[(i != i[b]) & ~np.isin(j, [j[b], k[b]]) & (single | ~np.isin(k, [j[b], k[b]]))]
    value, more, proved = packed(i[free], j[free], k[free], w[free], left, max(top[0], floor) - w[b], True)
    offer([b, *free[more].tolist()])
    rest = whole[whole != b]
    value, more, sure = packed(i[rest], j[rest], k[rest], w[rest], left, max(top[0], floor), True)
    offer(rest[more].tolist())
    return *top, sure and proved


def best(end: np.ndarray, begin: np.ndarray, claims: list[tuple[float, int, int, int]], nodes: int = 500) -> tuple[list[int], bool]:
    """The claims taken when all ends and starts are explained once at the greatest sum, and whether that is proved. end[i] and
    begin[j] are the scores of an end and a start on their own; a claim (score, i, j, k) explains end i and start j, and
    start k as well if k >= 0. Claims that are not taken leave their ends and starts on their own."""
    if not claims or nodes <= 0:
        return [], not claims
    score, i, j, k = (np.array(c) for c in zip(*claims, strict=True))
    w = score - end[i] - begin[j] - np.where(k >= 0, begin[k], 0)
    good = np.flatnonzero(w > 0)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000 + 4 * nodes))  # every step is a call or two
    _, taken, proved = packed(i[good], j[good], k[good], w[good], [nodes])
    return sorted(good[taken].tolist()), proved


def solve(rows: pa.Table, nodes: int) -> pa.Table:
    """A component's claims, with what explains each end and start on its own -> the claims taken and whether that is proved."""
    kind, score = rows.column("kind").to_pylist(), rows.column("score").to_pylist()
    parts = [[(p["side"], tuple(p["name"].values())) for p in x] for x in rows.column("sides").to_pylist()]
    alone = {p[0]: s for k, s, p in zip(kind, score, parts, strict=True) if k == "alone"}
    ends, begins = (sorted(p for p in alone if p[0] == side) for side in ("end", "start"))
    place = {p: a for some in (ends, begins) for a, p in enumerate(some)}
    at = sorted((p, a) for a, (k, p) in enumerate(zip(kind, parts, strict=True)) if k != "alone")  # whatever the order of the rows
    claims = []
    for p, a in at:
        e, *s = sorted(p, key=lambda x: x[0])  # the end first
        claims.append((score[a], place[e], place[s[0]], place[s[1]] if len(s) > 1 else -1))
    taken, proved = best(np.array([alone[p] for p in ends]), np.array([alone[p] for p in begins]), claims, nodes)
    out = rows.take(pa.array([at[c][1] for c in taken], pa.int64())).select(["kind", "name", "to", "score"])
    return out.append_column("proved", pa.array([proved] * len(out), pa.bool_()))


def optimum(offers: DataFrame, most: int | None = None, nodes: int = 500) -> DataFrame:
    """(kind, name, to, score, proved): of all offers those that explain every end and start once. Components of all sizes are solved
    the same way; only where `most` is given, those of more ends and starts are explained by descending gain, which is not the
    optimum."""
    offers = materialise(offers, "hypotheses")
    alone = materialise(alternatives(offers), "alternatives")
    side = lambda s, c: F.struct(F.lit(s).alias("side"), c.alias("name"))
    sides = F.when(F.col("kind") == "P_FP", F.array(side("end", F.col("name")), side("start", F.col("name"))))
    sides = sides.otherwise(F.concat(F.array(side("end", F.col("name"))), F.transform("to", lambda c: side("start", c))))
    claims = materialise(kept(offers, alone).withColumn("sides", sides), "hypotheses-kept")
    linked = claims.select(F.col("sides")[0].alias("u"), F.explode(F.slice("sides", 2, 2)).alias("v"))
    part = components(linked)
    small = F.lit(True) if most is None else F.count("*") <= most
    sizes = materialise(part.groupBy("root").agg(small.alias("small")).join(part, "root"), "hypotheses-parts")
    claims = claims.join(sizes.select(F.col("node").alias("_n"), "root", "small"), F.col("sides")[0] == F.col("_n")).drop("_n")
    one = alone.select("name", F.explode(F.array(F.struct(side("start", F.col("name")).alias("node"), F.col("begin").alias("score")), F.struct(side("end", F.col("name")).alias("node"), F.col("end").alias("score")))).alias("o"))
    one = one.select("name", "o.*").join(sizes.where("small"), "node")
    shape = dict(claims.dtypes)
    lonely = one.select(F.lit("alone").alias("kind"), "name", F.array().cast(shape["to"]).alias("to"), F.coalesce("score", F.lit(-MISSING)).alias("score"), F.array("node").alias("sides"), "root")
    rows = claims.where("small").select(*lonely.columns).unionByName(lonely)
    schema = f"kind string, name {shape['name']}, to {shape['to']}, score double, proved boolean"
    exact = rows.groupBy("root").applyInArrow(lambda table: solve(table, nodes), schema)
    if most is not None:
        large = chosen(claims.where("not small"), [-F.col("gain"), F.col("kind"), F.col("name"), F.col("to")], ["kind", "name", "to"]).select("kind", "name", "to", "score", F.lit(False).alias("proved"))
        exact = exact.unionByName(large)
    taken = materialise(exact.withColumn("sides", sides), "hypotheses-taken")
    used = taken.select(F.explode("sides").alias("s")).select("s.*")
    plain = F.array().cast(shape["to"]).alias("to")
    begin = alone.join(used.where("side = 'start'"), "name", "left_anti").select(F.when(F.col("begin").isNotNull(), "P_init").alias("kind"), "name", plain, F.col("begin").alias("score"), F.lit("start").alias("side"))
    end = alone.join(used.where("side = 'end'"), "name", "left_anti").select(F.col("end_kind").alias("kind"), "name", plain, F.col("end").alias("score"), F.lit("end").alias("side"))
    sure = sizes.select("node.*", "root").join(sizes.join(taken.where("not proved").select(F.col("sides")[0].alias("node")), "node", "left_semi").select("root").unionAll(sizes.where("not small").select("root")).distinct(), "root", "left_semi").select("name", "side", F.lit(False).alias("proved"))
    rest = begin.unionByName(end).join(sure, ["name", "side"], "left").select("kind", "name", "to", "score", F.coalesce("proved", F.lit(True)).alias("proved"))
    return taken.drop("sides").unionByName(rest)


def explained(taken: DataFrame) -> DataFrame:
    """(name, start_by, end_by, to, proved): a row a fragment with what explains its start and its end."""
    both = F.col("kind") == "P_FP"
    end = taken.where(both | F.col("kind").isin("P_term", "P_dead", "P_link", "P_branch")).select("name", F.col("kind").alias("end_by"), "to", "proved")
    begin = taken.where(both | (F.col("kind") == "P_init")).select("name", F.col("kind").alias("start_by"), F.col("proved").alias("_p"))
    into = taken.where("size(to) > 0").select(F.explode("to").alias("name"), F.col("kind").alias("start_by"), F.col("proved").alias("_p"))
    rows = end.join(begin.unionByName(into), "name", "full")
    return rows.select("name", "start_by", "end_by", F.coalesce("to", F.array().cast(dict(taken.dtypes)["to"])).alias("to"), (F.coalesce("proved", F.lit(True)) & F.coalesce("_p", F.lit(True))).alias("proved"))


def offers_of(named: DataFrame, key: str, model: Model) -> DataFrame:
    """`scored` for points (key, t, x, y, z, name) of named fragments."""
    found = summary(named, key)
    return scored(found, extent(named, key), gaps(found, key, model.dist_thresh, model.time_thresh), key, model)


def link_optimum(points: DataFrame, key: str, how: Tracker, model: Model, block: int = 50, overlap: int = 20) -> DataFrame:
    """(key, id, t, track, parent, false): tracking.link_motion, but fragments are joined and divided by the global optimum; false
    marks the points of fragments that are explained as false detections, which stay tracks of their own."""
    named = materialise(fragments(points, key, how, block, overlap), "fragments")
    taken = materialise(optimum(offers_of(named, key, model)), "hypotheses-optimum")
    links = taken.where("kind = 'P_link'").select(F.explode("to").alias("child"), F.col("name").alias("parent"))
    split = taken.where("kind = 'P_branch'").select(F.explode("to").alias("child"), F.col("name").alias("parent"))
    false = taken.where("kind = 'P_FP'").select("name", F.lit(True).alias("false"))
    rows = numbered(named, key, links, split, dict(points.dtypes))
    return rows.join(false, "name", "left").select(key, "id", "t", "track", "parent", F.coalesce("false", F.lit(False)).alias("false"))
