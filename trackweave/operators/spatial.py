"""Joins in space: nearest, within a radius, by priority; registration to a reference; pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance, xyz
from ..sources.shared import materialise, spread


FEW_TARGETS = 32  # frames with no more are one cube


def levels(points: DataFrame, targets: DataFrame, on: list[str], scale: dict[str, float]) -> DataFrame:
    """(on, _o.x, _o.y, _o.z, _e, _top): per frame the corner and edge of the finest cubes, about one target each, and the level,
    of doubled edges, at which one cube holds all of the frame."""
    both = points.select(*on, *"xyz", F.lit(0).alias("_n")).unionAll(targets.select(*on, *"xyz", F.lit(1).alias("_n")))
    at = {c: F.col(c) * scale[c] for c in "xyz"}
    ends = both.groupBy(*on).agg(F.sum("_n").alias("_n"), F.struct(*[F.min(at[c]).alias(c) for c in "xyz"]).alias("_o"), F.greatest(*[F.max(at[c]) - F.min(at[c]) for c in "xyz"]).alias("_w"))
    top = F.when(F.col("_n") <= FEW_TARGETS, 0).otherwise(F.ceil(F.log2("_n") / 3)).cast("int")
    wide = F.when(F.col("_w") > 0, F.col("_w") * 1.0001).otherwise(F.lit(1.0))
    return ends.where("_n > 0").withColumn("_top", top).select(*on, "_o", "_top", (wide / F.pow(F.lit(2.0), F.col("_top"))).alias("_e"))


def cube(level: Column, scale: dict[str, float]) -> list[Column]:
    return [F.floor((F.col(c) * scale[c] - F.col(f"_o.{c}")) / (F.col("_e") * F.pow(F.lit(2.0), level))).alias(f"_g{c}") for c in "xyz"]


def nearest_of(points: DataFrame, targets: DataFrame, on: list[str], dist: Column, scale: dict[str, float]) -> DataFrame:
    """(on, id, nuc_id, dist) of points that have a target in their frame. dist is an expression of x, y, z and the
    target's _x, _y, _z, the scaled straight line. Every cube shows one of its targets, and the closest of those that a point's own
    cubes show bounds its search: only cubes at least as wide as this bound are looked through, as far as it reaches, and only targets
    within it are compared. Cubes join by equality: a large frame is neither one task nor quadratic, as long as its targets are
    spread as its points are."""
    points, targets = materialise(points.select(*on, "id", *"xyz"), "nearest-points"), materialise(targets.select(*on, "target_id", *"xyz"), "nearest-targets")
    place = levels(points, targets, on, scale)  # what is used more than once is written: plans would repeat it
    key, each = [*on, "_l", "_gx", "_gy", "_gz"], F.explode(F.sequence(F.lit(0), F.col("_top")))
    known = lambda df: df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in "xyz"]) == 0).join(place, on)
    t = known(targets).withColumn("_l", each)
    t = materialise(t.select(*on, "_l", *cube(F.col("_l"), scale), "target_id", *[F.col(c).alias(f"_{c}") for c in "xyz"]), "nearest-cubes")
    p = materialise(spread(known(points)), "nearest-placed")
    shown = t.groupBy(*key).agg(F.min(F.struct("target_id", *[f"_{c}" for c in "xyz"])).alias("_s")).select(*key, "_s.*")
    own = p.withColumn("_l", each).select(*on, "id", *"xyz", "_l", *cube(F.col("_l"), scale))
    bound = materialise(own.join(shown, key).groupBy(*on, "id").agg(F.min(dist).alias("_r")), "nearest-bounds")
    level = F.least(F.greatest(F.lit(0), F.ceil(F.log2(F.col("_r") / F.col("_e")))), F.col("_top")).cast("int")
    p = spread(p.join(bound, [*on, "id"])).withColumn("_l", level).withColumn("_w", F.col("_e") * F.pow(F.lit(2.0), F.col("_l")))
    for c in "xyz":  # a little further than the bound, for rounding
        at, far = F.col(c) * scale[c] - F.col(f"_o.{c}"), F.col("_r") * (1 + 1e-9) + F.col("_w") * 1e-9
        low, high = F.greatest(F.lit(0), F.floor((at - far) / F.col("_w"))), F.least(F.pow(F.lit(2.0), F.col("_top") - F.col("_l")).cast("long") - 1, F.floor((at + far) / F.col("_w")))
        p = p.withColumn(f"_g{c}", F.explode(F.sequence(low, high)))
    best = F.min(F.struct(dist.alias("dist"), F.col("target_id").alias("nuc_id"))).alias("best")
    close = p.select(*on, "id", *"xyz", "_r", *key[len(on) :]).join(t, key).where(dist <= F.col("_r"))
    return close.groupBy(*on, "id").agg(best).select(*on, "id", "best.nuc_id", "best.dist")


def nearest(points: DataFrame, targets: DataFrame, on: list[str] | str = "t", keep: str = "left") -> DataFrame:
    """For each point (columns id, x, y, z and `on`) the nearest target (target_id, x, y, z and `on`): nuc_id and dist,
    of equal distances the smallest id; NULL if `on` has none or the point has no place (with keep="inner" such points
    are left out). Targets without a place are nobody's nearest. Points must be unique by id and `on`."""
    on = [on] if isinstance(on, str) else on
    found = nearest_of(points, targets, on, distance(xyz(), xyz("_")), dict.fromkeys("xyz", 1.0))
    return found if keep == "inner" else points.select(*on, "id").join(found, [*on, "id"], "left")


def grid(prefix: str, radius: float) -> list[Column]:
    return [F.floor(F.col(f"{prefix}{c}") / radius).alias(f"_g{c}") for c in "xyz"]


def radius_pairs(points: DataFrame, targets: DataFrame, radius: float, on: list[str] | str = "t") -> DataFrame:
    """(on, id, target_id, dist) of all pairs closer than radius. Space is cut into cubes of that edge; targets go to
    their cube and its 26 neighbours, so cubes join by equality and a crowded frame does not become quadratic."""
    on = [on] if isinstance(on, str) else on
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    t = targets.select(*on, "target_id", *[F.col(c).alias(f"_{c}") for c in "xyz"], *grid("", radius)).withColumn("_d", around)
    t = t.withColumns({f"_g{c}": F.col(f"_g{c}") + F.col(f"_d.{c}") for c in "xyz"}).drop("_d")
    p = points.select(*on, "id", *"xyz", *grid("", radius))
    both = p.join(t, [*on, "_gx", "_gy", "_gz"]).withColumn("dist", distance(xyz(), xyz("_")))
    return both.where(F.col("dist") < radius).select(*on, "id", "target_id", "dist")


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, on: list[str] | str = "t") -> DataFrame:
    """nearest() by cubes, for points that have a target closer than radius."""
    on = [on] if isinstance(on, str) else on
    pairs = radius_pairs(points, targets, radius, on)
    best = F.min(F.struct("dist", F.col("target_id").alias("nuc_id"))).alias("best")
    return pairs.groupBy(*on, "id").agg(best).select(*on, "id", "best.nuc_id", "best.dist")


def by_priority(candidates: DataFrame, nuclei: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, t, id, x, y, z): of the candidate ids of an interval table (key, t_lo, t_hi, prio, id), t_lo <= t <= t_hi,
    the first by priority that is present in the frame. Candidates are a hand-made list of a few rows."""
    n = nuclei.select("t", "id", *"xyz")
    both = n.join(candidates, (n["id"] == candidates["id"]) & (n["t"] >= candidates["t_lo"]) & (n["t"] <= candidates["t_hi"])).select(key, n["t"], n["id"], "prio", *"xyz")
    first = F.min_by(F.struct("id", *"xyz"), F.struct("prio", "id")).alias("first")
    return both.groupBy(key, "t").agg(first).select(key, "t", "first.*")


def candidate_at(candidates: DataFrame, frames: DataFrame, key: str = "cell_id") -> DataFrame:
    """The ordered candidate ids of each frame, as an array."""
    both = frames.join(candidates, F.col("t").between(F.col("t_lo"), F.col("t_hi")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("prio", "id"))), lambda s: s["id"])
    return both.groupBy(key, "t").agg(ids.alias("ids"))


def register(points: DataFrame, reference: DataFrame, on: list[str] | str = "t") -> DataFrame:
    """Adds x_reg, y_reg, z_reg: coordinates minus the reference's of the frame; frames without one go."""
    on = [on] if isinstance(on, str) else on
    r = reference.select(*on, *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return points.join(r, on).withColumns({f"{c}_reg": F.col(c) - F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")


def unregister(points: DataFrame, reference: DataFrame, on: list[str] | str = "t") -> DataFrame:
    """Adds the reference back to x_reg, y_reg, z_reg, giving x, y, z."""
    on = [on] if isinstance(on, str) else on
    r = reference.select(*on, *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return points.join(r, on).withColumns({c: F.col(f"{c}_reg") + F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")


def pairwise_distance(series: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, t, id_a, id_b, dist) of the unordered pairs of a cell's spots that are both present in a frame."""
    series = series.select(key, "t", "id", *"xyz").repartition(key, "t")  # one exchange for both sides
    a = series.select(key, "t", F.col("id").alias("id_a"), *"xyz")
    b = series.select(key, "t", F.col("id").alias("id_b"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    both = a.join(b, [key, "t"]).where("id_a < id_b")
    return both.select(key, "t", "id_a", "id_b", distance(xyz(), xyz("_")).alias("dist"))


def select_spots(points: DataFrame, nuclei: DataFrame, candidates: DataFrame, frames: DataFrame, radius: float = 10.0, backfill: bool = False) -> DataFrame:
    """(cell_id, t, id, dist): spots closer than radius to the cell's chosen nucleus of the frame. Frames without one select
    nothing; with backfill they take the nucleus of the last frame before that had one. frames lists every (t)."""
    chosen = by_priority(candidates, nuclei)
    if backfill:
        grid_ = frames.select("t").crossJoin(F.broadcast(chosen.select("cell_id").distinct()))  # cells of a hand-made list
        filled = grid_.join(chosen, ["cell_id", "t"], "left")
        last = F.last(F.when(F.col("id").isNotNull(), F.struct("id", *"xyz")), ignorenulls=True)
        filled = filled.withColumn("_n", last.over(Window.partitionBy("cell_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
        chosen = filled.where("_n is not null").select("cell_id", "t", "_n.*")
    targets = chosen.select("t", F.struct("cell_id", "id").alias("target_id"), *"xyz")
    return radius_pairs(points, targets, radius).select("target_id.cell_id", "t", "id", "dist")
