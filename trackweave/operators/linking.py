"""Linking detections over frames: mutual nearest neighbours, chains, gap closing, dense ids.

This is a documented substitute for an external Bayesian tracker; it claims no equality with one.
"""

from __future__ import annotations

from math import ceil, inf, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .spatial import nearest, register


def mutual_links(points: DataFrame, max_dist: float, key: list[str] | None = None) -> DataFrame:
    """(key..., t, id_a, id_b, dist): points of frames t and t + 1 that are each other's nearest, closer than max_dist; of
    equal distances the smaller id. By nearest joins, so a crowded frame does not become quadratic, however far max_dist reaches."""
    on = [*(key or []), "t"]
    placed = points.where(" and ".join(f"not isnan({c}) and abs({c}) < double('{inf}')" for c in "xyz"))
    here, after = placed.select(*on, "id", *"xyz"), placed.select(*(key or []), (F.col("t") - 1).alias("t"), "id", *"xyz")
    ahead, back = (nearest(a, b.withColumnRenamed("id", "target_id"), on, keep="inner") for a, b in ((here, after), (after, here)))
    back = back.select(*on, F.col("id").alias("nuc_id"), F.col("nuc_id").alias("id"))
    return ahead.where(F.col("dist") < max_dist).join(back, [*on, "id", "nuc_id"]).select(*on, F.col("id").alias("id_a"), F.col("nuc_id").alias("id_b"), "dist")


def chains(points: DataFrame, links: DataFrame, n_frames: int | None = None) -> DataFrame:
    """(id, t, head, place): the first point of each point's chain and the steps from it. Chains have one link in and one
    out at most, so pointers are doubled: log2(n_frames) joins, each written, as a plan that joins with itself would double
    as well. n_frames is read off the points if not given. Ids are unique over frames."""
    if n_frames is None:
        n_frames = points.agg(F.coalesce(F.max("t") - F.min("t") + 1, F.lit(1))).first()[0]
    up = points.select("id", "t").join(links.select(F.col("id_b").alias("id"), F.col("id_a").alias("head")), "id", "left")
    up = up.withColumn("place", F.when(F.col("head").isNull(), 0).otherwise(1)).withColumn("head", F.coalesce("head", "id"))
    up = materialise(up, "chains")
    for _ in range(max(1, ceil(log2(max(2, n_frames))))):
        above = up.select(F.col("id").alias("head"), F.col("head").alias("_h"), F.col("place").alias("_p"))
        up = materialise(up.join(above, "head").select("id", "t", F.col("_h").alias("head"), (F.col("place") + F.col("_p")).alias("place")), "chains")
    return up


def dense_relabel(ids: DataFrame, column: str = "id", width: int = 1 << 16) -> DataFrame:
    """(id, new_id): ids numbered 1..n in order. Ids are ranked within ranges of `width`; only the ranges' counts are
    summed in one place."""
    d = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_r", F.floor(F.col(column) / width))
    n = d.groupBy("_r").agg(F.count("*").alias("_n"))
    base = n.withColumn("_base", F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_r").orderBy(column))
    return d.withColumn("_rank", rank).join(base, "_r").select(column, (F.coalesce("_base", F.lit(0)) + F.col("_rank")).cast("long").alias("new_id"))


def relabel_points(points: DataFrame, edges: DataFrame, column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Points and graph (child, parent) under dense ids."""
    names = dense_relabel(points, column)
    to = lambda c: names.select(F.col(column).alias(c), F.col("new_id").alias(f"_{c}"))
    graph = edges.join(to("child"), "child").join(to("parent"), "parent").select(F.col("_child").alias("child"), F.col("_parent").alias("parent"))
    return points.join(names, column).drop(column).withColumnRenamed("new_id", column), graph


def link_frames(points: DataFrame, key: str, max_dist: float, max_lost: int = 2) -> DataFrame:
    """(key, id, t, track): frame-to-frame links with gaps of up to max_lost frames closed. Open tracks and a frame's points
    are paired by ascending distance (ties: older track, smaller id); a point without a track starts one. Movies are
    independent; one movie is one group, as global linking needs all its frames."""

    def run(pdf):
        import numpy as np

        open_: list[tuple[int, int, np.ndarray]] = []
        out, n = [], 0
        for t, frame in pdf.sort_values(["t", "id"]).groupby("t", sort=True):
            xyz, ids = frame[["x", "y", "z"]].to_numpy(), frame["id"].to_numpy()
            open_ = [o for o in open_ if t - o[1] <= max_lost + 1]
            taken, used = {}, set()
            if open_ and len(ids):
                d = np.linalg.norm(np.array([o[2] for o in open_])[:, None] - xyz[None], axis=2)
                for k in np.argsort(d, axis=None, kind="stable"):
                    i, j = divmod(int(k), len(ids))
                    if d[i, j] >= max_dist:
                        break
                    if i not in used and j not in taken:
                        taken[j] = i
                        used.add(i)
            for j, id_ in enumerate(ids):
                if j in taken:
                    open_[taken[j]] = (open_[taken[j]][0], t, xyz[j])
                    track = open_[taken[j]][0]
                else:
                    n += 1
                    track = n
                    open_.append((track, t, xyz[j]))
                out.append((pdf[key].iloc[0], id_, t, track))
        import pandas as pd

        return pd.DataFrame(out, columns=[key, "id", "t", "track"])

    kinds = dict(points.dtypes)
    return points.select(key, "id", "t", *"xyz").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, id {kinds['id']}, t {kinds['t']}, track long")


def link_registered(points: DataFrame, reference: DataFrame, key: str, max_dist: float, max_lost: int = 2) -> DataFrame:
    """Links in the frame of a moving reference (key, t, x, y, z), which takes the cell's own motion out, and returns
    (key, track, t, id, x, y, z) in the original frame. Frames without a reference are left out."""
    fixed = register(points, reference, [key, "t"]).select(key, "t", "id", *[F.col(f"{c}_reg").alias(c) for c in "xyz"])
    tracks = link_frames(fixed, key, max_dist, max_lost)
    return tracks.join(points, [key, "t", "id"]).select(key, "track", "t", "id", *"xyz")
