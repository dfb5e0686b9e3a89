"""Voxels: projections, neighbourhoods, labels, intensities."""

from __future__ import annotations

from itertools import product
from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm
from ..model import Scale
from ..sources.shared import dealt, materialise
from .spatial import nearest_of


def argmax_z(voxels: DataFrame) -> DataFrame:
    """(t, y, x, z, value): the first of the greatest values along z."""
    best = F.max(F.struct("value", (-F.col("z")).alias("nz"))).alias("b")
    return voxels.groupBy("t", "y", "x").agg(best).select("t", "y", "x", (-F.col("b.nz")).alias("z"), "b.value")


def max_projection(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("t", "y", "x").agg(F.max("value").alias("value"))


def lift(spots: DataFrame, voxels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """2D detections in micrometres (t, id, position_x, position_y) get the voxel (truncated) and the z of the greatest
    value above it, and position_z; detections outside the volume go. Only the columns of voxels that spots stand on
    are aggregated."""
    s = spots.withColumns({"x": (F.col("position_x") / scale.x).cast("int"), "y": (F.col("position_y") / scale.y).cast("int")})
    under = voxels.join(s.select("t", "y", "x").distinct(), ["t", "y", "x"], "left_semi")
    top = argmax_z(under).select("t", "y", "x", "z")
    return s.join(top, ["t", "y", "x"]).withColumn("position_z", F.col("z") * scale.z)


def offsets(radius: float = 2.5, weights: tuple[float, float, float] = (1.66, 0.75, 0.75), flat: bool = False) -> list[tuple[int, int, int]]:
    """(dz, dy, dx) whose weighted length is below the radius."""
    reach = [0 if flat and k == 0 else int(radius / w) for k, w in enumerate(weights)]
    near = lambda d: sqrt(sum((w * v) ** 2 for w, v in zip(weights, d, strict=True))) < radius
    return [d for d in product(*[range(-r, r + 1) for r in reach]) if near(d)]


def gather(spots: DataFrame, voxels: DataFrame, around: list[tuple[int, int, int]], more: tuple[str, ...] = ()) -> DataFrame:
    """(t, id, value, *more): the voxels around each spot (t, id, z, y, x), clipped to the volume. Each spot is joined by
    place to a fixed table of offsets, not to its frame's whole volume. Spots are counted; the voxels pass by and are not held."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("zyx", d, strict=True)]) for d in around]))
    s = spots.select("t", "id", *"zyx").withColumn("d", each).select("t", "id", *[(F.col(c) + F.col(f"d.{c}")).cast("int").alias(c) for c in "zyx"])
    s, v = dealt(s, voxels, ["t", *"zyx"], spots.count() * len(around))
    return s.join(v, ["t", *"zyx"]).select("t", "id", "value", *more)


def fluo_threshold(samples: DataFrame, factor: float = 1.15) -> DataFrame:
    """(t, size, fluo) of rows (t, values). The mean and the threshold are computed once per row."""
    v = F.col("values")
    n = F.size(v)
    out = samples.withColumn("_mean", F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), n))
    out = out.withColumn("_limit", F.col("_mean") + factor * F.sqrt(F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))), n)))
    out = out.withColumn("_above", F.filter(v, lambda x: x > F.col("_limit")))
    return out.select("t", F.size("_above").cast("long").alias("size"), F.try_divide(F.aggregate("_above", F.lit(0.0), lambda a, x: a + x), F.size("_above")).alias("fluo"))


def mean_by_channel(rows: DataFrame, channels: list[int]) -> DataFrame:
    """Rows (t, id, channel, value) -> one column Chan_c per channel."""
    return rows.groupBy("t", "id").agg(*[F.avg(F.when(F.col("channel") == c, F.col("value"))).alias(f"Chan_{c}") for c in channels])


def label_centroids(labels: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(t, label, z, y, x in micrometres, area, intensity) of foreground objects."""
    centre = [(F.avg(c) * getattr(scale, c)).alias(c) for c in "zyx"]
    return labels.where("label <> 0").groupBy("t", "label").agg(*centre, F.count("*").alias("area"), F.avg("value").alias("intensity"))


def relabel_by_seed(labels: DataFrame, seeds: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Voxels of each label that a track point (t, id, z, y, x in micrometres) falls on get its id; of several points the
    one of greatest id, points outside the volume or on the background have no effect, and other labels go."""
    at = seeds.select("t", "id", *[F.rint(F.col(c) / getattr(scale, c)).cast("int").alias(c) for c in "zyx"])
    named = at.join(labels.where("label <> 0").select("t", *"zyx", "label"), ["t", *"zyx"]).groupBy("t", "label").agg(F.max("id").alias("track_id"))
    return labels.where("label <> 0").join(named, ["t", "label"]).select("t", *"zyx", "track_id")


def surface(labels: DataFrame) -> DataFrame:
    """Foreground voxels that lack a neighbour of the same label on one of six sides. Voxels are unique by frame and place."""
    front, inner = labels.where("label <> 0").select("t", "label", *"zyx"), F.lit(True)
    for c in "zyx":  # one exchange for each axis
        line = Window.partitionBy("t", "label", *(o for o in "zyx" if o != c)).orderBy(c)
        both = (F.lag(c).over(line) == F.col(c) - 1) & (F.lead(c).over(line) == F.col(c) + 1)
        front = front.withColumn(f"_{c}", F.coalesce(both, F.lit(False)))
        inner = inner & F.col(f"_{c}")
    return front.where(~inner).select("t", "label", *"zyx")


def nearest_voxel(spots: DataFrame, labels: DataFrame, chosen: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """(t, id, nuc_id, dist_nuc): for spots in voxels the nearest voxel of the frame's chosen labels (t, label); of equal
    distances the smallest label; NULL in frames without one. Only surface voxels are compared, besides those that spots
    stand on: a nearest voxel lies on a surface or under the spot. By cubes, see spatial.nearest_of."""
    mine = labels.join(chosen.select("t", "label"), ["t", "label"], "left_semi")
    under = mine.join(spots.select("t", *"zyx").distinct(), ["t", *"zyx"], "left_semi").select("t", "label", *"zyx")
    v = surface(mine).unionByName(under).select("t", F.col("label").alias("target_id"), *"zyx")
    d = norm([(F.col(c) - F.col(f"_{c}")) * getattr(scale, c) for c in "zyx"])  # equal steps are equally far, to the last bit
    found = nearest_of(spots, v, ["t"], d, {c: getattr(scale, c) for c in "xyz"})
    return spots.select("t", "id").join(found.withColumnRenamed("dist", "dist_nuc"), ["t", "id"], "left")


def normalise_percentile(voxels: DataFrame, low: float = 0.01, high: float = 0.998) -> DataFrame:
    """Values scaled so that the frame's low and high percentile become 0 and 1."""
    p = voxels.groupBy("t").agg(F.percentile("value", F.lit(low)).alias("_lo"), F.percentile("value", F.lit(high)).alias("_hi"))
    return voxels.join(p, "t").withColumn("norm", F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def components(n: int, a, b):
    """The smallest member of each of n nodes' component under the edges a[k] - b[k], by hooking roots to smaller ones."""
    import numpy as np

    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(root[root], root):
            root = root[root]


BITS = 21  # of a place's z, y and x in one long


def pieces(front: DataFrame, tile: int) -> DataFrame:
    """Foreground (t, z, y, x) -> with `piece`, the first place (as one long) of the voxel's 6-connected component within its
    tile of tile^3 voxels. A tile is a group, so a worker holds one dense tile, however large the frame."""
    schema = f"t {dict(front.dtypes)['t']}, z int, y int, x int, piece long"

    def run(rows):
        import numpy as np
        import pyarrow as pa

        at = np.stack([rows.column(c).to_numpy() for c in "zyx"]).astype(np.int64)
        if at.min() < 0 or at.max() >= 1 << BITS:
            raise ValueError(f"voxel places must be in 0..{(1 << BITS) - 1}")
        at = at[:, np.lexsort(at[::-1])]
        low = at.min(axis=1)
        shape = at.max(axis=1) - low + 1
        index = np.full(shape, -1)
        index[tuple(at - low[:, None])] = np.arange(at.shape[1])
        a, b = [], []
        for axis in range(3):
            here, there = np.delete(index, -1, axis).ravel(), np.delete(index, 0, axis).ravel()
            both = (here >= 0) & (there >= 0)
            a.append(here[both])
            b.append(there[both])
        first = at[:, components(at.shape[1], np.concatenate(a), np.concatenate(b))]
        piece = (first[0] << 2 * BITS) | (first[1] << BITS) | first[2]
        t = rows.column("t")[0]
        i4 = lambda v: pa.array(v.astype(np.int32))
        return pa.table({"t": pa.array([t.as_py()] * len(piece), t.type), **{c: i4(v) for c, v in zip("zyx", at, strict=True)}, "piece": pa.array(piece)})

    tiles = {f"_{c}": F.floor(F.col(c) / tile) for c in "zyx"}
    return front.withColumns(tiles).groupBy("t", *tiles).applyInArrow(lambda rows: run(rows.select(["t", *"zyx"])), schema)


def joined_pieces(cells: DataFrame, tile: int) -> DataFrame:
    """(t, piece, first): pieces that touch another one across a tile's border, and the first place of their component. Only
    the different touching pairs of a frame meet in one group, never its voxels."""
    pairs = []
    for c in "zyx":
        rest = [o for o in "zyx" if o != c]
        here = cells.where(F.col(c) % tile == tile - 1).select("t", *rest, (F.col(c) + 1).alias(c), F.col("piece").alias("a"))
        there = cells.where(F.col(c) % tile == 0).select("t", *rest, c, F.col("piece").alias("b"))
        pairs.append(here.join(there, ["t", *"zyx"]).select("t", "a", "b").distinct())
    links = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()

    def run(rows):
        import numpy as np
        import pyarrow as pa

        names, ends = np.unique(np.concatenate([rows.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        first = names[components(len(names), *np.split(ends, 2))]
        t = rows.column("t")[0]
        return pa.table({"t": pa.array([t.as_py()] * len(names), t.type), "piece": pa.array(names), "first": pa.array(first)})

    return links.groupBy("t").applyInArrow(run, f"t {dict(cells.dtypes)['t']}, piece long, first long")


def segment(voxels: DataFrame, threshold: float = 0.5, tile: int = 64) -> DataFrame:
    """A documented stand-in for a trained segmentation network: percentile normalisation, threshold, and 6-connected
    components per frame (label numbers by first voxel, from 1). Voxels are unique by frame and place; frames whose low and
    high percentile are equal have no foreground. Frames are cut into tiles, and pieces that meet at a border are joined, so
    the labels do not depend on `tile`. A model can be plugged in as any function DataFrame -> DataFrame of label voxels."""
    front = normalise_percentile(voxels).where(F.col("norm") > threshold).select("t", *[F.col(c).cast("int").alias(c) for c in "zyx"])
    cells = materialise(pieces(front, tile), "pieces")
    named = cells.select("t", "piece").distinct().join(joined_pieces(cells, tile), ["t", "piece"], "left").withColumn("first", F.coalesce("first", "piece"))
    number = F.dense_rank().over(Window.partitionBy("t").orderBy("first")).cast("long")
    return cells.join(named.select("t", "piece", number.alias("label")), ["t", "piece"]).select("t", *"zyx", "label")
