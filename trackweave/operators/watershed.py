"""Splitting touching objects: a distance transform, hills of it by steepest ascent, and hills that no deep pass parts joined again.

The distance of a foreground voxel is that to the nearest voxel that is not foreground, at most `reach`. Each voxel points to the
highest of its 27 neighbours, itself included (of equal ones to the first in z, y, x); the voxels that lead to one top are a hill. Two
hills become one object if the pass between them, the highest of the lower voxels of their touching pairs, lies less than `depth` below
the lower of their tops. Frames are cut into tiles with a halo of `reach` and one voxel more, so a worker holds one dense tile;
pointers that leave a tile are followed on by joins. The labels do not depend on `tile`.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Scale
from ..sources.shared import materialise
from .graphs import components, roots
from .voxel import BITS, normalise_percentile


def distances(front, steps: tuple[float, float, float], reach: float):
    """Squared distance of each true place of a dense array to the nearest false one, at most reach squared; axis by axis."""
    import numpy as np

    d = np.where(front, reach * reach, 0.0)
    for axis in (2, 1, 0):
        low = d.copy()
        for k in range(1, min(d.shape[axis] - 1, int(reach / steps[axis])) + 1):
            more = (k * steps[axis]) ** 2
            head, tail = [slice(None)] * 3, [slice(None)] * 3
            head[axis], tail[axis] = slice(None, -k), slice(k, None)
            head, tail = tuple(head), tuple(tail)
            low[head] = np.minimum(low[head], d[tail] + more)
            low[tail] = np.minimum(low[tail], d[head] + more)
        d = low
    return d


def hills(front: DataFrame, scale: Scale, reach: float, tile: int) -> DataFrame:
    """(t, z, y, x, place, d2, top, away): place is the voxel as one long, top the place where its pointers end or leave the tile (then
    `away`)."""
    steps = (scale.z, scale.y, scale.x)
    halo = [int(reach / s) + 1 for s in steps]
    schema = f"t {dict(front.dtypes)['t']}, z int, y int, x int, place long, d2 double, top long, away boolean"

    def run(rows):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("t", rows.schema.field("t").type), *[(c, pa.int32()) for c in "zyx"], ("place", pa.int64()), ("d2", pa.float64()), ("top", pa.int64()), ("away", pa.bool_())])
        at = np.stack([rows.column(c).to_numpy() for c in "zyx"]).astype(np.int64)
        if at.min() < 0 or at.max() >= 1 << BITS:
            raise ValueError(f"voxel places must be in 0..{(1 << BITS) - 1}")
        first = np.array([rows.column(f"_{c}")[0].as_py() * tile for c in "zyx"])
        mine = ((at >= first[:, None]) & (at < first[:, None] + tile)).all(axis=0)
        if not mine.any():
            return pa.table({f.name: pa.array([], f.type) for f in kinds})
        low = at.min(axis=1) - 1  # what is outside the box of the voxels is background, and one layer of it is the nearest
        inside = np.zeros(at.max(axis=1) - low + 2, bool)
        inside[tuple(at - low[:, None])] = True
        d = distances(inside, steps, reach)
        padded = np.pad(d, 1)
        best, to = np.full(d.shape, -1.0), np.zeros(d.shape, np.int64)
        number = np.arange(d.size).reshape(d.shape)
        stride = np.array([d.shape[1] * d.shape[2], d.shape[2], 1])
        for off in product((-1, 0, 1), repeat=3):  # in the order of places: the first of equals stays
            there = padded[tuple(slice(1 + o, 1 + o + n) for o, n in zip(off, d.shape, strict=True))]
            higher = there > best
            best[higher], to[higher] = there[higher], (number + np.array(off) @ stride)[higher]
        own = np.zeros(d.shape, bool)
        own[tuple(slice(max(0, f), max(0, f + tile)) for f in first - low)] = True
        to = np.where(own, to, number).ravel()
        while not np.array_equal(to[to], to):
            to = to[to]
        z, y, x = np.nonzero(inside & own)
        top = to.reshape(d.shape)[z, y, x]
        coded = lambda p: sum((p[k] + low[k]) << (BITS * (2 - k)) for k in range(3))
        i4 = lambda a, k: pa.array((a + low[k]).astype(np.int32))
        return pa.table({
            "t": pa.array([rows.column("t")[0].as_py()] * len(z), rows.schema.field("t").type), "z": i4(z, 0), "y": i4(y, 1), "x": i4(x, 2),
            "place": pa.array(coded((z, y, x))), "d2": pa.array(d[z, y, x]), "top": pa.array(coded(np.unravel_index(top, d.shape))), "away": pa.array(~own.ravel()[top]),
        }, schema=kinds)

    rows = front.select("t", *[F.col(c).cast("int").alias(c) for c in "zyx"])
    for c, h in zip("zyx", halo, strict=True):  # a voxel goes to every tile whose halo holds it
        rows = rows.withColumn(f"_{c}", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - h) / tile)), F.floor((F.col(c) + h) / tile))))
    return rows.groupBy("t", "_z", "_y", "_x").applyInArrow(run, schema)


def split_touching(front: DataFrame, scale: Scale = Scale(), reach: float = 4.0, depth: float = 0.5, tile: int = 64) -> DataFrame:
    """Foreground voxels (t, z, y, x; unique) -> (t, z, y, x, label), labels numbered in each frame from 1 by their first top. reach and
    depth are in the units of scale."""
    cells = materialise(hills(front, scale, reach, tile), "hills")
    node = lambda c: F.struct("t", F.col(c).alias("place"))
    left = cells.where("away").select("t", F.col("top").alias("place")).distinct()
    on = roots(cells.join(left, ["t", "place"]).where("top <> place").select(node("place").alias("child"), node("top").alias("parent")))
    cells = cells.withColumn("child", node("top")).join(on, "child", "left").select("t", *"zyx", "d2", F.coalesce("root", "child").alias("hill"))
    cells = materialise(cells, "hills-whole")
    top = cells.groupBy("hill").agg(F.max("d2").alias("top"))
    touching = None
    for c in "zyx":
        line = Window.partitionBy("t", *(o for o in "zyx" if o != c)).orderBy(c)
        pairs = cells.select("hill", "d2", c, *[F.lead(k).over(line).alias(f"_{k}") for k in ("hill", "d2", c)])
        pairs = pairs.where((F.col(f"_{c}") == F.col(c) + 1) & (F.col("hill") != F.col("_hill"))).select(F.least("hill", "_hill").alias("a"), F.greatest("hill", "_hill").alias("b"), F.least("d2", "_d2").alias("low"))
        touching = pairs if touching is None else touching.unionAll(pairs)
    passes = touching.groupBy("a", "b").agg(F.max("low").alias("saddle"))
    high = lambda c: top.select(F.col("hill").alias(c), F.col("top").alias(f"top_{c}"))
    passes = passes.join(high("a"), "a").join(high("b"), "b")
    shallow = passes.where(F.sqrt(F.least("top_a", "top_b")) - F.sqrt("saddle") < depth)
    whole = components(shallow.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = top.select("hill").join(whole.withColumnRenamed("node", "hill"), "hill", "left").withColumn("first", F.coalesce("root", "hill"))
    number = F.dense_rank().over(Window.partitionBy("hill.t").orderBy("first")).cast("long")  # a frame's objects, not its voxels
    return cells.join(named.select("hill", number.alias("label")), "hill").select("t", *"zyx", "label")


def segment_split(voxels: DataFrame, threshold: float = 0.5, scale: Scale = Scale(), reach: float = 4.0, depth: float = 0.5, tile: int = 64) -> DataFrame:
    """voxel.segment with touching objects split: percentile normalisation, threshold, hills of the distance."""
    return split_touching(normalise_percentile(voxels).where(F.col("norm") > threshold), scale, reach, depth, tile)
