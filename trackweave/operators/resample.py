"""Volumes on another grid: linear interpolation axis by axis, and labels brought back to the first grid.

A frame of n places along an axis gets max(1, round(n * factor)), half to even. Place j of the new grid lies at (j + 0.5) / factor - 0.5 of
the old one, held within 0 .. n - 1. Along each axis a voxel gives its share to the new places that lie within one step of it, and
shares are added up: one exchange an axis, none where the factor is 1, and no frame or line in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extents(voxels: DataFrame) -> DataFrame:
    """(t, nz, ny, nx): one more than the greatest place of a frame."""
    return voxels.groupBy("t").agg(*[(F.max(c) + 1).alias(f"n{c}") for c in "zyx"])


def size(n: Column, factor: float) -> Column:
    return F.greatest(F.lit(1), F.rint(n * F.lit(float(factor))).cast("int"))


def source(j: Column, n: Column, factor: float) -> Column:
    """Where a new place lies on the old grid."""
    return F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), (j + 0.5) / F.lit(float(factor)) - 0.5))


def resample(voxels: DataFrame, factors: tuple[float, float, float], shape: DataFrame | None = None) -> DataFrame:
    """Voxels (t, z, y, x, value), all places of a frame present -> the same on the new grid, values as double. factors are of z, y, x."""
    shape = extents(voxels) if shape is None else shape
    rows = voxels.select("t", *"zyx", F.col("value").cast("double").alias("value")).join(shape, "t")
    for c, f in zip("zyx", factors, strict=True):
        if f == 1:
            continue
        rest, n = [o for o in "zyx" if o != c], F.col(f"n{c}")
        m = size(n, f)
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - 0.5) * f - 0.5).cast("int") - 1)
        high = F.least(m - 1, F.floor((F.col(c) + 1.5) * f - 0.5).cast("int") + 1)
        low, high = F.when(F.col(c) == 0, F.lit(0)).otherwise(low), F.when(F.col(c) == n - 1, m - 1).otherwise(high)  # the ends also serve what is held there
        each = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        near = rows.withColumn("_j", F.explode(each)).withColumn("_w", 1 - F.abs(source(F.col("_j"), n, f) - F.col(c))).where("_w > 0")
        near = near.groupBy("t", *rest, F.col("_j").alias(c)).agg(F.sum(F.col("_w") * F.col("value")).alias("value"), *[F.first(f"n{o}").alias(f"n{o}") for o in "zyx"])
        rows = near
    return rows.select("t", *"zyx", "value")


def labels_back(labels: DataFrame, factors: tuple[float, float, float], shape: DataFrame) -> DataFrame:
    """Label voxels (t, z, y, x, label) of the grid that resample() gave -> those of the first grid, whose extents (t, nz, ny, nx) are
    given: each place has the label of the nearest new place, of two the lower. Every voxel is spread where it stands, without a
    shuffle of voxels."""
    rows = labels.select("t", *"zyx", "label").join(shape, "t")
    for c, f in zip("zyx", factors, strict=True):
        n = F.col(f"n{c}")
        place = lambda i: F.greatest(F.lit(0), F.least(size(n, f) - 1, F.ceil((i + 0.5) * F.lit(float(f)) - 1).cast("int")))  # noqa: B023, E731
        low, high = F.floor(F.col(c) / f).cast("int") - 1, F.ceil((F.col(c) + 1) / f).cast("int") + 1
        each = F.filter(F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), F.least(n - 1, F.when(F.col(c) == size(n, f) - 1, n - 1).otherwise(high)))), lambda i: (place(i) == F.col(c)) & (i < n))  # noqa: B023
        rows = rows.withColumn("_i", F.explode(each)).withColumn(c, F.col("_i")).drop("_i")
    return rows.select("t", *"zyx", "label")
