"""Projections, filters, unit conversion, set operations and external edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Scale


def project(points: DataFrame, two_d: bool = False) -> DataFrame:
    """id, t, z, y, x; z is 0 in two dimensions. Index columns of exported files fall away."""
    z = F.lit(0.0) if two_d else F.col("z")
    return points.select("id", "t", z.alias("z"), "y", "x")


def at_frame(points: DataFrame, t: int) -> DataFrame:
    return points.where(F.col("t") == t)


def of_id_at_frame(points: DataFrame, id_: int, t: int) -> DataFrame:
    return points.where((F.col("id") == id_) & (F.col("t") == t))


def known(points: DataFrame, column: str) -> DataFrame:
    return points.where(F.col(column).isNotNull())


def to_micrometres(points: DataFrame, scale: Scale = Scale()) -> DataFrame:
    return points.withColumns({c: F.col(c) * getattr(scale, c) for c in "zyx"})


def to_voxels(points: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Truncated toward zero, as array indices are."""
    return points.withColumns({c: (F.col(c) / getattr(scale, c)).cast("int") for c in "zyx"})


def clamp(rows: DataFrame, column: str, most: int) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) > most, most).otherwise(F.col(column)))


def sort_tracks(points: DataFrame) -> DataFrame:
    """By frame, then id: for files people read; nothing else needs an order."""
    return points.orderBy("t", "id")


def union_frames(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_point_edits(points: DataFrame, removed: DataFrame, added: DataFrame, key: tuple[str, ...] = ("id", "t")) -> DataFrame:
    """Points edited elsewhere: removed ones go, added ones come."""
    return points.join(removed.select(*key), [*key], "left_anti").select(*points.columns).unionByName(added.select(*points.columns))


def semi_join(rows: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(chosen.select(*key), key, "left_semi")
