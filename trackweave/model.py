"""Data model: physical scale and the rule that a missing value is NULL, never NaN."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    """Micrometres per voxel; the defaults are those of the example movies."""

    z: float = 0.75
    y: float = 0.173
    x: float = 0.173


TRACK_POINT = "id long, t int, z double, y double, x double"


def no_nan(c: Column) -> Column:
    """NULL where c is NaN."""
    return F.when(~F.isnan(c), c)


def without_nan(rows: DataFrame) -> DataFrame:
    """rows with NULL for every NaN: readers apply it, so that operators need not ask for both."""
    return rows.withColumns({c: no_nan(F.col(c)) for c, kind in rows.dtypes if kind in ("float", "double")})
