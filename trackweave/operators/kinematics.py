"""Speed, direction and their derivatives over dense series; every function expects rows for all frames of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import angle_over_pi, cosine, distance, norm, xyz


def by(key: str):
    return Window.partitionBy(key).orderBy("t")


def speed(dense: DataFrame, key: str = "id") -> DataFrame:
    """Distance from the frame before, NULL across gaps; frames from 1 on."""
    prev = [F.lag(c).over(by(key)) for c in "xyz"]
    return dense.withColumn("speed", distance(xyz(), prev)).where("t >= 1")


def cosine_position(dense: DataFrame, key: str = "id") -> DataFrame:
    """Cosine between the position vectors of this frame and the one before."""
    prev = [F.lag(c).over(by(key)) for c in "xyz"]
    return dense.withColumn("cos_pos", cosine(xyz(), prev)).where("t >= 1")


def directions(dense: DataFrame, key: str = "id", coords: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Adds norm (of the step to this frame), cos and angle (over pi, of this step and the next): frames 1..n-2 have a
    cosine if none of the three places is missing and no step is zero."""
    w = by(key)
    step = {f"d{i}": F.col(c) - F.lag(c).over(w) for i, c in enumerate(coords)}
    nxt = {f"e{i}": F.lead(c).over(w) - F.col(c) for i, c in enumerate(coords)}
    out = dense.withColumns({**step, **nxt, "_last": F.lead("t").over(w)})
    d, e = [F.col(f"d{i}") for i in range(3)], [F.col(f"e{i}") for i in range(3)]
    out = out.withColumns({"norm": norm(d), "cos": cosine(d, e)}).withColumn("angle", angle_over_pi(F.col("cos")))
    return out.withColumn("inner", (F.col("t") >= 1) & F.col("_last").isNotNull()).drop("_last", *step, *nxt)


def cosines(dense: DataFrame, key: str = "id", coords: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    return directions(dense, key, coords).where("inner")


def ahead(c: str, key: str = "id", n: int = 1) -> Column:
    return F.lead(c, n).over(by(key))


def difference(rows: DataFrame, column: str, out: str, key: str = "id") -> DataFrame:
    """Next value minus this one; a key's last row goes."""
    w = by(key)
    return rows.withColumns({out: F.lead(column).over(w) - F.col(column), "_more": F.lead("t").over(w)}).where("_more is not null").drop("_more")
