"""Overlapping candidates: of boxes that overlap too much the one of lower score goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import first_of_neighbours


def overlaps(boxes: DataFrame, most: float, on: str = "t") -> DataFrame:
    """(on, a, b): ids of boxes of one frame whose intersection is more than `most` of their union. Boxes (on, id, z0, y0, x0, z1, y1,
    x1) meet by cubes as wide as the widest box, so a frame is not compared with all of itself."""
    sides = [F.col(f"{c}1") - F.col(f"{c}0") for c in "zyx"]
    edge = boxes.agg(F.max(F.greatest(*sides))).first()[0]
    if not edge or edge <= 0:
        return boxes.select(on, F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    cube = [F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / (2 * edge)).alias(f"_g{c}") for c in "zyx"]
    ends = [f"{c}{k}" for c in "zyx" for k in (0, 1)]
    mine = boxes.select(on, F.col("id").alias("a"), *ends, *cube)
    other = boxes.select(on, F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in ends], *cube)
    for c in "zyx":
        other = other.withColumn(f"_g{c}", F.explode(F.array(*[F.col(f"_g{c}") + d for d in (-1, 0, 1)])))
    both = mine.join(other, [on, "_gz", "_gy", "_gx"]).where("a < b")
    common, size, size_ = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for c in "zyx":
        common = common * F.greatest(F.lit(0.0), F.least(f"{c}1", f"_{c}1") - F.greatest(f"{c}0", f"_{c}0"))
        size, size_ = size * (F.col(f"{c}1") - F.col(f"{c}0")), size_ * (F.col(f"_{c}1") - F.col(f"_{c}0"))
    return both.where(common > most * (size + size_ - common)).select(on, "a", "b")


def suppress(boxes: DataFrame, least: float = 0.5577, most: float = 0.3, on: str = "t") -> DataFrame:
    """The boxes (on, id, score, z0, y0, x0, z1, y1, x1, ...; unique by frame and id) of score `least` or more that stay when all are gone
    through by descending score (ties: the smaller id), each if it overlaps none that has stayed by more than `most`."""
    good = boxes.where(F.col("score") >= least)
    node = lambda c: F.struct(on, F.col(c).alias("id"))
    edges = overlaps(good, most, on).select(node("a").alias("a"), node("b").alias("b"))
    return first_of_neighbours(good.withColumn("node", node("id")), [-F.col("score"), F.col(on), F.col("id")], edges).drop("node")
