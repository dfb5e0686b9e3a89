"""Counts and averages by frame, cell and nucleus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .spine import densify


def per_frame(series: DataFrame, n_frames: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, t, n) with 0 for frames without rows."""
    n = series.groupBy(key, "t").agg(F.count("*").alias("n"))
    return densify(n, key, n_frames).select(key, "t", F.coalesce("n", F.lit(0)).alias("n"))


def per_nucleus_zero(nuclei: DataFrame, assigned: DataFrame) -> DataFrame:
    """(t, nuc_id, n): spots assigned to each nucleus, 0 for those without."""
    n = assigned.where("nuc_id is not null").groupBy("t", "nuc_id").agg(F.count("*").alias("n"))
    return nuclei.select("t", F.col("id").alias("nuc_id")).join(n, ["t", "nuc_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distances_per_nucleus(assigned: DataFrame) -> DataFrame:
    return assigned.where("nuc_id is not null").groupBy("t", "nuc_id").agg(F.array_sort(F.collect_list("dist")).alias("dists"))


def distinct_nuclei(count_null: bool = True) -> Column:
    """Distinct nuclei in a group; rows without one count as one more if count_null."""
    n = F.count_distinct("nuc_id")
    return n + F.max(F.when(F.col("nuc_id").isNull(), 1).otherwise(0)) if count_null else n


def per_nucleus(series: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, t, nuc_id, n); the group without a nucleus gets 0, as NaN equals nothing."""
    return series.groupBy(key, "t", "nuc_id").agg(F.count("*").alias("_n")).select(key, "t", "nuc_id", F.when(F.col("nuc_id").isNull(), 0).otherwise(F.col("_n")).alias("n"))


def cell_centre(series: DataFrame, key: str = "cell_id") -> DataFrame:
    return series.groupBy(key, "t").agg(*[F.avg(c).alias(c) for c in "xyz"])


def bounds(points: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rounded half to even."""
    return points.groupBy(key).agg(*[F.rint(f(c)).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def nucleus_positions(counts: DataFrame) -> DataFrame:
    """Rows (t, nuc_id, x, n) of nuclei with spots -> (t, position, label, n): the least x is left, the greatest right, all
    others are middle under their smallest id; a lone nucleus is left. Of equal x the smaller id comes first, for the
    greatest x as well. Where rows list their spots (an array `spots`), so do the positions, in ascending order."""
    up = F.row_number().over(Window.partitionBy("t").orderBy("x", "nuc_id"))
    down = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("x"), "nuc_id"))
    named = counts.withColumns({"_up": up, "_down": down}).withColumn("position", F.when(F.col("_up") == 1, "left").when(F.col("_down") == 1, "right").otherwise("middle"))
    lists = [F.array_sort(F.flatten(F.collect_list("spots"))).alias("spots")] if "spots" in counts.columns else []
    return named.groupBy("t", "position").agg(F.min("nuc_id").alias("label"), F.sum("n").alias("n"), *lists)


def position_counts(positions: DataFrame, n_frames: DataFrame) -> DataFrame:
    """(t, position, n) for every frame and position, 0 where there is none."""
    spine = n_frames.select(F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("t"), F.array(*[F.lit(p) for p in ("left", "middle", "right")]).alias("p"))
    spine = spine.select("t", F.explode("p").alias("position"))
    return spine.join(positions.select("t", "position", "n"), ["t", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
