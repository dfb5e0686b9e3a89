"""Dense series and what needs them: gaps, fills, moving averages, smoothing of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(series: DataFrame, t: str = "t") -> DataFrame:
    """One row: the number of frames, 1 + the largest t."""
    return series.agg((F.max(t) + 1).alias("n_frames"))


def densify(series: DataFrame, keys: list[str] | str = "id", n_frames: DataFrame | str | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """One row per key and frame 0..n-1, NULL where the series has none; `present` tells which. Columns in `same` are
    alike in all of a key's rows and are filled.

    Instead of joining a spine, each row fills the gap up to the key's next row, so the one exchange is by key and
    serves every window that follows. n_frames is one row (broadcast), or a row for each value of the columns of `keys` and
    `same` that it has, such as a cell's own number of frames, or the name of a column of series that holds the number."""
    keys = [keys] if isinstance(keys, str) else keys
    rows = series.withColumnRenamed(n_frames, "n_frames") if isinstance(n_frames, str) else series
    rest = [c for c in rows.columns if c not in (*keys, "t", *same, "n_frames" if isinstance(n_frames, str) else "")]
    w = Window.partitionBy(*keys).orderBy("t")
    rows = rows.withColumns({"_next": F.lead("t").over(w), "_prev": F.lag("t").over(w)})
    if not isinstance(n_frames, str):
        n_frames = n_frames if n_frames is not None else frames(series)
        owner = [c for c in (*keys, *same) if c in n_frames.columns]
        rows = rows.join(n_frames.select(*owner, "n_frames"), owner) if owner else rows.crossJoin(F.broadcast(n_frames))
    end = F.greatest(F.col("t"), F.coalesce("_next", "n_frames") - 1)
    begin = F.when(F.col("_prev").isNull(), F.least(F.lit(0), F.col("t"))).otherwise(F.col("t"))
    rows = rows.withColumn("_t", F.explode(F.sequence(begin, end)))
    own = F.col("_t") == F.col("t")
    return rows.select(*keys, *same, F.col("_t").alias("t"), *[F.when(own, F.col(c)).alias(c) for c in rest], own.alias("present"))


def missing_frames(series: DataFrame, keys: list[str] | str = "id") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    return densify(series.select(*keys, "t"), keys, frames(series)).where(~F.col("present")).select(*keys, "t")


def last_known(value: Column, key: list[str]) -> Column:
    """The latest value that is not NULL, of this frame or before; leading gaps stay NULL."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))


def gapfill_midpoint(dense: DataFrame, columns: list[str], key: list[str], wrap: bool = True) -> DataFrame:
    """Each missing value becomes the mean of the value before it (already filled) and the next known one: in closed form
    next + (prev - next) / 2^j for the j-th frame of the gap. A leading gap takes the last known value of all as the one
    before frame 0 if wrap, else it stays NULL; a trailing gap stays NULL."""
    w = Window.partitionBy(*key).orderBy("t")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = dense
    for c in columns:
        known = F.col(c).isNotNull()
        at = F.last(F.when(known, F.col("t")), ignorenulls=True).over(back)
        prev = F.last(c, ignorenulls=True).over(back)
        if wrap:
            prev = F.coalesce(prev, F.last(c, ignorenulls=True).over(all_))
        nxt = F.first(c, ignorenulls=True).over(ahead)
        j = F.col("t") - F.coalesce(at, F.lit(-1))
        out = out.withColumn(f"_{c}", F.when(known, F.col(c)).otherwise(nxt + (prev - nxt) / F.pow(F.lit(2.0), j)))
    return out.drop(*columns).withColumnsRenamed({f"_{c}": c for c in columns})


def moving_avg(dense: DataFrame, columns: list[str], key: list[str], half: int = 2) -> DataFrame:
    """Centred average over t - half .. t + half of what is known there."""
    w = Window.partitionBy(*key).orderBy("t").rangeBetween(-half, half)
    return dense.withColumns({f"{c}_avg": F.avg(c).over(w) for c in columns})


def smooth_counts(counts: DataFrame, key: list[str], n: str = "n", half: int = 2) -> DataFrame:
    """Adds n_smooth: over t - half .. t + half, without the last frame, the smallest most frequent count if it occurs
    more than once, else the median."""
    w = Window.partitionBy(*key).orderBy("t")
    last = F.max("t").over(Window.partitionBy(*key))
    near = F.array_sort(F.collect_list(F.when(F.col("t") < F.col("_last"), F.col(n))).over(w.rowsBetween(-half, half)))
    votes = F.transform(F.array_distinct("_near"), lambda v: F.struct(F.size(F.filter("_near", lambda x: x == v)).alias("c"), (-v).alias("v")))
    k = F.size("_near")
    median = (F.get("_near", F.floor((k - 1) / 2).cast("int")) + F.get("_near", F.floor(k / 2).cast("int"))) / F.lit(2.0)
    out = counts.withColumn("_last", last).withColumn("_near", near).withColumn("_top", F.array_max(votes))
    value = F.when(F.col("_top.c") > 1, -F.col("_top.v").cast("double")).otherwise(median)
    return out.withColumn("n_smooth", value).drop("_last", "_near", "_top")
