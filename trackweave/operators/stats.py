"""Correlation of series, two-predictor regression, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(a: str, b: str) -> Column:
    """Over rows where both are known; NULL for a constant side (corr would raise under ANSI rules)."""
    sa = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a)))
    sb = F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
    return F.try_divide(F.covar_pop(a, b), sa * sb)


def correlation(rows: DataFrame, columns: list[str], key: str = "cell_id") -> DataFrame:
    """(key, id_a, id_b, r_<column>...) for all ordered pairs of a cell's series, pairwise complete; in long form, never
    pivoted. rows are dense (id, key, t, columns)."""
    rows = rows.select(key, "t", "id", *columns).repartition(key, "t")  # one exchange for both sides
    a = rows.select(key, "t", F.col("id").alias("id_a"), *columns)
    b = rows.select(key, "t", F.col("id").alias("id_b"), *[F.col(c).alias(f"_{c}") for c in columns])
    return a.join(b, [key, "t"]).groupBy(key, "id_a", "id_b").agg(*[pearson(c, f"_{c}").alias(f"r_{c}") for c in columns])


def direction_covariance(dense: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, t, n, var_x, var_y, var_z, cov_xy, cov_xz, cov_yz): sample covariance over a cell's spots of the steps from this
    frame to the next; spots that miss a place of either frame are left out, and fewer than two steps give NULL. dense is
    (id, key, t, x, y, z) for all frames."""
    w = Window.partitionBy("id").orderBy("t")
    steps = dense.select(key, "t", *[(F.lead(c).over(w) - F.col(c)).alias(c) for c in "xyz"]).where(" and ".join(f"{c} is not null" for c in "xyz"))
    return steps.groupBy(key, "t").agg(
        F.count("*").alias("n"), *[F.var_samp(c).alias(f"var_{c}") for c in "xyz"], *[F.covar_samp(*c).alias(f"cov_{c}") for c in ("xy", "xz", "yz")]
    )


def minmax(series: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Adds lo, hi (of the key) and norm in [0, 1], NULL for a constant series."""
    w = Window.partitionBy(key)
    out = series.withColumns({"lo": F.min(column).over(w), "hi": F.max(column).over(w)})
    return out.withColumn("norm", F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")))


def depth_path(series: DataFrame, key: str = "cell_id") -> DataFrame:
    """Adds depth: the key's greatest z minus z."""
    top = series.groupBy(key).agg(F.max("z").alias("_top"))
    return series.join(top, key).withColumn("depth", F.col("_top") - F.col("z")).drop("_top")


def ols(rows: DataFrame, a: str, b: str, v: str, key: str = "cell_id") -> DataFrame:
    """(key, n, slope_a, slope_b, intercept) of v on a and b, in closed form from population covariances; NULL slopes if
    the predictors are collinear."""
    full = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(v).isNotNull())
    s = full.groupBy(key).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{k}") for k, c in (("a", a), ("b", b), ("v", v))],
        *[F.covar_pop(x, y).alias(n) for n, x, y in (("aa", a, a), ("bb", b, b), ("ab", a, b), ("av", a, v), ("bv", b, v))],
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("slope_a", F.try_divide(F.col("av") * F.col("bb") - F.col("bv") * F.col("ab"), det)).withColumn("slope_b", F.try_divide(F.col("bv") * F.col("aa") - F.col("av") * F.col("ab"), det))
    return s.select(key, "n", "slope_a", "slope_b", (F.col("m_v") - F.col("slope_a") * F.col("m_a") - F.col("slope_b") * F.col("m_b")).alias("intercept"))


def zt_correction(series: DataFrame, log: bool = False, key: str = "cell_id") -> DataFrame:
    """Adds fluo_corr: intensity, normalised per spot, times the ratio of the value predicted at depth and time 0 to that
    predicted at its own, and scaled back. With log the model is of log(1 + norm)."""
    rows = minmax(depth_path(series, key), "fluo").withColumn("_v", F.log1p("norm") if log else F.col("norm"))
    fit = ols(rows, "depth", "t", "_v", key)
    both = rows.join(fit, key)
    there = F.col("intercept") + F.col("slope_a") * F.col("depth") + F.col("slope_b") * F.col("t")
    ratio = F.exp("intercept") / F.exp(there) if log else F.try_divide(F.col("intercept"), there)
    return both.withColumn("fluo_corr", F.col("norm") * ratio * (F.col("hi") - F.col("lo")) + F.col("lo")).drop("_v", "n", "slope_a", "slope_b", "intercept")
