"""Sinks: Parquet for tables that are read again, CSV for people. Neither writes an index column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_table(rows: DataFrame, path: str, by_frame: bool = False) -> None:
    """Parquet; by_frame gives one folder per frame, so that reads of some frames skip the others."""
    if by_frame:
        rows.repartition("t").write.partitionBy("t").mode("overwrite").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_points(points: DataFrame, path: str, sep: str = ",") -> None:
    points.write.mode("overwrite").csv(path, header=True, sep=sep)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; if there is none yet it is made and written first, so interrupted work goes on from there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)
