"""A log of edits to points: versions are appended, any version's state can be read, and only what edits touched is made anew.

An edit is (id, t, kind, z, y, x): `put` adds the point or moves it, `cut` takes it out. Each version is a folder of the log with its
edits, in the order of `seq`; a version that is appended again replaces itself, so a run after a failed one gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDITS = "id long, t int, kind string, z double, y double, x double, seq long"


def append(edits: DataFrame, log: str, version: int) -> None:
    """Writes a version's edits (columns of EDITS; an unknown kind raises)."""
    known = F.when(F.col("kind").isin("put", "cut"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no such kind of edit: "), F.coalesce("kind", F.lit("NULL")))).cast("string"))
    edits.select("id", "t", known.alias("kind"), *"zyx", "seq").write.mode("overwrite").parquet(f"{log}/version={int(version)}")


def read(spark: SparkSession, log: str) -> DataFrame:
    """All edits with their version; an empty table if there are none yet."""
    schema = f"{EDITS}, version long"
    try:
        return spark.read.schema(schema).parquet(log)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def as_of(points: DataFrame, edits: DataFrame, version: int) -> DataFrame:
    """points (id, t, z, y, x; unique by id and t) as they stand after `version`: of several edits to a point the last one holds."""
    last = F.row_number().over(Window.partitionBy("id", "t").orderBy(F.desc("version"), F.desc("seq")))
    held = edits.where(F.col("version") <= version).withColumn("_n", last).where("_n = 1")
    kept = points.select("id", "t", *"zyx").join(held.select("id", "t"), ["id", "t"], "left_anti")
    return kept.unionByName(held.where("kind = 'put'").select("id", "t", *"zyx"))


def touched(edits: DataFrame, after: int, upto: int, owner: DataFrame, part: str) -> DataFrame:
    """The values of `part` (such as a cell or its bucket) of the points that versions after .. upto edit; owner is (id, part)."""
    return edits.where((F.col("version") > after) & (F.col("version") <= upto)).select("id").distinct().join(owner.select("id", part).distinct(), "id").select(part).distinct()


def refresh(points: DataFrame, edits: DataFrame, after: int, upto: int, owner: DataFrame, part: str, make: Callable[[DataFrame], DataFrame], output: str, most: int = 10_000) -> int:
    """Brings a table of what make() derives from points, partitioned by `part` and right as of version `after`, to version upto: only
    the partitions that edits touched are made and replaced. make takes points with `part` and returns rows with it; a part of which
    no row is left keeps no rows. Returns how many parts were touched; more than `most` raise, as the list reaches the driver."""
    parts = [r[0] for r in touched(edits, after, upto, owner, part).limit(most + 1).collect()]
    if len(parts) > most:
        raise ValueError(f"more than {most} parts are touched: make the table anew")
    if not parts:
        return 0
    mine = owner.where(F.col(part).isin(parts)).select("id", part).distinct()
    ids = mine.select("id")
    state = as_of(points.join(ids, "id", "left_semi"), edits.join(ids, "id", "left_semi"), upto).join(mine, "id")
    fresh = make(state)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(output)
    return len(parts)
