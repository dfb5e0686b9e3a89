"""Text and CSV readers, frame discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import frame_of
from ..model import without_nan


def read_points(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header and a known schema; a glob or list of paths is one table (one file per frame). NaN is read as NULL."""
    return without_nan(spark.read.csv(path, schema=schema, header=True, sep=sep))


def read_exported(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """A detector's export: numbers below a header and some rows of names and units."""
    rows = spark.read.csv(path, header=True, sep=sep)
    return without_junk_rows(rows, columns, columns[0])


def without_junk_rows(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Columns as doubles, without the rows in which `key` is not a number; NaN is NULL."""
    out = without_nan(rows.select(*[F.col(c).try_cast("double").alias(c) for c in columns]))
    return out.where(F.col(key).isNotNull())


def read_texts(spark: SparkSession, path: str, cell_pattern: str = r"id(\d+)") -> DataFrame:
    """Whole text files (cell_id from the file name, text): line numbers are stable only within whole texts."""
    rows = spark.read.text(path, wholetext=True).withColumn("_f", F.col("_metadata.file_name"))
    return rows.select(F.regexp_extract("_f", cell_pattern, 1).try_cast("long").alias("cell_id"), F.col("value").alias("text"))


def discover_frames(files: DataFrame) -> DataFrame:
    """(file_name) -> one row: the greatest frame index and the number of different ones."""
    t = frame_of(F.col("file_name"))
    return files.agg(F.max(t).alias("max_t"), F.count_distinct(t).alias("n"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file_name"))


def read_config(text: str) -> dict:
    """A tracker's JSON: its motion, object and hypothesis models, matrices as lists of numbers."""
    import json

    config = json.loads(text)
    return config.get("TrackerConfig", config)
