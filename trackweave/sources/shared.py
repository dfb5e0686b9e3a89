"""Intermediate tables that all nodes see: written to the folder in spark.checkpoint.dir, which cuts lineage for good."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITTEN: list[str] = []  # folders of intermediate tables that this driver has made


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all runs on one machine (master local), a folder under
    /tmp is set; on a cluster each executor would write to a disk of its own, and rows would be lost, so there it raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"master {master} needs spark.checkpoint.dir, a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints")
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def arrow_uri(uri: str) -> str:
    """uri with a scheme that pyarrow knows: s3a and s3n, which Spark uses, are s3. Others stay."""
    scheme, colon, rest = uri.partition("://")
    return f"s3://{rest}" if colon and scheme.lower() in ("s3a", "s3n") else uri


def clear_intermediate(spark: SparkSession) -> int:
    """Deletes the intermediate tables made so far. Only for when results that read them have been written."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the files outlive any executor. Each call uses a new
    folder, so a repeated query never reads an older one's rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df in tasks of about that many rows, before a step that makes many rows of one. Small rows pack so well that Spark would
    put them all into one task."""
    return df.repartition(-(-df.count() // rows) or 1)


HELD = 250_000  # rows that a task sorts or keeps in a hash table, where their number is known


def tasks(rows: int) -> int:
    """How many tasks hold HELD rows each. Left to itself Spark deals by bytes: small rows pack so well that millions meet in one task."""
    return -(-rows // HELD) or 1


def dealt(held: DataFrame, streamed: DataFrame, on: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by `on`. Few rows of held are left to Spark, as it may broadcast them. More are dealt with streamed to tasks of
    about HELD of them, which keep these in a hash table while streamed passes by unsorted, so its size asks for no memory."""
    if rows <= HELD:
        return held, streamed
    kinds, other = dict(held.dtypes), dict(streamed.dtypes)
    streamed = streamed.withColumns({c: F.col(c).cast("long") for c in on if (kinds[c], other[c]) == ("bigint", "int")})  # unlike keys are dealt twice
    n = max(tasks(rows), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return held.repartition(n, *on).hint("shuffle_hash"), streamed.repartition(n, *on)
