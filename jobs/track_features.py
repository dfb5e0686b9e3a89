"""Features of spot tracks, kept up to date as detections arrive.

Reads a folder (or file, or pattern) of detections (event_id, ts, user_id, value) as a file stream: each run takes the files that no run before it has
taken, in batches of `files_per_batch`, and ends. A detection is a spot of a cell in a frame: a frame lasts frame_seconds from
`origin` on, `spots_per_cell` spots make a cell, and places come from the values. A batch's detections are written beside the
checkpoint, one folder a batch; then the features of the buckets of cells that the batch touches are made anew from all
detections of these buckets, and only their partitions of the output are replaced. Other partitions are not read or written.

Output, partitioned by bucket, a row a spot and frame from 0 to the cell's last: cell_id, id, t, present, x, y, z (NULL in gaps),
x_avg, y_avg, z_avg (average over t - half_window .. t + half_window), norm (step to this frame), angle (over pi, of this step and the
next), kept (cosine of the two at least least_cosine) and place (in the run of kept directions); the last four are NULL where
the spot's step has no cosine or the frame is its first or last. Places and their averages are rounded to 8 digits
(places before use to 9), the others to 6, as sums' last bits vary.

A run that dies in a batch is repeated with the same files: the batch's folder and the partitions are written over, so nothing
counts twice. Detections delivered more than once count once. Files must not change once they are there. Detections with a missing
id, time, spot or value, or from before `origin`, have no place and are left out; several of a spot in one frame are
averaged. Without input files nothing is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from trackweave.operators import kinematics, persistence, spine

DEFAULTS = {"origin": "2024-01-01 00:00:00", "frame_seconds": 21600, "spots_per_cell": 12, "buckets": 16, "half_window": 2, "least_cosine": 0.7, "files_per_batch": 1000}
DETECTIONS = "event_id long, cell_id long, id long, t int, x double, y double, z double, batch int, bucket int"
FEATURES = "cell_id long, id long, t int, present boolean, x double, y double, z double, x_avg double, y_avg double, z_avg double, norm double, angle double, kept boolean, place int, bucket int"


def detections(events: DataFrame, config: dict) -> DataFrame:
    """Events -> (event_id, cell_id, id, t, x, y, z, bucket)."""
    e = events.select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("id"), F.col("value").cast("double").alias("x"))
    days = F.date_diff(F.to_date("ts"), F.to_date(F.lit(config["origin"])))
    seconds = days.cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    start = F.lit(config["origin"]).cast("timestamp_ntz")
    seconds = seconds - (F.hour(start) * 3600 + F.minute(start) * 60 + F.second(start))
    e = e.dropna().withColumns({"s": seconds, "cell_id": F.floor(F.col("id") / float(config["spots_per_cell"])).cast("long")}).where("s >= 0")
    return e.select(
        "event_id", "cell_id", "id", F.floor(F.col("s") / config["frame_seconds"]).cast("int").alias("t"),
        "x", (F.col("x") * 0.5 + F.pmod("event_id", F.lit(17))).alias("y"), F.pmod("event_id", F.lit(29)).cast("double").alias("z"),
        F.pmod("cell_id", F.lit(config["buckets"])).cast("int").alias("bucket"),
    )


def features(found: DataFrame, config: dict) -> DataFrame:
    """Detections of whole cells -> the output's columns."""
    r6 = lambda c: F.round(c, 6)
    points = found.dropDuplicates(["event_id", "id", "t", *"xyz"]).groupBy("cell_id", "id", "t").agg(*[F.round(F.avg(c), 9).alias(c) for c in "xyz"])
    last = points.groupBy("cell_id").agg((F.max("t") + 1).alias("n_frames"))
    dense = spine.moving_avg(spine.densify(points, "id", last, same=("cell_id",)), [*"xyz"], ["id"], config["half_window"])
    runs = persistence.run_counter(kinematics.directions(dense), least=config["least_cosine"])  # first and last frames have no cosine, so they only end runs
    inner = lambda c: F.when(F.col("inner") & F.col("cos").isNotNull(), F.col(c))
    return runs.select(
        "cell_id", "id", "t", "present", *[F.round(c, 8).alias(c) for c in "xyz"], *[F.round(f"{c}_avg", 8).alias(f"{c}_avg") for c in "xyz"], r6(inner("norm")).alias("norm"), r6(inner("angle")).alias("angle"),
        inner("kept").alias("kept"), inner("c").cast("int").alias("place"), F.pmod("cell_id", F.lit(config["buckets"])).cast("int").alias("bucket"),
    )


def pattern(path: str) -> str:
    """A file stream reads a folder or what a pattern matches: as a pattern, a path may also be that of a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def output_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(FEATURES).parquet(output)


def run(spark: SparkSession, config: dict, events: str, output: str, checkpoint: str) -> dict:
    """Takes the new files of `events`; returns the numbers of batches, detections taken and rows written."""
    done = {"batches": 0, "read": 0, "written": 0}
    taken = f"{checkpoint}/detections"

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        own = f"{taken}/batch={number}"
        detections(batch, config).write.mode("overwrite").partitionBy("bucket").parquet(own)
        known = here.read.schema(DETECTIONS).parquet(taken)
        new = known.where(F.col("batch") == number)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # config["buckets"] at most
        if touched:
            fresh = features(known.where(F.col("bucket").isin(touched)), config)
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(output)
        n, m = new.count(), output_of(here, output).where(F.col("bucket").isin(touched)).count()  # from the files' footers
        log.info("batch %d: read %d detections from %s, wrote %d rows in %d buckets to %s", number, n, events, m, len(touched), output)
        done.update(batches=done["batches"] + 1, read=done["read"] + n, written=done["written"] + m)

    spark.createDataFrame([], FEATURES).write.mode("append").partitionBy("bucket").parquet(output)  # so that there is an output to read
    schema = spark.read.parquet(events).select("event_id", "ts", "user_id", "value").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern(events))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start().awaitTermination()
    log.info("took %(batches)d new batches: read %(read)d detections, wrote %(written)d rows", done)
    return done


if __name__ == "__main__":
    main(__doc__, {"events": "folder of Parquet files with detections", "output": "folder of the features", "checkpoint": "folder of what has been taken"}, DEFAULTS, run)
