"""Conversations as series: the words of each turn, gaps filled, smoothed and scaled, as intensities of tracked spots are.

A conversation is a track, a turn is a frame, and the turn's number of words (runs of anything but white space) is its intensity.
Reads (conv_id, turn, role, text) and writes, partitioned by `part` (conv_id modulo `parts`), a row a turn from 0 to the
conversation's last: conv_id, t, present, role, n_rows, words, words_filled (a missing turn becomes the mean of the value before it,
itself filled, and the next known one; leading gaps stay NULL), words_avg (average over t - half_window .. t + half_window of what is
known), scaled (0 to 1 within the conversation; NULL if all its turns are alike) and change (from the turn before; NULL beside gaps).

Rows of one conversation and turn are one turn: their words are summed, `role` is the least; of n_rows rows. A null text counts
no words of its own, and a turn of nothing but null texts is present with NULL words. Rows without a conversation or turn, or with a
turn below 0, are no part of a series and are left out. Averages are rounded to 6 digits. Each run replaces the output as a
whole, so a run after a failed one, or a second one, gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, main
from trackweave.operators import spine, stats

DEFAULTS = {"parts": 16, "half_window": 2}
SERIES = "conv_id long, t int, present boolean, role string, n_rows long, words double, words_filled double, words_avg double, scaled double, change double, part int"
WORD = r"[^\x20\x09-\x0D]+"


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (id, t, role, n_rows, words), a row a turn."""
    r = rows.select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("int").alias("t"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(WORD))
    return r.where("id is not null and t >= 0").groupBy("id", "t").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n_rows"), F.sum(n).cast("double").alias("words"))


def series(found: DataFrame, config: dict) -> DataFrame:
    found = found.withColumn("last", F.max("t").over(Window.partitionBy("id")) + 1)
    dense = spine.densify(found, "id", "last").withColumn("words_filled", F.col("words"))
    dense = stats.minmax(spine.moving_avg(spine.gapfill_midpoint(dense, ["words_filled"], ["id"], wrap=False), ["words"], ["id"], config["half_window"]), "words")
    change = F.col("words") - F.lag("words").over(Window.partitionBy("id").orderBy("t"))
    r6 = lambda c: F.round(c, 6)
    return dense.select(
        F.col("id").alias("conv_id"), "t", "present", "role", "n_rows", "words", r6("words_filled").alias("words_filled"), r6("words_avg").alias("words_avg"),
        r6("norm").alias("scaled"), change.alias("change"), F.pmod("id", F.lit(config["parts"])).cast("int").alias("part"),
    )


def output_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SERIES).parquet(output)


def run(spark: SparkSession, config: dict, conversations: str, output: str) -> dict:
    """Returns the numbers of turns read and rows written."""
    rows = spark.read.parquet(conversations)
    series(turns(rows), config).write.mode("overwrite").partitionBy("part").parquet(output)
    read, written = rows.count(), output_of(spark, output).count()  # from the files' footers
    log.info("read %d rows from %s, wrote %d rows to %s", read, conversations, written, output)
    return {"read": read, "written": written}


if __name__ == "__main__":
    main(__doc__, {"conversations": "Parquet table of turns", "output": "folder of the series"}, DEFAULTS, run)
