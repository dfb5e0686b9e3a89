"""Runs of kept direction: counter, survival by run length, histogram, seeded null models."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_counter(cosines: DataFrame, key: str = "id", least: float = 0.7) -> DataFrame:
    """Adds kept (cosine at least `least`; a missing one is not kept) and c, the place in the run, which starts anew
    after each row that is not kept."""
    w = Window.partitionBy(key).orderBy("t")
    kept = F.coalesce(F.col("cos") >= least, F.lit(False))
    rows = cosines.withColumn("kept", kept)
    no = F.when(F.col("kept"), 0).otherwise(1)
    rows = rows.withColumn("_run", F.sum(no).over(w.rowsBetween(Window.unboundedPreceding, 0)) - no)
    return rows.withColumn("c", F.row_number().over(Window.partitionBy(key, "_run").orderBy("t"))).drop("_run")


def persistence_prob(runs: DataFrame, *keys: str) -> DataFrame:
    """Pooled survivals p1 and breaks b1 by place in the run, and p1 / (p1 + b1), for places that were survived."""
    n = runs.groupBy(*keys, "c").agg(F.count_if("kept").alias("p1"), F.count_if(~F.col("kept")).alias("b1"))
    return n.where("p1 > 0").withColumn("prob", F.col("p1") / (F.col("p1") + F.col("b1")))


def runlength_hist(runs: DataFrame, key: str = "id") -> DataFrame:
    """Density histogram of closed runs' lengths per key: max - 1 equal bins (one at least) from the shortest to the
    longest; if all are equal the range is widened by a half on either side."""
    closed = runs.where(~F.col("kept")).groupBy(key, "c").agg(F.count("*").alias("n"))
    stats = closed.groupBy(key).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("n").alias("total"), F.collect_list(F.struct("c", "n")).alias("lengths"))
    bins = F.greatest(F.lit(1), F.col("hi") - 1)
    flat = F.col("lo") == F.col("hi")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    width = F.when(flat, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")).cast("double"))
    rows = stats.select(key, "total", "lengths", bins.alias("bins"), low.alias("low"), width.alias("width"), F.explode(F.sequence(F.lit(0), bins - 1)).alias("bin"))
    place = lambda x: F.least(F.floor((x["c"] - F.col("low")) / F.col("width") * F.col("bins")), F.col("bins") - 1)
    n = F.aggregate(F.filter("lengths", lambda x: place(x) == F.col("bin")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = rows.withColumn("n", n)
    return rows.select(key, "bin", "n", (F.col("n") / (F.col("total") * F.col("width") / F.col("bins"))).alias("density"))


SIMULATED = "id long, t int, cos double"


def simulate(ids: list[int], n_frames: int, prob: dict[int, float], seed: int = 42) -> tuple[list[tuple], list[tuple]]:
    """Cosines of the uniform and of the persistence null model, ids in order, from one random stream: first all of the
    uniform model, then all of the other. A frame keeps its direction with the probability of its place in the run;
    beyond the last known place it turns."""
    rng = random.Random(seed)
    keep_below, turn_to = math.acos(0.7), 2 * math.pi - math.acos(0.69)
    uniform = [(i, t, math.cos(rng.uniform(0, 2 * math.pi))) for i in ids for t in range(1, n_frames - 1)]
    out, longest = [], max(prob, default=0)
    for i in ids:
        c = 1
        for t in range(1, n_frames - 1):
            p = prob.get(c, 0.0)
            if c <= longest and rng.choices((True, False), weights=(p, 1 - p))[0]:
                angle, c = rng.uniform(0, keep_below), c + 1
            else:
                angle, c = rng.uniform(keep_below, turn_to), 1
            out.append((i, t, math.cos(angle)))
    return uniform, out


def null_models(cosines: DataFrame, prob: DataFrame, n_frames: int | DataFrame, seed: int = 42) -> DataFrame:
    """(cell_id, model, id, t, cos) for each cell: the order of the random stream is part of the meaning, so a cell's
    few spots are simulated in one group; cells run in parallel, each with a stream of its own (cell 0 has the bare seed).
    prob is (c, prob), a row per run length (at most the number of frames); n_frames a number or one row (n_frames)."""
    table = prob.agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), F.col("prob").cast("double")))).alias("table"))
    known = table.withColumn("n_frames", F.lit(n_frames)) if isinstance(n_frames, int) else table.crossJoin(F.broadcast(n_frames.select("n_frames")))

    def run(group):
        import pandas as pd

        cell, ids = int(group["cell_id"].iloc[0]), sorted(int(i) for i in group["id"].unique())
        table, frames = dict(group["table"].iloc[0]), int(group["n_frames"].iloc[0])
        both = zip(("uniform", "t_prob"), simulate(ids, frames, table, seed + 1_000_003 * cell), strict=True)
        return pd.DataFrame([(cell, m, *r) for m, rows in both for r in rows], columns=["cell_id", "model", "id", "t", "cos"])

    rows = cosines.select("cell_id", "id").distinct().crossJoin(F.broadcast(known))  # one row
    return rows.groupBy("cell_id").applyInPandas(run, "cell_id long, model string, id long, t int, cos double")
