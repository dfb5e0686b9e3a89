"""The three ways through the operators: from volumes to labelled tracks, from tracks to curated ones, and analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Scale
from ..operators import curation, kinematics, linking, persistence, spatial, spine, stats, voxel


def volumes_to_tracks(voxels: DataFrame, movie: int = 0, max_dist: float = 40.0, scale: Scale = Scale(), model: Callable[[DataFrame], DataFrame] = voxel.segment) -> dict[str, DataFrame]:
    """Voxels (t, z, y, x, value) -> labels by `model`, objects, tracks, and labels renamed to track ids."""
    labels = model(voxels).join(voxels.select("t", "z", "y", "x", "value"), ["t", "z", "y", "x"])
    objects = voxel.label_centroids(labels, scale)
    points = objects.select(F.lit(movie).alias("movie"), "t", F.col("label").alias("id"), "x", "y", "z")
    linked = linking.link_frames(points, "movie", max_dist)
    tracks = linked.join(points, ["movie", "t", "id"]).select(F.col("track").alias("id"), "t", "z", "y", "x", F.col("id").alias("label"))
    renamed = labels.join(tracks.select("t", "label", F.col("id").alias("track_id")), ["t", "label"]).select("t", "z", "y", "x", "track_id")
    return {"labels": labels, "objects": objects, "tracks": tracks, "track_labels": renamed}


def select_and_curate(points: DataFrame, nuclei: DataFrame, candidates: DataFrame, edits: DataFrame, mains: list[int], radius: float = 10.0, top_tp: int = 349, backfill: bool = False) -> dict[str, DataFrame]:
    """Spots near the chosen nucleus, and the tracks after the curation script; merged follows spots into others."""
    chosen = spatial.by_priority(candidates, nuclei)
    near = spatial.select_spots(points, nuclei, candidates, points.select("t").distinct(), radius, backfill)
    selected = points.join(near.select("t", "id"), ["t", "id"], "left_semi")
    numbered = curation.numbered(curation.intervals(curation.parse(edits), top_tp), mains)
    return {"reference": chosen, "selected": selected, "curated": curation.apply(numbered, points), "merged": curation.apply(numbered, points, merged=True)}


def analytics(series: DataFrame, reference: DataFrame, log: bool = False) -> dict[str, DataFrame]:
    """series (id, cell_id, t, x, y, z, fluo, ...) and the reference nucleus (cell_id, t, x, y, z) -> the datasets behind
    every plot: dense series (registered, averaged, intensity-corrected), speed, directions in three coordinate systems,
    persistence, correlations, pair distances. Datasets are lazy; only those that are used are computed."""
    n = spine.frames(series)
    ref = spine.densify(reference, "cell_id", n)
    for c in "xyz":
        ref = ref.withColumn(c, spine.last_known(F.col(c), ["cell_id"]))
    registered = spatial.register(series, ref, ["cell_id", "t"])
    dense = spine.moving_avg(spine.densify(registered, "id", n, same=("cell_id",)), ["x", "y", "z"], ["id"])
    out = {"dense": dense, "corrected": stats.zt_correction(series, log), "speed": kinematics.speed(dense), "pairs": spatial.pairwise_distance(series)}
    for name, coords in {"raw": ("x", "y", "z"), "reg": ("x_reg", "y_reg", "z_reg"), "avg": ("x_avg", "y_avg", "z_avg")}.items():
        moves = kinematics.directions(dense, "id", coords)
        runs = persistence.run_counter(moves.where("inner"))
        out |= {f"directions_{name}": moves, f"persistence_{name}": persistence.persistence_prob(runs), f"run_lengths_{name}": persistence.runlength_hist(runs), f"corr_angle_{name}": stats.correlation(moves.where("inner"), ["angle"]), f"corr_coords_{name}": stats.correlation(dense, list(coords))}
    return out | {"corr_fluo": stats.correlation(dense, ["fluo"])}
