"""One query per operator over the fixtures, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import Scale
from ..operators import aggregates as A
from ..operators import curation as C
from ..operators import hypotheses as H
from ..operators import kinematics as K
from ..operators import linking as L
from ..operators import persistence as P
from ..operators import spatial as J
from ..operators import edits as edit_log
from ..operators import resample, spine, stats, suppression, tables, tracking, voxel, watershed
from ..sources import blocks, readers, shared, volumes, writers
from ..streaming import frames, linker
from . import fixtures as fx
from .fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SCALE = Scale()


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn

    return register


def r6(c) -> object:
    return F.round(c, 6)


def dense(spark, d) -> DataFrame:
    return spine.densify(fx.traj(spark, d), "id", spine.frames(fx.traj(spark, d)), same=("cell_id",))


def kin(spark, d) -> DataFrame:
    return K.directions(dense(spark, d))


# ---- files: written, listed and read again ----


def own_folder(spark, name: str) -> str:
    folder = f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    shared.WRITTEN.append(folder)
    return folder


@query(with_views("SELECT t, z, y, x, value FROM fx_voxel", "fx_voxel"))
def volume_tiff_round_trip(spark, d):
    folder = own_folder(spark, "tiff")
    volumes.write_volumes(fx.voxel(spark, d), folder)
    return volumes.read_volumes(spark, folder).select("t", *"zyx", "value")


@query(with_views("SELECT t, z, y, x, label FROM fx_label WHERE label <> 0", "fx_label"))
def label_npy_round_trip(spark, d):
    folder = own_folder(spark, "npy")
    volumes.write_volumes(fx.label(spark, d).withColumn("value", F.col("label")), folder, kind="npy")
    return volumes.read_volumes(spark, folder, foreground=True).select("t", *"zyx", F.col("value").alias("label"))


@query(with_views("SELECT id, t, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM fx_traj", "fx_traj"))
def points_csv_round_trip(spark, d):
    folder = own_folder(spark, "csv")
    writers.write_points(fx.traj(spark, d).select("id", "t", *"xyz"), folder)
    return spark.read.csv(folder, header=True, schema="id long, t int, x double, y double, z double").select("id", "t", *[r6(c).alias(c) for c in "xyz"])


@query(with_views("SELECT id, t, round(x, 6) AS x FROM fx_traj WHERE t = 3", "fx_traj"))
def table_by_frame_round_trip(spark, d):
    folder = own_folder(spark, "frames")
    writers.write_table(fx.traj(spark, d).select("id", "t", "x"), folder, by_frame=True)
    return spark.read.parquet(folder).where("t = 3").select("id", "t", r6("x").alias("x"))


# ---- scans, filters, projections ----


@query(with_views("SELECT id, t, z, y, x FROM fx_traj", "fx_traj"))
def scan_project(spark, d):
    return tables.project(fx.traj(spark, d))


@query(with_views("SELECT t, count(*) AS n, round(sum(x), 6) AS sum_x FROM fx_traj WHERE t IN (0, 1, 2) GROUP BY t", "fx_traj"))
def scan_union_frames(spark, d):
    p = fx.traj(spark, d)
    return tables.union_frames(*[tables.at_frame(p, t) for t in range(3)]).groupBy("t").agg(F.count("*").alias("n"), r6(F.sum("x")).alias("sum_x"))


@query(with_views("SELECT id, t, round(x, 6) AS x FROM fx_traj", "fx_traj"))
def csv_header_rows(spark, d):
    """An export with two more header rows below the names in every file."""
    folder, text = own_folder(spark, "export"), fx.traj(spark, d).select(*[F.col(c).cast("string").alias(c) for c in ("t", "id", "x")])
    junk = text.limit(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("t", "id", "x"), row, strict=True)]) for row in (("T", "ID", "X"), ("(sec)", "", "(micron)"))])).alias("j")).select("j.*")
    junk.unionByName(text).write.csv(folder, header=True)
    return readers.read_exported(spark, folder, ["t", "id", "x"]).select(F.col("id").cast("long").alias("id"), F.col("t").cast("int").alias("t"), r6("x").alias("x"))


@query(with_views("SELECT id, t, x, y, z FROM fx_traj WHERE t = 5", "fx_traj"))
def filter_frame(spark, d):
    return tables.at_frame(fx.traj(spark, d), 5).select("id", "t", *"xyz")


@query(with_views("SELECT id, t, x FROM fx_traj WHERE id = 3 AND t = 7", "fx_traj"))
def filter_id_frame(spark, d):
    return tables.of_id_at_frame(fx.traj(spark, d), 3, 7).select("id", "t", "x")


@query(with_views("SELECT id, t, nuc_id FROM fx_traj WHERE nuc_id IS NOT NULL", "fx_traj"))
def filter_notnull(spark, d):
    return tables.known(fx.traj(spark, d), "nuc_id").select("id", "t", "nuc_id")


@query(with_views("SELECT id, t, CAST(trunc(z / 0.75) AS INT) AS zv, CAST(trunc(y / 0.173) AS INT) AS yv, round(x * 0.173, 6) AS xm FROM fx_traj", "fx_traj"))
def unit_convert(spark, d):
    p = fx.traj(spark, d)
    return tables.to_voxels(p.withColumn("xm", r6(F.col("x") * SCALE.x))).select("id", "t", F.col("z").alias("zv"), F.col("y").alias("yv"), "xm")


@query(with_views("SELECT id, t, CAST(0 AS DOUBLE) AS z, y, x FROM fx_traj", "fx_traj"))
def project_dims(spark, d):
    return tables.project(fx.traj(spark, d), two_d=True)


@query(with_views("SELECT id, t, CASE WHEN nuc_id > 2 THEN 2 ELSE nuc_id END AS nuc_id FROM fx_traj", "fx_traj"))
def clamp_counts(spark, d):
    return tables.clamp(fx.traj(spark, d), "nuc_id", 2).select("id", "t", "nuc_id")


@query(with_views("SELECT id, t, x FROM fx_traj ORDER BY t, id", "fx_traj"))
def sort_tracks(spark, d):
    return tables.sort_tracks(fx.traj(spark, d)).select("id", "t", "x")


@query(with_views("SELECT id, t, x FROM fx_traj WHERE t < 3 UNION ALL SELECT id, t, x FROM fx_traj WHERE t > 80", "fx_traj"))
def union_frames(spark, d):
    p = fx.traj(spark, d).select("id", "t", "x")
    return tables.union_frames(p.where("t < 3"), p.where("t > 80"))


@query(with_views("SELECT DISTINCT id FROM fx_traj", "fx_traj"))
def distinct_ids(spark, d):
    return fx.traj(spark, d).select("id").distinct()


@query(with_views("SELECT id, t, z, y, x FROM fx_traj WHERE NOT (t = 0 AND id % 2 = 0) UNION ALL SELECT id + 1000000, t, z, y, x FROM fx_traj WHERE t = 1", "fx_traj"))
def apply_point_edits(spark, d):
    p = fx.traj(spark, d).select("id", "t", "z", "y", "x")
    return tables.apply_point_edits(p, p.where("t = 0 and id % 2 = 0"), p.where("t = 1").withColumn("id", F.col("id") + 1000000))


@query(with_views("SELECT max(t) AS max_t, count(DISTINCT t) AS n FROM fx_voxel WHERE t % 3 > 0", "fx_voxel"))
def frame_discovery(spark, d):
    folder = own_folder(spark, "discovery")
    volumes.write_volumes(fx.voxel(spark, d).where("t % 3 > 0"), folder)
    return readers.discover_frames(readers.list_files(spark, folder))


# ---- dense series ----


@query(with_views("SELECT id, cell_id, t, x, y, z, fluo, nuc_id, dist_nuc FROM dense", "dense"))
def densify_series(spark, d):
    return dense(spark, d).drop("present")


@query(with_views("SELECT id, t FROM dense WHERE x IS NULL", "dense"))
def missing_frames(spark, d):
    return spine.missing_frames(fx.traj(spark, d))


@query(with_views("SELECT id, t, round(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)), 6) AS speed FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM dense WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE t >= 1", "dense"))
def spot_speed(spark, d):
    return K.speed(dense(spark, d)).select("id", "t", r6("speed").alias("speed"))


@query(with_views("SELECT id, t, round((x*px+y*py+z*pz)/nullif(sqrt(x*x+y*y+z*z)*sqrt(px*px+py*py+pz*pz), 0), 6) AS cos_pos FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM dense WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE t >= 1", "dense"))
def cosine_position(spark, d):
    return K.cosine_position(dense(spark, d)).select("id", "t", r6("cos_pos").alias("cos_pos"))


@query(with_views("SELECT id, t, round(cos, 6) AS cos FROM angles WHERE inside", "angles"))
def direction_cosine(spark, d):
    return K.cosines(dense(spark, d)).select("id", "t", r6("cos").alias("cos"))


@query(with_views("SELECT id, t, round(angle, 6) AS angle FROM angles WHERE inside", "angles"))
def direction_angle(spark, d):
    return K.cosines(dense(spark, d)).select("id", "t", r6("angle").alias("angle"))


@query(with_views("SELECT id, t, round(norm, 6) AS norm FROM angles WHERE t >= 1", "angles"))
def direction_norm(spark, d):
    return kin(spark, d).where("t >= 1").select("id", "t", r6("norm").alias("norm"))


NUC_DENSE = (("centre", "SELECT nuc_id AS id, t, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM fx_traj WHERE nuc_id IS NOT NULL GROUP BY 1, 2"),
             ("nd", "SELECT i.id, s.t, c.x, c.y, c.z FROM (SELECT DISTINCT id FROM centre) i CROSS JOIN spine s LEFT JOIN centre c ON c.id = i.id AND c.t = s.t"),
             ("ns", "SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey, lead(z) OVER w - z AS ez, lead(t) OVER w AS tn FROM nd WINDOW w AS (PARTITION BY id ORDER BY t)"))


@query(with_views("SELECT id, t, round((dx*ex+dy*ey+dz*ez) / nullif(sqrt(dx*dx+dy*dy+dz*dz)*sqrt(ex*ex+ey*ey+ez*ez), 0), 6) AS cos FROM ns WHERE t >= 1 AND tn IS NOT NULL", "spine", extra=NUC_DENSE))
def nucleus_direction_cosine(spark, d):
    p = fx.traj(spark, d)
    centre = A.cell_centre(p.where("nuc_id is not null"), "nuc_id").withColumnRenamed("nuc_id", "id")
    return K.cosines(spine.densify(centre, "id", spine.frames(p))).select("id", "t", r6("cos").alias("cos"))


@query(with_views("SELECT id, t, round(avg(x) OVER w, 6) AS x_avg, round(avg(y) OVER w, 6) AS y_avg, round(avg(z) OVER w, 6) AS z_avg FROM dense WINDOW w AS (PARTITION BY id ORDER BY t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "dense"))
def moving_avg(spark, d):
    return spine.moving_avg(dense(spark, d), ["x", "y", "z"], ["id"]).select("id", "t", *[r6(f"{c}_avg").alias(f"{c}_avg") for c in "xyz"])


@query(with_views("SELECT id, t, round(v - nv, 6) AS diff FROM (SELECT id, t, fluo AS v, lead(fluo) OVER w AS nv, lead(t) OVER w AS tn FROM dense WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE tn IS NOT NULL", "dense"))
def fluo_diff(spark, d):
    return K.difference(dense(spark, d), "fluo", "diff").select("id", "t", r6(-F.col("diff")).alias("diff"))


D1 = ("d1", "SELECT id, t, lead(cos) OVER w - cos AS v, lead(t) OVER w AS tn FROM (SELECT * FROM angles WHERE inside) WINDOW w AS (PARTITION BY id ORDER BY t)")


@query(with_views("SELECT id, t, round(v, 6) AS diff1 FROM d1 WHERE tn IS NOT NULL", "angles", extra=(D1,)))
def cosine_diff1(spark, d):
    return K.difference(K.cosines(dense(spark, d)), "cos", "v").select("id", "t", r6("v").alias("diff1"))


@query(with_views("SELECT id, t, round(nv - v, 6) AS diff2 FROM (SELECT id, t, v, lead(v) OVER w AS nv, lead(t) OVER w AS t2 FROM (SELECT * FROM d1 WHERE tn IS NOT NULL) WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE t2 IS NOT NULL", "angles", extra=(D1,)))
def cosine_diff2(spark, d):
    first = K.difference(K.cosines(dense(spark, d)), "cos", "v").select("id", "t", "v")
    return K.difference(first, "v", "diff2").select("id", "t", r6("diff2").alias("diff2"))


@query(with_views("SELECT id, t, kept, CAST(c AS INT) AS c FROM runs", "runs"))
def run_counter(spark, d):
    return P.run_counter(K.cosines(dense(spark, d))).select("id", "t", "kept", "c")


@query(with_views("SELECT CAST(c AS INT) AS c, p1, b1, round(p1 / (p1 + b1), 6) AS prob FROM (SELECT c, count(*) FILTER (WHERE kept) AS p1, count(*) FILTER (WHERE NOT kept) AS b1 FROM runs GROUP BY c) WHERE p1 > 0", "runs"))
def persistence_prob(spark, d):
    return P.persistence_prob(P.run_counter(K.cosines(dense(spark, d)))).select("c", "p1", "b1", r6("prob").alias("prob"))


HIST = (("cl", "SELECT id, CAST(c AS DOUBLE) AS c FROM runs WHERE NOT kept"),
        ("st", "SELECT id, min(c) AS lo, max(c) AS hi, count(*) AS total, greatest(1, CAST(max(c) AS BIGINT) - 1) AS nb FROM cl GROUP BY id"),
        ("rg", "SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS low, CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END AS width FROM st"),
        ("bn", "SELECT *, unnest(generate_series(0, nb - 1)) AS bin FROM rg"),
        ("pl", "SELECT cl.id, least(CAST(floor((c - low) / width * nb) AS BIGINT), nb - 1) AS bin FROM cl JOIN rg ON cl.id = rg.id"),
        ("ct", "SELECT id, bin, count(*) AS n FROM pl GROUP BY id, bin"))


@query(with_views("SELECT bn.id, CAST(bn.bin AS INT) AS bin, coalesce(ct.n, 0) AS n, round(coalesce(ct.n, 0) / (total * width / nb), 6) AS density FROM bn LEFT JOIN ct ON bn.id = ct.id AND bn.bin = ct.bin", "runs", extra=HIST))
def runlength_hist(spark, d):
    return P.runlength_hist(P.run_counter(K.cosines(dense(spark, d)))).select("id", "bin", "n", r6("density").alias("density"))


# ---- counts ----

COUNTS = (("cnt", "SELECT c.cell_id, s.t, count(f.id) AS n FROM (SELECT DISTINCT cell_id FROM fx_traj) c CROSS JOIN spine s LEFT JOIN fx_traj f ON f.cell_id = c.cell_id AND f.t = s.t GROUP BY 1, 2"),)


def frame_counts(spark, d):
    p = fx.traj(spark, d)
    return A.per_frame(p, spine.frames(p))


@query(with_views("SELECT * FROM cnt", "spine", extra=COUNTS))
def spots_per_frame(spark, d):
    return frame_counts(spark, d)


NEAR = (*COUNTS, ("nr", "SELECT a.cell_id, a.t, a.n, b.n AS v FROM cnt a LEFT JOIN cnt b ON a.cell_id = b.cell_id AND abs(a.t - b.t) <= 2 AND b.t < (SELECT max(t) FROM spine)"),
        ("vt", "SELECT cell_id, t, v, count(*) AS c FROM nr WHERE v IS NOT NULL GROUP BY 1, 2, 3"),
        ("tp", "SELECT cell_id, t, max(c) AS c FROM vt GROUP BY 1, 2"),
        ("md", "SELECT vt.cell_id, vt.t, min(v) AS m FROM vt JOIN tp ON vt.cell_id = tp.cell_id AND vt.t = tp.t AND vt.c = tp.c GROUP BY 1, 2"))


@query(with_views("SELECT nr.cell_id, nr.t, any_value(nr.n) AS n, CASE WHEN any_value(tp.c) > 1 THEN CAST(any_value(md.m) AS DOUBLE) ELSE CAST(median(nr.v) AS DOUBLE) END AS n_smooth FROM nr LEFT JOIN tp ON nr.cell_id = tp.cell_id AND nr.t = tp.t LEFT JOIN md ON nr.cell_id = md.cell_id AND nr.t = md.t GROUP BY 1, 2", "spine", extra=NEAR))
def smooth_counts(spark, d):
    return spine.smooth_counts(frame_counts(spark, d), ["cell_id"]).select("cell_id", "t", "n", "n_smooth")


WHOLE_CENTRE = (("centre", "SELECT cell_id, t, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM fx_traj WHERE nuc_id = 1 GROUP BY 1, 2"),
                ("cd", "SELECT c.cell_id, s.t, m.x FROM (SELECT DISTINCT cell_id FROM centre) c CROSS JOIN spine s LEFT JOIN centre m ON m.cell_id = c.cell_id AND m.t = s.t"))


def whole_centres(spark, d):
    p = fx.traj(spark, d)
    return spine.densify(A.cell_centre(p.where("nuc_id = 1")), "cell_id", spine.frames(p))


@query(with_views("""SELECT cell_id, t, round(CASE WHEN x IS NOT NULL THEN x ELSE nx + (coalesce(px, lx) - nx) / power(2.0, t - coalesce(pt, -1)) END, 6) AS x
FROM (SELECT *, last_value(x IGNORE NULLS) OVER b AS px, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(x IGNORE NULLS) OVER a AS nx, last_value(x IGNORE NULLS) OVER al AS lx
FROM cd WINDOW b AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
al AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""", "spine", extra=WHOLE_CENTRE))
def gapfill_midpoint_all_cells(spark, d):
    return spine.gapfill_midpoint(whole_centres(spark, d), ["x"], ["cell_id"]).select("cell_id", "t", r6("x").alias("x"))


@query(with_views("SELECT cell_id, t, round(last_value(x IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS x FROM cd", "spine", extra=WHOLE_CENTRE))
def ffill_reference_all_cells(spark, d):
    return whole_centres(spark, d).select("cell_id", "t", r6(spine.last_known(F.col("x"), ["cell_id"])).alias("x"))


NN = (("nn", "SELECT s.t, s.id, n.id AS nuc_id, sqrt((s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y)+(s.z-n.z)*(s.z-n.z)) AS dist FROM fx_point s LEFT JOIN fx_point n ON s.t = n.t AND n.kind = 'nucleus' WHERE s.kind = 'spot'"),
      ("best", "SELECT t, id, nuc_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY t, id ORDER BY dist NULLS LAST, nuc_id) AS k FROM nn) WHERE k = 1"))


def spots(spark, d):
    return fx.point(spark, d).where("kind = 'spot'").drop("kind")


def nuclei(spark, d):
    return fx.point(spark, d).where("kind = 'nucleus'").drop("kind")


def assigned(spark, d):
    return J.nearest(spots(spark, d), nuclei(spark, d).withColumnRenamed("id", "target_id"))


@query(with_views("SELECT t, id, nuc_id, round(dist, 6) AS dist FROM best", "fx_point", extra=NN))
def nn_spot_nucleus(spark, d):
    return assigned(spark, d).select("t", "id", "nuc_id", r6("dist").alias("dist"))


@query(with_views("SELECT n.t, n.id AS nuc_id, count(b.id) AS n FROM fx_point n LEFT JOIN best b ON b.t = n.t AND b.nuc_id = n.id WHERE n.kind = 'nucleus' GROUP BY 1, 2", "fx_point", extra=NN))
def spots_per_nucleus_zero(spark, d):
    return A.per_nucleus_zero(nuclei(spark, d), assigned(spark, d))


@query(with_views("SELECT t, nuc_id, string_agg(CAST(CAST(round(dist * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY dist) AS dists FROM best WHERE nuc_id IS NOT NULL GROUP BY 1, 2", "fx_point", extra=NN))
def dist_list_per_nucleus(spark, d):
    rows = A.distances_per_nucleus(assigned(spark, d))
    return rows.select("t", "nuc_id", F.array_join(F.transform("dists", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("dists"))


@query(with_views("SELECT t, round(avg(n), 6) AS mean_spots FROM (SELECT n.t, n.id, count(b.id) AS n FROM fx_point n LEFT JOIN best b ON b.t = n.t AND b.nuc_id = n.id WHERE n.kind = 'nucleus' GROUP BY 1, 2) GROUP BY t", "fx_point", extra=NN))
def mean_spots_per_nucleus(spark, d):
    return A.per_nucleus_zero(nuclei(spark, d), assigned(spark, d)).groupBy("t").agg(r6(F.avg("n")).alias("mean_spots"))


@query(with_views("SELECT t, round(avg(dist), 6) AS mean_dist FROM best GROUP BY t", "fx_point", extra=NN))
def mean_dist_per_frame(spark, d):
    return assigned(spark, d).groupBy("t").agg(r6(F.avg("dist")).alias("mean_dist"))


@query(with_views("SELECT cell_id, t, count(DISTINCT nuc_id) + max(CASE WHEN nuc_id IS NULL THEN 1 ELSE 0 END) AS n FROM fx_traj GROUP BY 1, 2", "fx_traj"))
def distinct_nuclei(spark, d):
    return fx.traj(spark, d).groupBy("cell_id", "t").agg(A.distinct_nuclei().alias("n"))


@query(with_views("SELECT cell_id, t, nuc_id, CASE WHEN nuc_id IS NULL THEN 0 ELSE count(*) END AS n FROM fx_traj GROUP BY 1, 2, 3", "fx_traj"))
def spots_per_nucleus(spark, d):
    return A.per_nucleus(fx.traj(spark, d))


@query(with_views("SELECT cell_id, t, round(avg(dist_nuc), 6) AS mean_dist FROM fx_traj GROUP BY 1, 2", "fx_traj"))
def mean_dist_nuc(spark, d):
    return fx.traj(spark, d).groupBy("cell_id", "t").agg(r6(F.avg("dist_nuc")).alias("mean_dist"))


@query(with_views("SELECT c.cell_id, c.t, round(c.n / nullif(k.n, 0), 6) AS ratio FROM cnt c LEFT JOIN (SELECT cell_id, t, count(DISTINCT nuc_id) + max(CASE WHEN nuc_id IS NULL THEN 1 ELSE 0 END) AS n FROM fx_traj GROUP BY 1, 2) k ON k.cell_id = c.cell_id AND k.t = c.t", "spine", extra=COUNTS))
def spots_nuclei_ratio(spark, d):
    p = fx.traj(spark, d)
    both = p.groupBy("cell_id", "t").agg(F.count("*").alias("n"), A.distinct_nuclei().alias("k"))
    return spine.densify(both, "cell_id", spine.frames(p)).select("cell_id", "t", r6(F.try_divide(F.coalesce("n", F.lit(0)), "k")).alias("ratio"))


@query(with_views("SELECT cell_id, t, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM fx_traj GROUP BY 1, 2", "fx_traj"))
def cell_centre(spark, d):
    return A.cell_centre(fx.traj(spark, d)).select("cell_id", "t", *[r6(c).alias(c) for c in "xyz"])


POSITIONS = (*NN, ("ns", "SELECT b.t, b.nuc_id, any_value(n.x) AS x, count(*) AS n FROM best b JOIN fx_point n ON n.t = b.t AND n.id = b.nuc_id GROUP BY 1, 2"),
             ("rk", "SELECT *, row_number() OVER (PARTITION BY t ORDER BY x, nuc_id) AS u, row_number() OVER (PARTITION BY t ORDER BY x DESC, nuc_id) AS v FROM ns"),
             ("ps", "SELECT t, CASE WHEN u = 1 THEN 'left' WHEN v = 1 THEN 'right' ELSE 'middle' END AS position, min(nuc_id) AS label, CAST(sum(n) AS BIGINT) AS n FROM rk GROUP BY 1, 2"))


def positions(spark, d):
    n = assigned(spark, d).where("nuc_id is not null").groupBy("t", "nuc_id").agg(F.count("*").alias("n"), F.collect_list("id").alias("spots"))
    return A.nucleus_positions(n.join(nuclei(spark, d).select("t", F.col("id").alias("nuc_id"), "x"), ["t", "nuc_id"]))


@query(with_views("SELECT * FROM ps", "fx_point", extra=POSITIONS))
def nucleus_rank_position(spark, d):
    return positions(spark, d).drop("spots")


@query(with_views("SELECT ps.t, ps.position, any_value(ps.label) AS label, count(*) AS n, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS spots FROM ps JOIN rk ON rk.t = ps.t AND ps.position = CASE WHEN u = 1 THEN 'left' WHEN v = 1 THEN 'right' ELSE 'middle' END JOIN best b ON b.t = rk.t AND b.nuc_id = rk.nuc_id GROUP BY 1, 2", "fx_point", extra=POSITIONS))
def nucleus_rank_spots(spark, d):
    return positions(spark, d).withColumn("spots", F.array_join(F.transform("spots", lambda i: i.cast("string")), ","))


@query(with_views("SELECT s.t, p.position, coalesce(ps.n, 0) AS n FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(t) FROM fx_point))) AS INT) AS t) s CROSS JOIN (VALUES ('left'), ('middle'), ('right')) p(position) LEFT JOIN ps ON ps.t = s.t AND ps.position = p.position", "fx_point", extra=POSITIONS))
def position_counts(spark, d):
    return A.position_counts(positions(spark, d), spine.frames(fx.point(spark, d)))


# ---- space ----

CANDIDATES = "(0, 0, 4, 0, 35), (0, 0, 4, 1, 80), (0, 0, 9, 2, 10), (0, 0, 9, 3, 45), (0, 5, 9, 0, 60), (0, 5, 9, 1, 25), (0, 5, 9, 2, 15), (0, 0, 9, 4, 5), (0, 0, 9, 5, 0)"
CAND = (("cand", f"SELECT * FROM (VALUES {CANDIDATES}) v(cell_id, t_lo, t_hi, prio, id)"),
        ("chosen", "SELECT cell_id, t, id, x, y, z FROM (SELECT c.cell_id, n.t, n.id, n.x, n.y, n.z, row_number() OVER (PARTITION BY c.cell_id, n.t ORDER BY c.prio, n.id) AS k FROM fx_point n JOIN cand c ON c.id = n.id AND n.t BETWEEN c.t_lo AND c.t_hi WHERE n.kind = 'nucleus') WHERE k = 1"))


def candidates(spark):
    return spark.sql(f"SELECT * FROM VALUES {CANDIDATES} v(cell_id, t_lo, t_hi, prio, id)")


def chosen(spark, d):
    return J.by_priority(candidates(spark), nuclei(spark, d))


@query(with_views("SELECT cell_id, t, id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM chosen", "fx_point", extra=CAND))
def priority_candidate(spark, d):
    return chosen(spark, d).select("cell_id", "t", "id", *[r6(c).alias(c) for c in "xyz"])


@query(with_views("SELECT c.cell_id, s.t, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.prio, c.id) AS ids FROM (SELECT DISTINCT t FROM fx_point) s JOIN cand c ON s.t BETWEEN c.t_lo AND c.t_hi GROUP BY 1, 2", "fx_point", extra=CAND))
def candidate_intervals(spark, d):
    rows = J.candidate_at(candidates(spark), fx.point(spark, d).select("t").distinct())
    return rows.select("cell_id", "t", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(with_views("SELECT c.cell_id, c.t, c.id AS nuc_id, count(b.id) AS n, round(avg(b.dist), 6) AS mean_dist FROM chosen c LEFT JOIN best b ON b.t = c.t AND b.nuc_id = c.id GROUP BY 1, 2, 3", "fx_point", extra=(*CAND, *NN)))
def tracked_nucleus_stats(spark, d):
    c = chosen(spark, d).select("cell_id", "t", F.col("id").alias("nuc_id"))
    both = c.join(assigned(spark, d), ["t", "nuc_id"], "left")
    return both.groupBy("cell_id", "t", "nuc_id").agg(F.count("id").alias("n"), r6(F.avg("dist")).alias("mean_dist"))


RADIUS = (*CAND, ("sel", "SELECT c.cell_id, s.t, s.id, sqrt((s.x-c.x)*(s.x-c.x)+(s.y-c.y)*(s.y-c.y)+(s.z-c.z)*(s.z-c.z)) AS dist FROM fx_point s JOIN chosen c ON s.t = c.t WHERE s.kind = 'spot'"))


def selected(spark, d):
    return J.radius_pairs(spots(spark, d), chosen(spark, d).withColumnRenamed("id", "target_id"), 20.0)


@query(with_views("SELECT t, id, round(dist, 6) AS dist FROM sel WHERE dist < 20", "fx_point", extra=RADIUS))
def radius_select(spark, d):
    return selected(spark, d).select("t", "id", r6("dist").alias("dist"))


@query(with_views("SELECT s.t, count(sel.id) AS n FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(t) FROM fx_point))) AS INT) AS t) s LEFT JOIN sel ON sel.t = s.t AND sel.dist < 20 GROUP BY 1", "fx_point", extra=RADIUS))
def radius_count(spark, d):
    n = spine.frames(fx.point(spark, d)).select(F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("t"))
    return n.join(selected(spark, d).groupBy("t").agg(F.count("*").alias("n")), "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_views("SELECT t, id, orig FROM (SELECT a.t, a.id, b.id AS orig, row_number() OVER (PARTITION BY a.t, a.id ORDER BY sqrt((a.x+0.5-b.x)*(a.x+0.5-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.id) AS k FROM fx_point a JOIN fx_point b ON a.t = b.t AND b.kind = 'nucleus' WHERE a.kind = 'nucleus') WHERE k = 1", "fx_point"))
def nn_reassociate(spark, d):
    n = nuclei(spark, d)
    moved = n.withColumn("x", F.col("x") + 0.5)
    return J.nearest(moved, n.withColumnRenamed("id", "target_id"), keep="inner").select("t", "id", F.col("nuc_id").alias("orig"))


REG = (("ref", "SELECT cell_id, t, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM fx_traj WHERE nuc_id = 1 GROUP BY 1, 2"),)


def reference(spark, d):
    return A.cell_centre(fx.traj(spark, d).where("nuc_id = 1"))


@query(with_views("SELECT f.id, f.t, round(f.x - r.x, 6) AS x_reg, round(f.y - r.y, 6) AS y_reg, round(f.z - r.z, 6) AS z_reg FROM fx_traj f JOIN ref r ON r.cell_id = f.cell_id AND r.t = f.t", "fx_traj", extra=REG))
def register_coords(spark, d):
    return J.register(fx.traj(spark, d), reference(spark, d), ["cell_id", "t"]).select("id", "t", *[r6(f"{c}_reg").alias(f"{c}_reg") for c in "xyz"])


@query(with_views("SELECT f.id, f.t, round(f.x, 6) AS x, round(f.y, 6) AS y, round(f.z, 6) AS z FROM fx_traj f JOIN ref r ON r.cell_id = f.cell_id AND r.t = f.t", "fx_traj", extra=REG))
def unregister_coords(spark, d):
    reg = J.register(fx.traj(spark, d), reference(spark, d), ["cell_id", "t"])
    return J.unregister(reg, reference(spark, d), ["cell_id", "t"]).select("id", "t", *[r6(c).alias(c) for c in "xyz"])


@query(with_views("SELECT a.cell_id, a.t, a.id AS id_a, b.id AS id_b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS dist FROM fx_traj a JOIN fx_traj b ON a.cell_id = b.cell_id AND a.t = b.t AND a.id < b.id", "fx_traj"))
def pairwise_distance(spark, d):
    return J.pairwise_distance(fx.traj(spark, d)).select("cell_id", "t", "id_a", "id_b", r6("dist").alias("dist"))


# ---- voxels ----


@query(with_views("SELECT t, y, x, arg_max(z, value * 100 - z) AS z, max(value) AS value FROM fx_voxel GROUP BY 1, 2, 3", "fx_voxel"))
def argmax_z(spark, d):
    return voxel.argmax_z(fx.voxel(spark, d))


LIFT = (("det", "SELECT t, id, x * 0.173 + 0.01 AS position_x, y * 0.173 + 0.02 AS position_y FROM fx_spot"),
        ("top", "SELECT t, y, x, arg_max(z, value * 100 - z) AS z FROM fx_voxel GROUP BY 1, 2, 3"))


@query(with_views("SELECT d.t, d.id, CAST(trunc(d.position_x / 0.173) AS INT) AS x, CAST(trunc(d.position_y / 0.173) AS INT) AS y, top.z, round(top.z * 0.75e0, 6) AS position_z FROM det d JOIN top ON top.t = d.t AND top.y = CAST(trunc(d.position_y / 0.173) AS INT) AND top.x = CAST(trunc(d.position_x / 0.173) AS INT)", "fx_spot", "fx_voxel", extra=LIFT))
def lift_2d_to_3d(spark, d):
    s = fx.block_spots(spark, d).select("t", "id", (F.col("x") * SCALE.x + 0.01).alias("position_x"), (F.col("y") * SCALE.y + 0.02).alias("position_y"))
    return voxel.lift(s, fx.voxel(spark, d)).select("t", "id", "x", "y", "z", r6("position_z").alias("position_z"))


@query(with_views("SELECT t, y, x, max(value) AS value FROM fx_voxel GROUP BY 1, 2, 3", "fx_voxel"))
def max_projection(spark, d):
    return voxel.max_projection(fx.voxel(spark, d))


GATHER = "SELECT s.t, s.id, count(*) AS n, CAST(sum(v.value) AS BIGINT) AS total FROM fx_spot s JOIN fx_voxel v ON v.t = s.t WHERE sqrt({dz} + 0.5625*(v.y-s.y)*(v.y-s.y) + 0.5625*(v.x-s.x)*(v.x-s.x)) < 2.5 {flat} GROUP BY 1, 2"


@query(with_views(GATHER.format(dz="2.7556*(v.z-s.z)*(v.z-s.z)", flat=""), "fx_spot", "fx_voxel"))
def ellipsoid_gather(spark, d):
    rows = voxel.gather(fx.block_spots(spark, d), fx.voxel(spark, d).drop("i"), voxel.offsets())
    return rows.groupBy("t", "id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(with_views(GATHER.format(dz="2.7556*(v.z-s.z)*(v.z-s.z)", flat=""), "fx_spot", "fx_voxel"))
def block_gather(spark, d):
    folder = own_folder(spark, "blocks")
    files = volumes.write_volumes(fx.voxel(spark, d), folder)
    rows = blocks.gather(fx.block_spots(spark, d), blocks.index_files(files), voxel.offsets())
    return rows.groupBy("t", "id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(with_views(GATHER.format(dz="0", flat="AND v.z = s.z"), "fx_spot", "fx_voxel"))
def disk_gather(spark, d):
    rows = voxel.gather(fx.block_spots(spark, d), fx.voxel(spark, d).drop("i"), voxel.offsets(flat=True))
    return rows.groupBy("t", "id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(with_views("SELECT v.t, count(*) FILTER (WHERE v.value > p.lim) AS size, round(avg(v.value) FILTER (WHERE v.value > p.lim), 6) AS fluo FROM fx_voxel v JOIN (SELECT t, avg(value) + 1.15 * stddev_pop(value) AS lim FROM fx_voxel GROUP BY t) p ON p.t = v.t GROUP BY 1", "fx_voxel"))
def fluo_threshold(spark, d):
    return voxel.fluo_threshold(fx.pixels(spark, d)).select("t", "size", r6("fluo").alias("fluo"))


@query(with_views("SELECT t, round(quantile_cont(value, 0.875), 6) AS q FROM fx_voxel GROUP BY 1", "fx_voxel"))
def fluo_quantile(spark, d):
    return fx.voxel(spark, d).groupBy("t").agg(r6(F.percentile("value", F.lit(0.875))).alias("q"))


@query(with_views("SELECT t, t AS id, round(avg(value) FILTER (WHERE i % 3 = 0), 6) AS \"Chan_0\", round(avg(value) FILTER (WHERE i % 3 = 1), 6) AS \"Chan_1\", round(avg(value) FILTER (WHERE i % 3 = 2), 6) AS \"Chan_2\" FROM fx_voxel GROUP BY 1", "fx_voxel"))
def mean_fluo_channel(spark, d):
    rows = fx.voxel(spark, d).select("t", F.col("t").alias("id"), (F.col("i") % 3).alias("channel"), "value")
    return voxel.mean_by_channel(rows, [0, 1, 2]).select("t", "id", *[r6(f"Chan_{c}").alias(f"Chan_{c}") for c in range(3)])


@query(with_views("SELECT t, label, round(avg(z) * 0.75, 6) AS z, round(avg(y) * 0.173, 6) AS y, round(avg(x) * 0.173, 6) AS x, count(*) AS area, round(avg(value), 6) AS intensity FROM fx_label WHERE label <> 0 GROUP BY 1, 2", "fx_label"))
def label_centroids(spark, d):
    return voxel.label_centroids(fx.label(spark, d)).select("t", "label", *[r6(c).alias(c) for c in "zyx"], "area", r6("intensity").alias("intensity"))


SEEDS = (("seed", "SELECT t, t * 10 + k AS id, z * 0.75 AS z, ((y + k) % 6) * 0.173 AS y, x * 0.173 AS x FROM fx_spot CROSS JOIN (VALUES (0), (1), (2)) v(k)"),
         ("hit", "SELECT l.t, l.label, max(s.id) AS track_id FROM seed s JOIN fx_label l ON l.t = s.t AND l.z = CAST(round_even(s.z / 0.75, 0) AS INT) AND l.y = CAST(round_even(s.y / 0.173, 0) AS INT) AND l.x = CAST(round_even(s.x / 0.173, 0) AS INT) WHERE l.label <> 0 GROUP BY 1, 2"))


@query(with_views("SELECT l.t, l.z, l.y, l.x, h.track_id FROM fx_label l JOIN hit h ON h.t = l.t AND h.label = l.label WHERE l.label <> 0", "fx_label", "fx_spot", extra=SEEDS))
def relabel_by_seed(spark, d):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    s = fx.block_spots(spark, d).withColumn("k", k)
    s = s.select("t", (F.col("t") * 10 + F.col("k")).alias("id"), (F.col("z") * SCALE.z).alias("z"), (((F.col("y") + F.col("k")) % 6) * SCALE.y).alias("y"), (F.col("x") * SCALE.x).alias("x"))
    return voxel.relabel_by_seed(fx.label(spark, d), s)


CHOSEN = (("cell", "SELECT t, label FROM fx_label WHERE label <> 0 AND label <> 1 + t % 3 AND t % 7 <> 0 GROUP BY 1, 2"),)


def cell_labels(spark, d):
    return fx.label(spark, d).where("label <> 0 and label <> 1 + t % 3 and t % 7 <> 0").select("t", "label").distinct()


@query(with_views("SELECT l.t, l.z, l.y, l.x, l.label FROM fx_label l JOIN cell c ON c.t = l.t AND c.label = l.label", "fx_label", extra=CHOSEN))
def semi_join_labels(spark, d):
    return tables.semi_join(fx.label(spark, d), cell_labels(spark, d), ["t", "label"]).select("t", *"zyx", "label")


@query(with_views("""SELECT t, id, label AS nuc_id, round(d, 6) AS dist_nuc FROM (SELECT s.t, s.id, l.label, l.d, row_number() OVER (PARTITION BY s.t, s.id ORDER BY l.d NULLS LAST, l.label) AS k FROM fx_spot s
LEFT JOIN (SELECT s.t, s.id, l.label, sqrt((s.z-l.z)*0.75e0*((s.z-l.z)*0.75e0)+(s.y-l.y)*0.173e0*((s.y-l.y)*0.173e0)+(s.x-l.x)*0.173e0*((s.x-l.x)*0.173e0)) AS d
FROM fx_spot s JOIN fx_label l ON l.t = s.t JOIN cell c ON c.t = l.t AND c.label = l.label) l ON l.t = s.t AND l.id = s.id) WHERE k = 1""", "fx_label", "fx_spot", extra=CHOSEN))
def nn_voxel_distance(spark, d):
    return voxel.nearest_voxel(fx.block_spots(spark, d), fx.label(spark, d), cell_labels(spark, d)).select("t", "id", "nuc_id", r6("dist_nuc").alias("dist_nuc"))


@query(with_views("SELECT v.t, v.z, v.y, v.x, round((v.value - p.lo) / nullif(p.hi - p.lo, 0), 6) AS norm FROM fx_voxel v JOIN (SELECT t, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.998) AS hi FROM fx_voxel GROUP BY t) p ON p.t = v.t", "fx_voxel"))
def normalise_percentile(spark, d):
    return voxel.normalise_percentile(fx.voxel(spark, d)).select("t", *"zyx", r6("norm").alias("norm"))


PARTS = (("fr", "SELECT v.t, v.z, v.y, v.x, v.i AS p FROM fx_voxel v JOIN (SELECT t, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.998) AS hi FROM fx_voxel GROUP BY t) q ON q.t = v.t WHERE (v.value - q.lo) / nullif(q.hi - q.lo, 0) > 0.5"),
         ("beside", "SELECT a.t, a.p, b.p AS q FROM fr a JOIN fr b ON a.t = b.t AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1"),
         ("reach", "SELECT t, p, p AS q FROM fr UNION SELECT r.t, r.p, b.q FROM reach r JOIN beside b ON b.t = r.t AND b.p = r.q"),
         ("part", "SELECT t, p, min(q) AS f FROM reach GROUP BY 1, 2"))


@query(with_views("SELECT fr.t, fr.z, fr.y, fr.x, dense_rank() OVER (PARTITION BY fr.t ORDER BY part.f) AS label FROM fr JOIN part ON part.t = fr.t AND part.p = fr.p", "fx_voxel", extra=PARTS).replace("WITH ", "WITH RECURSIVE ", 1))
def segment_threshold(spark, d):
    return voxel.segment(fx.voxel(spark, d))


HILLS = (*PARTS[:1],
         ("bg", "SELECT v.t, v.z, v.y, v.x FROM fx_voxel v LEFT JOIN fr ON fr.t = v.t AND fr.p = v.i WHERE fr.p IS NULL"),
         ("ds", "SELECT f.t, f.p, f.z, f.y, f.x, least(9.0, (f.z+1)*(f.z+1), (4-f.z)*(4-f.z), (f.y+1)*(f.y+1), (4-f.y)*(4-f.y), (f.x+1)*(f.x+1), (4-f.x)*(4-f.x), coalesce(b, 9)) AS d2 FROM (SELECT f.*, (SELECT min((f.z-b.z)*(f.z-b.z)+(f.y-b.y)*(f.y-b.y)+(f.x-b.x)*(f.x-b.x)) FROM bg b WHERE b.t = f.t) AS b FROM fr f) f"),
         ("up", "SELECT t, p, q FROM (SELECT a.t, a.p, b.p AS q, row_number() OVER (PARTITION BY a.t, a.p ORDER BY b.d2 DESC, b.p) AS k FROM ds a JOIN ds b ON b.t = a.t AND abs(a.z-b.z) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1) WHERE k = 1"),
         ("walk", "SELECT t, p, q FROM up UNION SELECT w.t, w.p, u.q FROM walk w JOIN up u ON u.t = w.t AND u.p = w.q"),
         ("hl", "SELECT w.t, w.p, w.q AS h, d.d2, d.z, d.y, d.x FROM walk w JOIN up u ON u.t = w.t AND u.p = w.q AND u.q = w.q JOIN ds d ON d.t = w.t AND d.p = w.p"),
         ("tp", "SELECT t, h, max(d2) AS top FROM hl GROUP BY 1, 2"),
         ("ps", "SELECT a.t, a.h AS g, b.h, max(least(a.d2, b.d2)) AS low FROM hl a JOIN hl b ON a.t = b.t AND a.h <> b.h AND abs(a.z-b.z) + abs(a.y-b.y) + abs(a.x-b.x) = 1 GROUP BY 1, 2, 3"),
         ("mg", "SELECT ps.t, ps.g, ps.h FROM ps JOIN tp a ON a.t = ps.t AND a.h = ps.g JOIN tp b ON b.t = ps.t AND b.h = ps.h WHERE sqrt(least(a.top, b.top)) - sqrt(low) < 0.2"),
         ("rc", "SELECT t, h, h AS g FROM tp UNION SELECT r.t, r.h, m.h FROM rc r JOIN mg m ON m.t = r.t AND m.g = r.g"),
         ("wh", "SELECT t, h, min(g) AS f FROM rc GROUP BY 1, 2"))


@query(with_views("SELECT hl.t, hl.z, hl.y, hl.x, n.label FROM hl JOIN (SELECT t, h, dense_rank() OVER (PARTITION BY t ORDER BY f) AS label FROM wh) n ON n.t = hl.t AND n.h = hl.h", "fx_voxel", extra=HILLS).replace("WITH ", "WITH RECURSIVE ", 1).replace("ds AS (", "ds AS MATERIALIZED (").replace("up AS (", "up AS MATERIALIZED (").replace("hl AS (", "hl AS MATERIALIZED (").replace("mg AS (", "mg AS MATERIALIZED ("))
def segment_split(spark, d):
    return watershed.segment_split(fx.voxel(spark, d), scale=Scale(1.0, 1.0, 1.0), reach=3.0, depth=0.2)


GRID = (("gy", "SELECT range AS j, greatest(0.0, least(3.0, (range + 0.5) / 0.5 - 0.5)) AS s FROM range(2)"), ("gx", "SELECT range AS j, greatest(0.0, least(3.0, (range + 0.5) / 2.0 - 0.5)) AS s FROM range(8)"))


@query(with_views("SELECT v.t, v.z, CAST(gy.j AS INT) AS y, CAST(gx.j AS INT) AS x, round(sum(v.value * (1 - abs(gy.s - v.y)) * (1 - abs(gx.s - v.x))), 4) + 0.0 AS value FROM fx_voxel v JOIN gy ON abs(gy.s - v.y) < 1 JOIN gx ON abs(gx.s - v.x) < 1 GROUP BY 1, 2, 3, 4", "fx_voxel", extra=GRID))
def resample_linear(spark, d):
    return resample.resample(fx.voxel(spark, d), (1, 0.5, 2)).select("t", *"zyx", F.round("value", 4).alias("value"))


@query(with_views("SELECT l.t, l.z, CAST(y.range AS INT) AS y, CAST(x.range AS INT) AS x, l.label FROM fx_label l JOIN range(8) y ON l.y = greatest(0, least(3, ceil((y.range + 0.5) * 0.5 - 1))) JOIN range(2) x ON l.x = greatest(0, least(3, ceil((x.range + 0.5) * 2 - 1)))", "fx_label"))
def labels_resampled_back(spark, d):
    labels = fx.label(spark, d)
    return resample.labels_back(labels, (1, 0.5, 2), labels.select("t", F.lit(4).alias("nz"), F.lit(8).alias("ny"), F.lit(2).alias("nx")).distinct())


EDITED = (("ed", "SELECT id, t, 1 + t % 3 AS version, CASE WHEN (id + t) % 4 = 0 THEN 'cut' ELSE 'put' END AS kind, z + 1 AS z, y, x FROM fx_traj WHERE id % 2 = 0 UNION ALL SELECT id, t, 2, 'put', z + 2, y, x FROM fx_traj WHERE id % 6 = 0 UNION ALL SELECT id + 1000000, t, 2, 'put', z, y, x FROM fx_traj WHERE t = 1"),
          ("hd", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY version DESC, z DESC) AS k FROM ed WHERE version <= 2) WHERE k = 1"))


@query(with_views("SELECT id, t, round(z, 6) AS z, round(y, 6) AS y, round(x, 6) AS x FROM (SELECT id, t, z, y, x FROM fx_traj p WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.id = p.id AND hd.t = p.t) UNION ALL SELECT id, t, z, y, x FROM hd WHERE kind = 'put')", "fx_traj", extra=EDITED))
def edits_as_of(spark, d):
    p, log = fx.traj(spark, d).select("id", "t", *"zyx"), own_folder(spark, "edits")
    first = p.where("id % 2 = 0").select("id", "t", F.when((F.col("id") + F.col("t")) % 4 == 0, "cut").otherwise("put").alias("kind"), (F.col("z") + 1).alias("z"), "y", "x", F.lit(0).cast("long").alias("seq"))
    later = p.where("id % 6 = 0").select("id", "t", F.lit("put").alias("kind"), (F.col("z") + 2).alias("z"), "y", "x", F.lit(1).cast("long").alias("seq"))
    new = p.where("t = 1").select((F.col("id") + 1000000).alias("id"), "t", F.lit("put").alias("kind"), *"zyx", F.lit(2).cast("long").alias("seq"))
    for v in (1, 2, 3):
        mine = first.where(F.col("t") % 3 == v - 1)
        edit_log.append(mine.unionByName(later).unionByName(new) if v == 2 else mine, log, v)
    return edit_log.as_of(p, edit_log.read(spark, log), 2).select("id", "t", *[r6(c).alias(c) for c in "zyx"])


BOXES = (("bx", "SELECT t, id, 1 / (1 + x*x/400 + y*y/400 + z*z/400) AS score, " + ", ".join(f"{c} - 4 - id % 5 AS {c}0, {c} + 4 + id % 5 AS {c}1" for c in "zyx") + " FROM fx_point"),
         ("rk", "SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, id) AS k FROM bx WHERE score >= 0.5577"),
         ("ov", "SELECT * FROM (SELECT a.t, a.k AS i, b.k, (a.z1-a.z0)*(a.y1-a.y0)*(a.x1-a.x0) + (b.z1-b.z0)*(b.y1-b.y0)*(b.x1-b.x0) AS total, " + "*".join(f"greatest(0, least(a.{c}1, b.{c}1) - greatest(a.{c}0, b.{c}0))" for c in "zyx") + " AS common FROM rk a JOIN rk b ON b.t = a.t AND b.k > a.k) WHERE common > 0.3e0 * (total - common)"),
         ("nb", "SELECT rk.t, rk.k, coalesce(list(ov.i) FILTER (WHERE ov.i IS NOT NULL), []) AS l FROM rk LEFT JOIN ov ON ov.t = rk.t AND ov.k = rk.k GROUP BY 1, 2"),
         ("st", "SELECT DISTINCT t, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM rk UNION ALL SELECT st.t, nb.k, CASE WHEN list_has_any(st.kept, nb.l) THEN st.kept ELSE list_append(st.kept, nb.k) END FROM st JOIN nb ON nb.t = st.t AND nb.k = st.k + 1"))


@query(with_views("SELECT rk.t, rk.id, round(rk.score, 6) AS score FROM rk JOIN (SELECT t, unnest(kept) AS k FROM (SELECT t, arg_max(kept, k) AS kept FROM st GROUP BY 1)) s ON s.t = rk.t AND s.k = rk.k", "fx_point", extra=BOXES).replace("WITH ", "WITH RECURSIVE ", 1).replace("nb AS (", "nb AS MATERIALIZED ("))
def suppress_overlaps(spark, d):
    half = 4 + F.col("id") % 5
    boxes = fx.point(spark, d).withColumns({"score": 1 / (1 + F.col("x") * F.col("x") / 400 + F.col("y") * F.col("y") / 400 + F.col("z") * F.col("z") / 400)} | {f"{c}{k}": F.col(c) + (half if k else -half) for c in "zyx" for k in (0, 1)})
    return suppression.suppress(boxes).select("t", "id", r6("score").alias("score"))


# ---- statistics ----

R = "covar_pop(a.{c}, b.{c}) / nullif(stddev_pop(CASE WHEN b.{c} IS NOT NULL THEN a.{c} END) * stddev_pop(CASE WHEN a.{c} IS NOT NULL THEN b.{c} END), 0)"


@query(with_views("SELECT cell_id, t, count(*) AS n, round(var_samp(ex), 6) AS var_x, round(var_samp(ey), 6) AS var_y, round(var_samp(ez), 6) AS var_z, round(covar_samp(ex, ey), 6) AS cov_xy, round(covar_samp(ex, ez), 6) AS cov_xz, round(covar_samp(ey, ez), 6) AS cov_yz FROM steps WHERE ex IS NOT NULL AND ey IS NOT NULL AND ez IS NOT NULL GROUP BY 1, 2", "steps"))
def direction_covariance(spark, d):
    rows = stats.direction_covariance(dense(spark, d))
    return rows.select("cell_id", "t", "n", *[r6(c).alias(c) for c in rows.columns[3:]])


def corr_sql(column: str, source: str, *views: str, extra=()) -> str:
    return with_views(f"SELECT a.cell_id, a.id AS id_a, b.id AS id_b, round({R.format(c=column)}, 6) AS r FROM {source} a JOIN {source} b ON a.cell_id = b.cell_id AND a.t = b.t GROUP BY 1, 2, 3", *views, extra=extra)


def corr_query(name: str, column: str, rows: Callable, sql: str) -> None:
    query(sql, name)(lambda spark, d: stats.correlation(rows(spark, d), [column]).select("cell_id", "id_a", "id_b", r6(f"r_{column}").alias("r")))


for c, n in (("fluo", "corr_fluo"), ("x", "corr_coord_x"), ("y", "corr_coord_y"), ("z", "corr_coord_z")):
    corr_query(n, c, dense, corr_sql(c, "dense", "dense"))
corr_query("corr_dir_angle", "angle", lambda s, d: kin(s, d).where("inner"), corr_sql("angle", "rows_", "angles", extra=(("rows_", "SELECT * FROM angles WHERE inside"),)))
corr_query("corr_dir_norm", "norm", lambda s, d: kin(s, d).where("t >= 2"), corr_sql("norm", "rows_", "angles", extra=(("rows_", "SELECT * FROM angles WHERE t >= 2"),)))
corr_query("corr_fluo_diff", "diff", lambda s, d: K.difference(dense(s, d), "fluo", "diff"), corr_sql("diff", "rows_", "dense", extra=(("rows_", "SELECT * FROM (SELECT id, cell_id, t, lead(fluo) OVER w - fluo AS diff, lead(t) OVER w AS tn FROM dense WINDOW w AS (PARTITION BY id ORDER BY t)) WHERE tn IS NOT NULL"),)))


@query(with_views(f"SELECT a.cell_id, a.id AS id_a, b.id AS id_b, round(({R.format(c='x')} + {R.format(c='y')} + {R.format(c='z')}) / 3, 6) AS r FROM dense a JOIN dense b ON a.cell_id = b.cell_id AND a.t = b.t GROUP BY 1, 2, 3", "dense"))
def corr_coord_mean(spark, d):
    rows = stats.correlation(dense(spark, d), ["x", "y", "z"])
    return rows.select("cell_id", "id_a", "id_b", r6((F.col("r_x") + F.col("r_y") + F.col("r_z")) / 3).alias("r"))


MM = (("mm", "SELECT f.*, (fluo - lo) / nullif(hi - lo, 0) AS norm, lo, hi FROM fx_traj f JOIN (SELECT id AS i, min(fluo) AS lo, max(fluo) AS hi FROM fx_traj GROUP BY 1) m ON m.i = f.id"),
      ("dp", "SELECT mm.*, top - z AS depth FROM mm JOIN (SELECT cell_id AS c, max(z) AS top FROM mm GROUP BY 1) q ON q.c = mm.cell_id"))


def ols_sql(v: str) -> tuple:
    return (("cv", f"SELECT cell_id, count(*) AS n, avg(depth) AS ma, avg(t) AS mb, avg({v}) AS mv, covar_pop(depth, depth) AS aa, covar_pop(t, t) AS bb, covar_pop(depth, t) AS ab, covar_pop(depth, {v}) AS av, covar_pop(t, {v}) AS bv FROM dp WHERE {v} IS NOT NULL GROUP BY 1"),
            ("sl", "SELECT *, (av*bb - bv*ab) / nullif(aa*bb - ab*ab, 0) AS sa, (bv*aa - av*ab) / nullif(aa*bb - ab*ab, 0) AS sb FROM cv"),
            ("fit", "SELECT *, mv - sa*ma - sb*mb AS ic FROM sl"))


@query(with_views("SELECT id, t, round(norm, 6) AS norm FROM mm", "fx_traj", extra=MM))
def minmax_normalise(spark, d):
    return stats.minmax(fx.traj(spark, d), "fluo").select("id", "t", r6("norm").alias("norm"))


@query(with_views("SELECT cell_id, n, round(sa, 6) AS slope_a, round(sb, 6) AS slope_b, round(ic, 6) AS intercept FROM fit", "fx_traj", extra=(*MM, *ols_sql("norm"))))
def ols_two_predictor(spark, d):
    rows = stats.minmax(stats.depth_path(fx.traj(spark, d)), "fluo")
    return stats.ols(rows, "depth", "t", "norm").select("cell_id", "n", *[r6(c).alias(c) for c in ("slope_a", "slope_b", "intercept")])


@query(with_views("SELECT dp.id, dp.t, round(norm * (ic / nullif(ic + sa*depth + sb*t, 0)) * (hi - lo) + lo, 4) AS fluo_corr FROM dp JOIN fit ON fit.cell_id = dp.cell_id", "fx_traj", extra=(*MM, *ols_sql("norm"))))
def zt_correction(spark, d):
    return stats.zt_correction(fx.traj(spark, d)).select("id", "t", F.round("fluo_corr", 4).alias("fluo_corr"))


@query(with_views("SELECT dp.id, dp.t, round(norm * (exp(ic) / exp(ic + sa*depth + sb*t)) * (hi - lo) + lo, 4) AS fluo_corr FROM dp JOIN fit ON fit.cell_id = dp.cell_id", "fx_traj", extra=(*MM, *ols_sql("ln(1 + norm)"))))
def zt_correction_log(spark, d):
    return stats.zt_correction(fx.traj(spark, d), log=True).select("id", "t", F.round("fluo_corr", 4).alias("fluo_corr"))


@query(with_views("SELECT id, t, round(depth, 6) AS depth FROM dp", "fx_traj", extra=MM))
def depth_path(spark, d):
    return stats.depth_path(fx.traj(spark, d)).select("id", "t", r6("depth").alias("depth"))


@query(with_views("SELECT cell_id, " + ", ".join(f"round_even({f}({c}), 0) AS {c}_{f}" for c in "xyz" for f in ("min", "max")) + " FROM fx_traj GROUP BY 1", "fx_traj"))
def coord_bounds(spark, d):
    return A.bounds(fx.traj(spark, d))


# ---- curation ----

SCRIPT = "ID 8\n60: 7\n\n40: Disappear in 6\n20: 4 Reappear\nID 5\n80: nan\n70: 5 Appear\n30: Disappear\n\nID 9\n50: 12\n"
TOP = 80
PARSED = (("raw", f"SELECT 0 AS cell_id, CAST(unnest(generate_series(0, len(string_split(s, chr(10))) - 1)) AS INT) AS line_no, trim(unnest(string_split(s, chr(10)))) AS text FROM (SELECT '{SCRIPT.replace(chr(10), chr(92) + 'n')}' AS e, replace(e, chr(92) || 'n', chr(10)) AS s)"),
          ("wd", "SELECT *, string_split(text, ' ') AS w, string_split(text, ' ')[1] = 'ID' AS head FROM raw WHERE text <> ''"),
          ("mn", "SELECT *, last_value(CASE WHEN head THEN CAST(w[2] AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS main FROM wd"),
          ("pr", """SELECT cell_id, line_no, main, CASE WHEN NOT head THEN CAST(string_split(text, ':')[1] AS INT) END AS tp, CASE WHEN head THEN 'start' WHEN regexp_full_match(w[2], '[0-9]+') THEN 'id'
          WHEN w[2] = 'Disappear' AND len(w) > 2 THEN 'merge' WHEN w[2] IN ('Disappear', 'nan') THEN 'none' ELSE 'same' END AS kind,
          CASE WHEN regexp_full_match(w[2], '[0-9]+') THEN CAST(w[2] AS BIGINT) WHEN w[2] = 'Disappear' AND len(w) > 2 THEN CAST(w[len(w)] AS BIGINT) END AS target FROM mn"""),
          ("sp", f"SELECT *, CASE WHEN kind = 'start' THEN {TOP} ELSE tp END AS t_hi, CASE WHEN kind = 'start' THEN main WHEN kind = 'id' THEN target END AS raw_id, CASE WHEN kind = 'start' THEN main WHEN kind <> 'none' THEN target END AS merge_id FROM pr"),
          ("ed", "SELECT * FROM (SELECT cell_id, main, lead(t_hi, 1, -1) OVER (PARTITION BY cell_id, main ORDER BY line_no) AS t_lo, t_hi, raw_id, merge_id FROM sp) WHERE t_lo < t_hi"))


def script(spark, text: str = SCRIPT):
    return spark.createDataFrame([(0, text)], "cell_id int, text string")


def edits(spark):
    return C.intervals(C.parse(script(spark)), TOP)


BLOCK = """'ID ' || id || chr(10) || (60 + id % 9) || ': ' || (id + 1) || chr(10) || chr(10) || CASE id % 3 WHEN 0 THEN '40: Disappear in ' || (id + 2) WHEN 1 THEN '40: ' || (id + 3) || ' Appear' ELSE '40: nan' END
|| chr(10) || CASE WHEN id % 2 = 0 THEN '20: Disappear' ELSE '20: ' || id || ' Reappear' END"""
WRITTEN = (("tx", f"SELECT cell_id, string_agg({BLOCK}, chr(10) ORDER BY id) AS s FROM (SELECT DISTINCT cell_id, id FROM fx_traj) GROUP BY 1"),
           ("raw", "SELECT cell_id, CAST(unnest(generate_series(0, len(string_split(s, chr(10))) - 1)) AS INT) AS line_no, trim(unnest(string_split(s, chr(10)))) AS text FROM tx"), *PARSED[1:])


def scripts(spark, d) -> DataFrame:
    """A curation text for each cell of the series, a block for each spot."""
    i = F.col("id")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (x.cast("string") if isinstance(x, Column) else x for x in parts)])
    third = F.when(i % 3 == 0, text("40: Disappear in ", i + 2)).when(i % 3 == 1, text("40: ", i + 3, " Appear")).otherwise("40: nan")
    block = F.concat_ws("\n", text("ID ", i), text(60 + i % 9, ": ", i + 1), F.lit(""), third, F.when(i % 2 == 0, "20: Disappear").otherwise(text("20: ", i, " Reappear")))
    ids = fx.traj(spark, d).select("cell_id", "id").distinct().select("cell_id", F.struct("id", block.alias("block")).alias("b"))
    return ids.groupBy("cell_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n").alias("text"))


@query(with_views("SELECT * FROM pr", "fx_traj", extra=WRITTEN))
def curation_parse(spark, d):
    return C.parse(scripts(spark, d))


@query(with_views("SELECT cell_id, main, t_lo, t_hi, raw_id, merge_id FROM ed", "fx_traj", extra=WRITTEN))
def curation_intervals(spark, d):
    return C.intervals(C.parse(scripts(spark, d)), TOP)


CURATED = "SELECT CASE e.main WHEN 5 THEN 1 WHEN 8 THEN 2 ELSE 3 END AS id, p.t, p.z, p.y, p.x FROM fx_traj p JOIN ed e ON p.id = e.{} AND p.t > e.t_lo AND p.t <= e.t_hi"


@query(with_views(CURATED.format("raw_id"), "fx_traj", extra=PARSED))
def curate_interval_join(spark, d):
    return C.apply(C.numbered(edits(spark), [5, 8, 9]), fx.traj(spark, d)).select(F.col("id").cast("int").alias("id"), "t", "z", "y", "x")


@query(with_views(CURATED.format("merge_id"), "fx_traj", extra=PARSED))
def curate_interval_join_merged(spark, d):
    return C.apply(C.numbered(edits(spark), [5, 8, 9]), fx.traj(spark, d), merged=True).select(F.col("id").cast("int").alias("id"), "t", "z", "y", "x")


@query(with_views("SELECT cell_id, t, id, nuc_id FROM fx_traj", "fx_traj"))
def nuc_text_parse(spark, d):
    return C.nucleus_text(C.nucleus_lines(fx.traj(spark, d)))


# ---- labels and links ----


@query(with_views("SELECT id, dense_rank() OVER (ORDER BY id) AS new_id FROM (SELECT DISTINCT id * 3 + 1 AS id FROM fx_traj)", "fx_traj"))
def dense_relabel(spark, d):
    return L.dense_relabel(fx.traj(spark, d).select((F.col("id") * 3 + 1).alias("id")))


LINKS = (("sp", "SELECT * FROM fx_point WHERE kind = 'spot'"),
         ("pr", "SELECT a.t, a.id AS id_a, b.id AS id_b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM sp a JOIN sp b ON b.t = a.t + 1"),
         ("lk", "SELECT t, id_a, id_b, dist FROM (SELECT *, row_number() OVER (PARTITION BY t, id_a ORDER BY dist, id_b) AS p, row_number() OVER (PARTITION BY t, id_b ORDER BY dist, id_a) AS q FROM pr WHERE dist < 10) WHERE p = 1 AND q = 1"))


@query(with_views("SELECT t, id_a, id_b, round(dist, 6) AS dist FROM lk", "fx_point", extra=LINKS))
def mutual_nn_links(spark, d):
    return L.mutual_links(spots(spark, d), 10.0).select("t", "id_a", "id_b", r6("dist").alias("dist"))


CHAINS = with_views("SELECT id, t, head, place FROM ch", "fx_point", extra=(*LINKS, ("ch", "SELECT id, t, id AS head, 0 AS place FROM sp WHERE id NOT IN (SELECT id_b FROM lk) UNION ALL SELECT lk.id_b, ch.t + 1, ch.head, ch.place + 1 FROM ch JOIN lk ON lk.id_a = ch.id"))).replace("WITH ", "WITH RECURSIVE ", 1)


@query(CHAINS)
def stream_track_chains(spark, d):
    folder, own = own_folder(spark, "stream"), linker.with_state_store(spark)
    points = spots(own, d).select(F.lit(0).alias("movie"), "t", "id", *"xyz")
    last = points.agg((F.max("t") + 1002).alias("t")).select(F.lit(0).alias("movie"), "t", *[F.lit(None).cast(k).alias(c) for c, k in points.dtypes[2:]])  # a frame so much later closes all
    for rows in (points, last):  # the closing row only once all points have been taken: what comes after it is too late
        rows.write.mode("append").parquet(f"{folder}/in")
        arriving = own.readStream.schema(points.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
        frames.into_table(linker.stream_chains(arriving, "movie", 10.0, delay=1000), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "t", "head", "place")


@query(CHAINS)
def track_chains(spark, d):
    s = spots(spark, d)
    return L.chains(s, L.mutual_links(s, 10.0))


@query()
def link_frames(spark, d):
    return L.link_frames(fx.traj(spark, d), "cell_id", 150.0)


# The tracker's parameters
TRACKER = """{"TrackerConfig": {"MotionModel": {"name": "cell_motion", "dt": 1.0, "measurements": 3, "states": 6, "accuracy": 7.5, "prob_not_assign": 0.1, "max_lost": 5,
"A": {"matrix": [1,0,0,1,0,0, 0,1,0,0,1,0, 0,0,1,0,0,1, 0,0,0,1,0,0, 0,0,0,0,1,0, 0,0,0,0,0,1]},
"H": {"matrix": [1,0,0,0,0,0, 0,1,0,0,0,0, 0,0,1,0,0,0]},
"P": {"sigma": 150.0, "matrix": [0.1,0,0,0,0,0, 0,0.1,0,0,0,0, 0,0,0.1,0,0,0, 0,0,0,1,0,0, 0,0,0,0,1,0, 0,0,0,0,0,1]},
"G": {"sigma": 15.0, "matrix": [0.5,0.5,0.5,1,1,1]}, "R": {"sigma": 5.0, "matrix": [1,0,0, 0,1,0, 0,0,1]}},
"HypothesisModel": {"hypotheses": ["P_FP", "P_init", "P_term", "P_link", "P_branch", "P_dead"], "lambda_time": 5.0, "lambda_dist": 3.0, "lambda_link": 10.0, "lambda_branch": 50.0, "eta": 1e-10,
"theta_dist": 20.0, "theta_time": 5.0, "dist_thresh": 40, "time_thresh": 2, "apop_thresh": 5, "segmentation_miss_rate": 0.1, "apoptosis_rate": 0.001, "relax": true}}}"""


def tracker() -> tracking.Tracker:
    return tracking.Tracker.of(readers.read_config(TRACKER))


@query()
def link_motion(spark, d):
    return tracking.link_motion(fx.traj(spark, d), "cell_id", tracker())


@query()
def link_motion_lineage(spark, d):
    return tracking.lineage(link_motion(spark, d), "cell_id")


@query()
def link_motion_registered(spark, d):
    centre = whole_centres(spark, d)
    reference = centre.select("cell_id", "t", *[spine.last_known(F.col(c), ["cell_id"]).alias(c) for c in "xyz"]).where("x is not null")
    return tracking.link_motion_registered(fx.traj(spark, d), reference, "cell_id", tracker())


@query()
def link_motion_2d(spark, d):
    return tracking.link_motion(fx.traj(spark, d).withColumn("z", F.lit(0.0)), "cell_id", tracker())


@query()
def link_optimum(spark, d):
    return H.link_optimum(fx.traj(spark, d), "cell_id", tracker(), H.Model.of(readers.read_config(TRACKER)))


def unbroken(spark, d) -> DataFrame:
    """Points of the series, those of a spot's consecutive frames as one fragment."""
    w = Window.partitionBy("id").orderBy("t")
    rows = fx.traj(spark, d).withColumn("g", F.col("t") - F.row_number().over(w))
    return rows.withColumn("name", F.struct(F.min("t").over(Window.partitionBy("id", "g")).alias("t"), "id")).select("cell_id", "id", "t", *"xyz", "name")


EDGE = "ln(greatest(CASE WHEN {f} < 5 THEN exp(-({f}) / 5.0) END, CASE WHEN {b} < 20 THEN exp(-{b} / 3.0) END, 1e-10)) + half"
OFFERS = (("gr", "SELECT *, t - row_number() OVER (PARTITION BY id ORDER BY t) AS g FROM fx_traj"),
          ("fr", "SELECT cell_id, id, count(*) AS n, min(t) AS h, max(t) AS l, " + ", ".join(f"arg_min({c}, t) AS h{c}, arg_max({c}, t) AS l{c}" for c in "xyz") + " FROM gr GROUP BY cell_id, id, g"),
          ("bx", "SELECT cell_id AS c, min(t) AS t0, max(t) AS t1, " + ", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in "xyz") + " FROM fx_traj GROUP BY 1"),
          ("fs", "SELECT *, 0.5 * ln(greatest(1 - pow(0.1e0, n), 1e-10)) AS half, least(" + ", ".join(f"h{c} - {c}0, {c}1 - h{c}" for c in "xyz") + ") AS hb, least(" + ", ".join(f"l{c} - {c}0, {c}1 - l{c}" for c in "xyz") + ") AS lb FROM fr JOIN bx ON bx.c = fr.cell_id"),
          ("pr", "SELECT * FROM (SELECT e.cell_id, e.id, e.h, e.half AS eh, s.id AS a, s.h AS at_, s.half AS sh, s.h - e.l AS dt, s.hx - e.lx AS ox, s.hy - e.ly AS oy, s.hz - e.lz AS oz, sqrt((s.hx-e.lx)*(s.hx-e.lx)+(s.hy-e.ly)*(s.hy-e.ly)+(s.hz-e.lz)*(s.hz-e.lz)) AS d FROM fs e JOIN fs s ON s.cell_id = e.cell_id AND s.h > e.l AND s.h <= e.l + 2) WHERE d < 40"))


@query(with_views(f"""SELECT cell_id, kind, id, CAST(h AS INT) AS t, a_id, CAST(a_t AS INT) AS a_t, b_id, CAST(b_t AS INT) AS b_t, round(score, 6) + 0.0 AS score FROM (
SELECT cell_id, 'P_FP' AS kind, id, h, NULL AS a_id, NULL AS a_t, NULL AS b_id, NULL AS b_t, n * ln(0.1e0) AS score FROM fs UNION ALL SELECT cell_id, 'P_init', id, h, NULL, NULL, NULL, NULL, {EDGE.format(f="h - t0", b="hb")} FROM fs
UNION ALL SELECT cell_id, 'P_term', id, h, NULL, NULL, NULL, NULL, {EDGE.format(f="t1 - l", b="lb")} FROM fs UNION ALL SELECT cell_id, 'P_dead', id, h, NULL, NULL, NULL, NULL, ln(0.001e0) + half FROM fs WHERE n >= 5
UNION ALL SELECT cell_id, 'P_link', id, h, a, at_, NULL, NULL, -d * dt / 10.0 + eh + sh FROM pr
UNION ALL SELECT p.cell_id, 'P_branch', p.id, p.h, p.a, p.at_, q.a, q.at_, -(p.d + q.d) / 100.0 + p.eh + p.sh + q.sh FROM pr p JOIN pr q ON q.cell_id = p.cell_id AND q.id = p.id AND q.h = p.h AND p.dt = 1 AND q.dt = 1 AND (p.d, p.at_, p.a) < (q.d, q.at_, q.a) AND p.ox*q.ox + p.oy*q.oy + p.oz*q.oz < 0)""", "fx_traj", extra=OFFERS))
def hypothesis_scores(spark, d):
    rows = H.offers_of(unbroken(spark, d), "cell_id", H.Model.of(readers.read_config(TRACKER)))
    to = lambda k, c: F.get("to", F.lit(k))[c]
    return rows.select("cell_id", "kind", "name.id", "name.t", *[to(k, c).alias(f"{n}_{c}") for k, n in enumerate("ab") for c in ("id", "t")], r6("score").alias("score"))


@query()
def hypothesis_choice(spark, d):
    rows = H.explained(H.optimum(H.offers_of(unbroken(spark, d), "cell_id", H.Model.of(readers.read_config(TRACKER)))))
    return rows.select("name.id", "name.t", "start_by", "end_by", F.transform("to", lambda c: F.concat_ws("@", c["id"].cast("string"), c["t"].cast("string"))).alias("to"), "proved")


@query()
def null_models(spark, d):
    cos = K.cosines(dense(spark, d))
    return P.null_models(cos, P.persistence_prob(P.run_counter(cos)), spine.frames(fx.traj(spark, d)))


@query()
def null_model_persistence(spark, d):
    return P.persistence_prob(P.run_counter(null_models(spark, d).withColumn("id", F.struct("model", "cell_id", "id"))), "model").select("model", "c", "p1", "b1", r6("prob").alias("prob"))


# ---- scalars ----


@query(with_views("SELECT id, t, CAST(trunc(-x / 7) AS BIGINT) AS v FROM fx_traj", "fx_traj"))
def scalar_trunc(spark, d):
    return fx.traj(spark, d).select("id", "t", S.trunc(-F.col("x") / 7).alias("v"))


@query(with_views("SELECT id, t, round_even(z / 2, 0) AS v FROM fx_traj", "fx_traj"))
def scalar_round_even(spark, d):
    return fx.traj(spark, d).select("id", "t", S.round_even(F.col("z") / 2).alias("v"))


@query(with_views("SELECT id, t, round(sqrt(x*x+y*y+z*z), 6) AS norm, round(x*y+y*z+z*x, 6) AS dot, round(acos(CASE WHEN c > 1 THEN 1.0 WHEN c < -1 THEN -1.0 ELSE c END) / pi(), 6) AS angle, round(ln(1 + abs(x)), 6) AS log1, round(exp(-x / 100), 6) AS e FROM (SELECT *, (x*y+y*z+z*x) / nullif(sqrt(x*x+y*y+z*z)*sqrt(y*y+z*z+x*x), 0) AS c FROM fx_traj)", "fx_traj"))
def scalar_vector(spark, d):
    a, b = S.xyz(), [F.col(c) for c in "yzx"]
    return fx.traj(spark, d).select("id", "t", r6(S.norm(a)).alias("norm"), r6(S.dot(a, b)).alias("dot"), r6(S.angle_over_pi(S.cosine(a, b))).alias("angle"), r6(F.log1p(F.abs("x"))).alias("log1"), r6(F.exp(-F.col("x") / 100)).alias("e"))


@query(with_views("SELECT id, t, 'img_T' || lpad(CAST(t AS VARCHAR), 5, '0') AS name, regexp_full_match(CAST(nuc_id AS VARCHAR), '[0-9]+') AS digits FROM fx_traj", "fx_traj"))
def scalar_string(spark, d):
    return fx.traj(spark, d).select("id", "t", F.concat(F.lit("img_T"), F.lpad(F.col("t").cast("string"), 5, "0")).alias("name"), F.col("nuc_id").cast("string").rlike("^[0-9]+$").alias("digits"))
