"""Domain views derived from the benchmark tables: sparse trajectories, points, voxels, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as spots, about twelve to a cell, events as frames; every seventh event is missing."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.col("event_id")
    return e.withColumn("t", t).where(k % 7 != 0).select(
        F.col("user_id").alias("id"), F.floor(F.col("user_id") / 12.0).cast("long").alias("cell_id"), "t",
        F.col("value").alias("x"), (F.col("value") * 0.5 + k % 17).alias("y"), (k % 29).cast("double").alias("z"), F.col("value").alias("fluo"),
        F.when(k % 11 != 0, k % 3 + 1).alias("nuc_id"), F.when(k % 11 != 0, F.col("value") / 10).alias("dist_nuc"),
    )


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 100
    kind = F.when(F.col("vec_id") % 5 == 0, "nucleus").otherwise("spot")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("t"), kind.alias("kind"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's 64 values as one array per row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000).cast("int")).alias("values"))


def voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).select("t", F.posexplode("values").alias("i", "value"))
    return rows.select("t", "i", F.floor(F.col("i") / 16.0).cast("int").alias("z"), (F.floor(F.col("i") / 4.0) % 4).cast("int").alias("y"), (F.col("i") % 4).alias("x"), "value")


def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel(spark, sf_dir).withColumn("label", F.when(F.col("value") < 50, 0).otherwise(1 + F.col("value") % 3))


def block_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spot per block, at a voxel that its id gives."""
    v = F.col("vec_id")
    place = lambda d: (F.floor(v / float(d)) % 4).cast("int")
    return table(spark, sf_dir, "embeddings").select(v.alias("t"), v.alias("id"), place(1).alias("z"), place(4).alias("y"), place(16).alias("x"))


SQL = {
    "fx_traj": """SELECT user_id AS id, CAST(floor(user_id/12.0) AS BIGINT) AS cell_id, CAST(t AS INT) AS t, value AS x, value*0.5 + event_id%17 AS y,
CAST(event_id%29 AS DOUBLE) AS z, value AS fluo, CASE WHEN event_id%11=0 THEN NULL ELSE event_id%3+1 END AS nuc_id, CASE WHEN event_id%11=0 THEN NULL ELSE value/10 END AS dist_nuc
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS t FROM events) e WHERE event_id%7<>0""",
    "fx_point": """SELECT vec_id AS id, label AS t, CASE WHEN vec_id%5=0 THEN 'nucleus' ELSE 'spot' END AS kind, CAST(embedding[1] AS DOUBLE)*100 AS x,
CAST(embedding[2] AS DOUBLE)*100 AS y, CAST(embedding[3] AS DOUBLE)*100 AS z FROM embeddings""",
    "fx_voxel": """SELECT t, CAST(i AS INT) AS i, CAST(floor(i/16.0) AS INT) AS z, CAST(floor(i/4.0) AS INT) % 4 AS y, CAST(i % 4 AS INT) AS x, value
FROM (SELECT vec_id AS t, unnest(generate_series(0, len(embedding)-1)) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE)*1000) AS INT) AS value FROM embeddings)""",
    "fx_label": "SELECT *, CASE WHEN value < 50 THEN 0 ELSE 1 + value % 3 END AS label FROM fx_voxel",
    "fx_spot": """SELECT vec_id AS t, vec_id AS id, CAST(floor(vec_id/1.0) AS BIGINT) % 4 AS z, CAST(floor(vec_id/4.0) AS BIGINT) % 4 AS y, CAST(floor(vec_id/16.0) AS BIGINT) % 4 AS x FROM embeddings""",
    "spine": "SELECT CAST(unnest(generate_series(0, (SELECT max(t) FROM fx_traj))) AS INT) AS t",
    "dense": """SELECT i.id, i.cell_id, s.t, f.x, f.y, f.z, f.fluo, f.nuc_id, f.dist_nuc FROM (SELECT DISTINCT id, cell_id FROM fx_traj) i CROSS JOIN spine s
LEFT JOIN fx_traj f ON f.id = i.id AND f.t = s.t""",
    "steps": """SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey, lead(z) OVER w - z AS ez,
lead(t) OVER w AS tn FROM dense WINDOW w AS (PARTITION BY id ORDER BY t)""",
    "dirs": """SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS norm, (dx*ex+dy*ey+dz*ez) / nullif(sqrt(dx*dx+dy*dy+dz*dz)*sqrt(ex*ex+ey*ey+ez*ez), 0) AS cos FROM steps""",
    "angles": "SELECT *, acos(CASE WHEN cos > 1 THEN 1.0 WHEN cos < -1 THEN -1.0 ELSE cos END) / pi() AS angle, t >= 1 AND tn IS NOT NULL AS inside FROM dirs",
    "flags": "SELECT id, cell_id, t, cos, coalesce(cos >= 0.7, false) AS kept FROM angles WHERE inside",
    "grouped": "SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) - CASE WHEN kept THEN 0 ELSE 1 END AS run FROM flags",
    "runs": "SELECT id, cell_id, t, cos, kept, row_number() OVER (PARTITION BY id, run ORDER BY t) AS c FROM grouped",
}
NEEDS = {"fx_label": ["fx_voxel"], "spine": ["fx_traj"], "dense": ["fx_traj", "spine"], "steps": ["dense"], "dirs": ["steps"], "angles": ["dirs"], "flags": ["angles"], "grouped": ["flags"], "runs": ["grouped"]}


def with_views(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """body under the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra]
    return f"WITH {', '.join(parts)} {body}"
