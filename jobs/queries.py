"""The jobs as queries: each runs twice into one new folder and returns the output as it then stands. Beside them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import track_features, turn_series
from trackweave.sources.shared import shared_dir


def job1_track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        track_features.run(spark, track_features.DEFAULTS, f"{sf_dir}/events.parquet", f"{folder}/features", f"{folder}/checkpoint")
    return track_features.output_of(spark, f"{folder}/features")


def job2_turn_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        turn_series.run(spark, turn_series.DEFAULTS, f"{sf_dir}/conversations.parquet", folder)
    return turn_series.output_of(spark, folder)


QUERIES = {"job1_track_features": job1_track_features, "job2_turn_series": job2_turn_series}

XYZ = lambda f: ", ".join(f.format(c=c) for c in "xyz")
ORACLE = {
    "job1_track_features": f"""
WITH ev AS (SELECT DISTINCT event_id, user_id AS id, CAST(floor(user_id / 12.0) AS BIGINT) AS cell_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 21600) AS INTEGER) AS t, value AS x, value * 0.5 + event_id % 17 AS y, CAST(event_id % 29 AS DOUBLE) AS z
            FROM events WHERE event_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' AND user_id IS NOT NULL AND value IS NOT NULL),
pt AS (SELECT cell_id, id, t, {XYZ("round(avg({c}), 9) AS {c}")} FROM ev GROUP BY ALL),
fr AS (SELECT i.cell_id, i.id, CAST(unnest(generate_series(0, n.last)) AS INTEGER) AS t FROM (SELECT DISTINCT cell_id, id FROM pt) i JOIN (SELECT cell_id, max(t) AS last FROM pt GROUP BY 1) n ON n.cell_id = i.cell_id),
de AS (SELECT fr.*, pt.t IS NOT NULL AS present, x, y, z FROM fr LEFT JOIN pt ON pt.id = fr.id AND pt.t = fr.t),
st AS (SELECT *, {XYZ("round(avg({c}) OVER (PARTITION BY id ORDER BY t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 8) AS {c}_avg")}, {XYZ("{c} - lag({c}) OVER w AS d{c}")}, {XYZ("lead({c}) OVER w - {c} AS e{c}")}, t > 0 AND lead(t) OVER w IS NOT NULL AS inside FROM de WINDOW w AS (PARTITION BY id ORDER BY t)),
co AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS n, CASE WHEN inside THEN (dx*ex + dy*ey + dz*ez) / nullif(sqrt(dx*dx + dy*dy + dz*dz) * sqrt(ex*ex + ey*ey + ez*ez), 0) END AS cos FROM st),
kp AS (SELECT *, coalesce(cos >= 0.7, false) AS k FROM co),
gr AS (SELECT *, sum(CASE WHEN k THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) - CASE WHEN k THEN 0 ELSE 1 END AS run FROM kp),
rn AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY t) AS c FROM gr)
SELECT cell_id, id, t, present, {XYZ("round({c}, 8) AS {c}")}, x_avg, y_avg, z_avg, CASE WHEN cos IS NOT NULL THEN round(n, 6) END AS norm, CASE WHEN cos IS NOT NULL THEN round(acos(greatest(-1, least(1, cos))) / pi(), 6) END AS angle,
CASE WHEN cos IS NOT NULL THEN k END AS kept, CASE WHEN cos IS NOT NULL THEN CAST(c AS INTEGER) END AS place, CAST(cell_id % 16 AS INTEGER) AS bucket FROM rn""",
    "job2_turn_series": rf"""
WITH pt AS (SELECT conv_id, CAST(turn AS INTEGER) AS t, min(role) AS role, count(*) AS n_rows, CAST(sum(len(regexp_extract_all(text, '{turn_series.WORD}'))) AS DOUBLE) AS words FROM conversations WHERE conv_id IS NOT NULL AND turn >= 0 GROUP BY 1, 2),
fr AS (SELECT conv_id, CAST(unnest(generate_series(0, max(t))) AS INTEGER) AS t FROM pt GROUP BY 1),
de AS (SELECT fr.conv_id, fr.t, pt.t IS NOT NULL AS present, role, n_rows, words FROM fr LEFT JOIN pt ON pt.conv_id = fr.conv_id AND pt.t = fr.t),
nb AS (SELECT *, last_value(words IGNORE NULLS) OVER b AS prv, last_value(CASE WHEN words IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(words IGNORE NULLS) OVER a AS nxt, min(words) OVER (PARTITION BY conv_id) AS lo, max(words) OVER (PARTITION BY conv_id) AS hi,
       avg(words) OVER (PARTITION BY conv_id ORDER BY t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS av, words - lag(words) OVER (PARTITION BY conv_id ORDER BY t) AS change
       FROM de WINDOW b AS (PARTITION BY conv_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY conv_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT conv_id, t, present, role, n_rows, words, round(CASE WHEN words IS NOT NULL THEN words ELSE nxt + (prv - nxt) / pow(2, t - pt) END, 6) AS words_filled, round(av, 6) AS words_avg, round((words - lo) / nullif(hi - lo, 0), 6) AS scaled, change, CAST(conv_id % 16 AS INTEGER) AS part FROM nb""",
}
