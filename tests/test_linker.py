"""The stream linker against the batch operators, over shuffled arrival."""

import os
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from trackweave.operators import linking
from trackweave.streaming import linker

SCHEMA = "movie string, t int, id long, x double, y double, z double"


def made_movies(frames=30):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for movie in "ab":
        at = rng.uniform(0, 60, (6, 3))
        for t in range(frames if movie == "a" else frames // 2):
            at = at + rng.normal(0, 1.5, at.shape)
            for p in at:
                if rng.random() < 0.9 and not (movie == "a" and t == 11):  # a frame without points ends all chains
                    rows.append((movie, t, n, *np.round(p, 3).tolist()))
                    n += 1
    return rows


@pytest.mark.parametrize("files", [3, 8])
def test_stream_equals_batch_over_shuffled_arrival(spark, tmp_path, files):
    rows = [*made_movies(), ("a", 3, 10_000, None, 1.0, 1.0)]
    rng = random.Random(files)
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 4))  # up to four frames late, frames in pieces
    own = linker.with_state_store(spark)
    size = -(-len(late) // files)
    for k in range(0, len(late), size):
        own.createDataFrame(late[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = linker.stream_chains(own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "movie", 8.0, delay=6)

    def run():
        started = q.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        started.awaitTermination(200)
        return started

    run()
    early = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < early < len(rows)
    own.createDataFrame([("a", 1000, None, None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done = run()  # goes on from the checkpoint
    table = spark.createDataFrame(rows, SCHEMA)
    links = linking.mutual_links(table, 8.0, ["movie"])
    want = {(r.id, r.t, r.head, r.place) for r in linking.chains(table, links).collect()}
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.id, r.t, r.head, r.place) for r in got} == want and len(got) == len(rows)
    assert max(p for *_, p in want) > 8
    assert done.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # two movies: no points are held any more


def test_mutual_neighbours_against_all_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, (30, 3)).astype(float), rng.integers(0, 6, (25, 3)).astype(float)  # many ties
    a[3] = np.nan
    a_id, b_id = rng.permutation(30), rng.permutation(25)
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    d = np.where(d < 3, d, np.inf)
    first = [min(((d[i, j], b_id[j], j) for j in range(25) if d[i, j] < 3), default=(0, 0, None))[2] for i in range(30)]
    back = [min(((d[i, j], a_id[i], i) for i in range(30) if d[i, j] < 3), default=(0, 0, None))[2] for j in range(25)]
    i, j = linker.mutual(a, a_id, b, b_id, 3.0)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(k, first[k]) for k in range(30) if first[k] is not None and back[first[k]] == k]


def test_the_closing_row_comes_after_all_files(spark, monkeypatch):
    """Twelve files of points, and a closing row whose file looks older than all of them."""
    from trackweave.plans import queries

    points, start, d = queries.spots, queries.frames.into_table, "/root/testdata/sf0.001"

    def aged(stream, path, checkpoint):
        folder = path.removeprefix("file://").removesuffix("/out") + "/in"
        for f in (f for f in os.listdir(folder) if f.endswith(".parquet") and pq.read_table(f"{folder}/{f}", columns=["id"])["id"].null_count):
            os.utime(f"{folder}/{f}", (time.time() - 3600,) * 2)
        return start(stream, path, checkpoint)

    monkeypatch.setattr(queries, "spots", lambda s, d: points(s, d).repartition(12))
    monkeypatch.setattr(queries.frames, "into_table", aged)
    got = queries.QUERIES["stream_track_chains"](spark, d).collect()
    monkeypatch.undo()
    want = queries.QUERIES["track_chains"](spark, d).collect()
    assert sorted((r.id, r.t, r.head, r.place) for r in got) == sorted((r.id, r.t, r.head, r.place) for r in want)
