"""Readers, writers, the stream and the whole pipelines."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import voxel
from trackweave.plans import pipeline
from trackweave.sources import blocks, readers, shared, volumes, writers
from trackweave.streaming import frames


@pytest.fixture
def movie(tmp_path):
    rng = np.random.default_rng(0)
    stacks = {t: rng.integers(0, 50, (2, 3, 4)).astype(np.uint16) for t in range(3)}
    for t, v in stacks.items():
        (tmp_path / f"a_C00_T{t:05d}.tif").write_bytes(volumes.encode_tiff(v))
        np.save(tmp_path / f"a_C01_T{t:05d}.npy", v + 1)
    return tmp_path, stacks


def test_tiff_round_trip():
    v = np.arange(2 * 3 * 5, dtype=np.int16).reshape(2, 3, 5) - 7
    assert (volumes.decode_tiff(volumes.encode_tiff(v)) == v).all()


def lzw(raw):
    """TIFF's LZW, written the plain way: bits as text."""
    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    bits = [f"{256:09b}"]
    for k in raw:
        if word + bytes([k]) in table:
            word += bytes([k])
            continue
        bits.append(f"{table[word]:0{width}b}")
        table[word + bytes([k])] = len(table) + 2
        width = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        word = bytes([k])
        if len(table) + 2 >= 4094:
            bits += [f"{table[word]:0{width}b}", f"{256:0{width}b}"]
            table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    bits += [f"{table[word]:0{width}b}"] if word else []
    if word and len(table) + 3 >= 1 << width:  # the reader has added a word by now
        width = min(12, width + 1)
    text = "".join(bits) + f"{257:0{width}b}"
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def packbits(raw):
    out = bytearray()
    for k in range(0, len(raw), 100):
        part = raw[k : k + 100]
        out += bytes([257 - len(part), part[0]]) if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return bytes(out)


def tiff(volume, packed=1, big=False, order="<", differences=False, rows=4):
    """A TIFF in strips of a few rows, by the specification."""
    squeeze = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[packed]
    pointer, entry = ("Q", 20) if big else ("I", 12)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    out = bytearray(head)
    for z, page in enumerate(volume):
        d = np.diff(page, axis=1, prepend=page.dtype.type(0)) if differences else page
        strips = [squeeze(d[r : r + rows].astype(page.dtype.newbyteorder(order)).tobytes()) for r in range(0, len(page), rows)]
        tags = [(256, [page.shape[1]]), (257, [page.shape[0]]), (258, [8 * page.dtype.itemsize]), (259, [packed]), (273, None), (277, [1]), (279, [len(s) for s in strips]), (317, [2 if differences else 1]), (339, [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]])]
        count = struct.calcsize(order + ("Q" if big else "H"))
        after = len(out) + count + entry * len(tags) + struct.calcsize(order + pointer)
        width = 8 if big else 4
        lists = 2 * len(strips) * width if len(strips) > 1 else 0
        begins = [after + lists + sum(map(len, strips[:k])) for k in range(len(strips))]
        out += struct.pack(order + ("Q" if big else "H"), len(tags))
        spill = b""
        for tag, values in tags:
            values = begins if values is None else values
            body = b"".join(struct.pack(order + pointer, v) for v in values)
            if len(body) > width:
                body, spill = struct.pack(order + pointer, after + len(spill)), spill + body
            out += struct.pack(order + "HH" + pointer, tag, 16 if big else 4, len(values)) + body
        end = after + len(spill) + sum(map(len, strips))
        out += struct.pack(order + pointer, end if z + 1 < len(volume) else 0) + spill + b"".join(strips)
    return bytes(out)


@pytest.mark.parametrize("packed", [1, 5, 8, 32773])
@pytest.mark.parametrize("big", [False, True])
def test_packed_tiff(packed, big):
    rng = np.random.default_rng(5)
    smooth = np.repeat(rng.integers(0, 3, (2, 9, 40)), 5, axis=2).astype(np.uint16)
    noise = rng.integers(-30000, 30000, (1, 60, 70)).astype(np.int16)  # fills the table of words more than once
    for v in (smooth, noise, smooth[:, :1, :1], smooth.astype(np.float32)):
        for order in "<>":
            for differences in (False, True)[: 1 if v.dtype.kind == "f" else 2]:
                got = volumes.decode_tiff(tiff(v, packed, big, order, differences, rows=60 if v is noise else 4))
                assert got.shape == v.shape and (got == v).all()


def test_tiff_with_images_behind_its_only_page_and_refused_ones():
    v = np.arange(2 * 3 * 5, dtype=np.uint16).reshape(2, 3, 5)
    said = b"ImageJ=1.53\nimages=2\n\0"
    tags = [(256, 4, 1, 5), (257, 4, 1, 3), (258, 4, 1, 16), (259, 4, 1, 1), (270, 2, len(said), 200), (273, 4, 1, 300), (277, 4, 1, 1), (279, 4, 1, 30)]
    raw = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    raw = raw.ljust(200, b"\0") + said
    assert (volumes.decode_tiff(raw.ljust(300, b"\0") + v.tobytes()) == v).all()
    for bad in (b"GIF89a" * 9, tiff(v).replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 7))):
        with pytest.raises(ValueError):
            volumes.decode_tiff(bad)


def test_volumes_by_file_and_by_source(spark, movie):
    path, stacks = movie
    rows = volumes.read_volumes(spark, str(path), frames=[1, 2], channel="C00")
    got = {(r.t, r.z, r.y, r.x): r.value for r in rows.collect()}
    assert got == {(t, z, y, x): int(stacks[t][z, y, x]) for t in (1, 2) for z in range(2) for y in range(3) for x in range(4)}
    spark.dataSource.register(volumes.VolumeSource)
    src = spark.read.format("volume").load(f"file://{path}").where("t = 1")
    assert src.count() == 2 * stacks[1].size and src.rdd.getNumPartitions() == 2
    assert spark.read.format("volume").option("foreground", "true").load(f"file://{path}").where("channel = 'C00'").count() == sum((v > 0).sum() for v in stacks.values())


def test_tracks_from_npy(spark, tmp_path):
    np.save(tmp_path / "tracks.npy", np.array([[1, 0, 0.5, 1.5, 2.5], [2, 3, 1, 2, 3]]))
    assert [tuple(r) for r in volumes.read_tracks(spark, str(tmp_path)).orderBy("id").collect()] == [(1, 0, 0.5, 1.5, 2.5), (2, 3, 1.0, 2.0, 3.0)]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("POSITION_T;POSITION_X\nT;X\nsec;um\n;\n0;1.5\n1;2.5\n")
    assert [tuple(r) for r in readers.read_exported(spark, str(tmp_path / "e.csv"), ["POSITION_T", "POSITION_X"], ";").orderBy("POSITION_T").collect()] == [(0.0, 1.5), (1.0, 2.5)]
    for t in range(2):
        (tmp_path / f"3D_T{t}.csv").write_text(f"id,t,x\n{t},{t},1.0\n")
    assert readers.read_points(spark, str(tmp_path / "3D_T*.csv"), "id long, t int, x double").count() == 2
    found = readers.discover_frames(readers.list_files(spark, str(tmp_path))).first()
    assert tuple(found) == (1, 2)
    (tmp_path / "edits_id7.txt").write_text("ID 8\n3: 7\n")
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path / "edits_id7.txt")).collect()] == [(7, "ID 8\n3: 7\n")]


def test_writers(spark, tmp_path):
    rows = spark.range(6).select("id", (F.col("id") % 3).cast("int").alias("t"))
    writers.write_table(rows, str(tmp_path / "p"), by_frame=True)
    assert spark.read.parquet(str(tmp_path / "p")).where("t = 1").count() == 2
    writers.write_points(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["id", "t"]


def test_stored_work_is_not_done_again(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [writers.stored(spark, str(tmp_path / "s"), make).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_config():
    text = '{"TrackerConfig": {"MotionModel": {"A": {"matrix": [1, 0, 0, 1]}}}}'
    assert readers.read_config(text)["MotionModel"]["A"]["matrix"] == [1, 0, 0, 1]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    for t in range(3):
        (tmp_path / f"in{t}.csv").write_text("cell_id,t,x\n" + "".join(f"1,{t},0.5\n" for _ in range(t + 1)))
    points = frames.stream_points(spark, str(tmp_path), "cell_id long, t int, x double", files_per_trigger=1)
    q = frames.into_table(points, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    q = frames.stream_counts(points).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.t, r.n) for r in spark.sql("select t, n from counts").collect()} == {(0, 1), (1, 2), (2, 3)}


def test_stream_counts_with_a_delay_forget_closed_frames(spark, tmp_path):
    for k, frames_ in enumerate([(0, 1, 0), (2, 1, 3), (9,), (30,), (4, 31)]):  # frame 4 comes after it was closed
        (tmp_path / f"in{k}.csv").write_text("cell_id,t,x\n" + "".join(f"1,{t},0.5\n" for t in frames_))
        os.utime(tmp_path / f"in{k}.csv", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age
    points = frames.stream_points(spark, str(tmp_path), "cell_id long, t int, x double", files_per_trigger=1)
    q = frames.into_table(frames.stream_counts(points, delay=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.t, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 2), (1, 2), (2, 1), (3, 1), (9, 1)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_missing_is_null_and_never_nan(spark, tmp_path):
    np.save(tmp_path / "tracks.npy", np.array([[1, 0, np.nan, 1.5, 2.5]]))
    assert [tuple(r) for r in volumes.read_tracks(spark, str(tmp_path / "tracks.npy")).collect()] == [(1, 0, None, 1.5, 2.5)]
    (tmp_path / "p.csv").write_text("id,t,x\n1,0,NaN\n2,0,\n3,0,1.5\n")
    assert sorted((r.id, r.x) for r in readers.read_points(spark, str(tmp_path / "p.csv"), "id long, t int, x double").collect()) == [(1, None), (2, None), (3, 1.5)]
    assert [tuple(r) for r in readers.read_exported(spark, str(tmp_path / "p.csv"), ["x", "id"]).collect()] == [(1.5, 3.0)]
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "C00_T00001.npy", np.array([[[np.nan, 2.0]]]))
    assert [r.value for r in volumes.read_volumes(spark, str(tmp_path / "v"), value="double").orderBy("x").collect()] == [None, 2.0]


def test_pipelines(spark):
    on = lambda t: {(0, 0, t), (1, 0, t), (0, 4, 4)}
    rows = [(t, z, y, x, 100 if (z, y, x) in on(t) else 0) for t in range(3) for z in range(2) for y in range(5) for x in range(5)]
    out = pipeline.volumes_to_tracks(spark.createDataFrame(rows, "t int, z int, y int, x int, value int"), max_dist=0.5)
    assert {r.n for r in out["tracks"].groupBy("id").agg(F.count("*").alias("n")).collect()} == {3}
    assert out["track_labels"].count() == 9
    pts = spark.createDataFrame([(i, 0, t, float(i + t), 1.0 * t * t, 2.0, 5.0 + t * i) for i in (1, 2, 3) for t in range(8)], "id long, cell_id long, t int, x double, y double, z double, fluo double")
    nuc = pts.where("id = 1").select("cell_id", "t", "id", "x", "y", "z")
    data = pipeline.analytics(pts, nuc.select("cell_id", "t", "x", "y", "z"))
    assert data["dense"].count() == 24 and data["persistence_raw"].count() > 0 and data["corr_angle_reg"].count() == 9
    edits = spark.createDataFrame([(0, "ID 2\n4: 3\n")], "cell_id long, text string")
    cand = spark.createDataFrame([(0, 0, 7, 0, 1)], "cell_id long, t_lo int, t_hi int, prio int, id long")
    got = pipeline.select_and_curate(pts.select("id", "t", "x", "y", "z"), nuc, cand, edits, [2], 1.5, 7)
    assert {(r.t, r.x) for r in got["curated"].collect()} == {(t, float((2 if t > 4 else 3) + t)) for t in range(8)}
    assert got["selected"].where("id = 3").count() == 0 and got["selected"].where("id = 2").count() == 8


@pytest.mark.parametrize("master,fine", [("local", True), ("local[4]", True), ("local-cluster[2,1,512]", False), ("yarn", False), ("spark://h:1", False)])
def test_shared_folder_is_never_a_machine_local_one(master, fine):
    class Context:
        at = None

        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return self.at

        def setCheckpointDir(self, at):
            self.at = at

    class Session:
        def __init__(self, **conf):
            self.conf, self.sparkContext = {k.replace("_", "."): v for k, v in conf.items()}, Context()

    if fine:
        assert shared.shared_dir(Session()) == "file:///tmp/checkpoints"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session())
    assert shared.shared_dir(Session(spark_checkpoint_dir="hdfs://n/x/")) == "hdfs://n/x"


@pytest.mark.parametrize("uri,want", [("s3a://b/x", "s3://b/x"), ("S3N://b/x", "s3://b/x"), ("s3://b/x", "s3://b/x"), ("file:///a", "file:///a"), ("hdfs://n/s3a://x", "hdfs://n/s3a://x"), ("/plain", "/plain")])
def test_uris_for_arrow(uri, want):
    assert shared.arrow_uri(uri) == want


@pytest.mark.parametrize("kind", ["tif", "npy"])
def test_written_volumes_are_read_back(spark, tmp_path, kind):
    rows = [(t, z, y, x, 100 * t + 10 * z + x - 5) for t in (2, 11) for z in range(2) for y in range(3) for x in range(4) if (z, y, x) != (0, 1, 1)]
    voxels = spark.createDataFrame(rows, "t int, z int, y int, x int, value int").withColumn("extra", F.lit("e"))
    folder = f"file://{tmp_path}/out"
    for _ in range(2):  # written again: the same files
        made = volumes.write_volumes(voxels, folder, kind=kind, channel="C02").collect()
    assert sorted(r.path for r in made) == [f"{folder}/C02_T{t:05d}.{kind}" for t in (2, 11)]
    assert sorted(p.name for p in (tmp_path / "out").glob("*") if not p.name.startswith((".", "_"))) == [f"C02_T{t:05d}.{kind}" for t in (2, 11)]
    got = {tuple(r) for r in volumes.read_volumes(spark, folder).select("channel", "t", "z", "y", "x", "value").collect()}
    assert got == {("C02", *r) for r in rows} | {("C02", t, 0, 1, 1, 0) for t in (2, 11)}
    assert volumes.write_volumes(voxels.limit(0), folder).count() == 0
    with pytest.raises(ValueError, match="kind"):
        volumes.write_volumes(voxels, folder, kind="hdf")


@pytest.mark.parametrize("kind", ["tif", "npy"])
def test_values_keep_their_type_or_are_refused(spark, tmp_path, kind):
    stacks = {"f4": np.array([[[0.25, 0.75], [1.9, -1.9]]], np.float32), "u4": np.array([[[3000000000, 0], [1, 2]]], np.uint32), "i2": np.array([[[-5, 7], [0, 1]]], np.int16)}
    for t, (name, v) in enumerate(stacks.items()):
        path = tmp_path / name
        path.mkdir()
        raw = path / f"C00_T{t:05d}.{kind}"
        np.save(raw, v) if kind == "npy" else raw.write_bytes(volumes.encode_tiff(v))
        for value in ("int", "long", "double"):
            read = lambda: [r.value for r in volumes.read_volumes(spark, str(path), value=value).orderBy("z", "y", "x").collect()]  # noqa: B023, E731
            if value == "double" or name == "i2" or (name, value) == ("u4", "long"):
                assert read() == v.ravel().tolist()
            else:
                with pytest.raises(Exception, match="do not fit"):
                    read()
    with pytest.raises(ValueError):
        volumes.read_volumes(spark, str(tmp_path), value="short")
    rows = spark.createDataFrame([(0, 0, 0, 0, 0.5), (0, 0, 0, 1, -2.25)], "t int, z int, y int, x int, value double")
    volumes.write_volumes(rows, f"file://{tmp_path}/out", kind=kind, dtype="f8")
    assert [r.value for r in volumes.read_volumes(spark, f"{tmp_path}/out", value="double").orderBy("x").collect()] == [0.5, -2.25]
    with pytest.raises(Exception, match="do not fit"):
        volumes.write_volumes(rows, f"file://{tmp_path}/out2", kind=kind)


def test_blocks_are_those_of_whole_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 900, (3, 70, 40)).astype(np.uint16)
    np.save(tmp_path / "C01_T00001.npy", v)
    (tmp_path / "C01_T00002.tif").write_bytes(volumes.encode_tiff(v))
    for t, (packed, step) in enumerate([(1, False), (5, True), (8, False), (32773, True)], 3):
        (tmp_path / f"C01_T{t:05d}.tif").write_bytes(tiff(v, packed, t == 4, "<", step, rows=9))
    (tmp_path / "notes.tif").write_bytes(b"no frame in the name")
    index = blocks.volume_index(spark, str(tmp_path)).cache()
    got = blocks.read_blocks(index).groupBy("t").agg(F.count("*"), F.sum(F.xxhash64("channel", *"zyx", "value").cast("decimal(38,0)")))
    want = volumes.read_volumes(spark, str(tmp_path)).groupBy("t").agg(F.count("*"), F.sum(F.xxhash64("channel", *"zyx", "value").cast("decimal(38,0)")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 6
    assert index.where("t = 1").count() == 9 and index.where("t = 4").count() == 24
    with pytest.raises(ValueError, match="C order"):
        list(blocks.npy_blocks(lambda at, n, raw=npy(np.asfortranarray(v)): raw[at : at + n]))


def npy(v):
    import io

    out = io.BytesIO()
    np.save(out, v)
    return out.getvalue()


def test_gather_reads_touched_blocks_only(spark, tmp_path):
    """All other bytes are spoilt: had they been decoded, the packed ones would raise and plain ones differ."""
    rng = np.random.default_rng(8)
    v = rng.integers(0, 900, (6, 128, 64)).astype(np.uint16)
    np.save(tmp_path / "C00_T00000.npy", v)
    (tmp_path / "C00_T00001.tif").write_bytes(tiff(v, 8, False, "<", True, rows=16))
    spots = spark.createDataFrame([(0, 1, 2, 10, 5), (1, 2, 3, 33, 60), (1, 3, 0, 0, 0), (9, 4, 0, 0, 0)], "t int, id int, z int, y int, x int")
    around = voxel.offsets()
    want = sorted(map(tuple, voxel.gather(spots, volumes.read_volumes(spark, str(tmp_path)).drop("channel"), around).collect()))
    index = blocks.volume_index(spark, str(tmp_path)).cache()
    index.count()
    places = spark.createDataFrame([(t, z + dz, y + dy) for t, _, z, y, _ in map(tuple, spots.collect()) for dz, dy, _ in around], "t int, z int, y int")
    used = blocks.touched(index, places).collect()
    kept = {(r.path.rsplit("/", 1)[-1], r["at"], r.bytes) for r in used}
    for f in ("C00_T00000.npy", "C00_T00001.tif"):
        raw = bytearray((tmp_path / f).read_bytes())
        for r in index.collect():
            if r.path.endswith(f) and (f, r["at"], r.bytes) not in kept:
                raw[r["at"] : r["at"] + r.bytes] = b"\xff" * r.bytes
        (tmp_path / f).write_bytes(raw)
    assert sorted(map(tuple, blocks.gather(spots, index, around).collect())) == want and len(want) > 150
    assert sum(r.bytes for r in used) < 0.25 * index.agg(F.sum("bytes")).first()[0]
    assert blocks.gather(spots, index, around, channel="C01").count() == 0


def test_small_voxels_do_not_meet_in_one_task(spark, tmp_path, monkeypatch, capsys):
    """Rows that pack well are dealt by number, and joins hold the spots' side only: neither sorts, nor broadcasts, the voxels."""
    monkeypatch.setattr(shared, "HELD", 100, raising=False)
    rows = [(t, z, y, x, 100 * t + 20 * z + 5 * y + x) for t in range(40) for z in range(2) for y in range(3) for x in range(4)]
    spots = [(t, t, t % 2, t % 3, t % 5) for t in range(40)] + [(1 << 40, 99, 0, 0, 0)]
    around, inside = voxel.offsets(), {r[:4]: r[4] for r in rows}
    want = sorted((t, i, inside[at]) for t, i, z, y, x in spots for dz, dy, dx in around if (at := (t, z + dz, y + dy, x + dx)) in inside)
    voxels = spark.createDataFrame(rows, "t int, z int, y int, x int, value int")
    made = volumes.write_volumes(voxels, f"file://{tmp_path}/out")
    assert made.count() == 40 and len(made.inputFiles()) > 4
    spots = spark.createDataFrame(spots, "t long, id int, z int, y int, x int")
    index = blocks.volume_index(spark, f"file://{tmp_path}/out")
    for got, exchanges in ((voxel.gather(spots, voxels, around), 2), (blocks.gather(spots, index, around), 4)):
        got.explain()
        plan = capsys.readouterr().out
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == exchanges  # frames of unlike types are dealt once
        assert got.dtypes == [("t", "bigint"), ("id", "int"), ("value", "int")] and sorted(map(tuple, got.collect())) == want
    listed = blocks.index_files(made)
    assert sorted(map(tuple, listed.drop("path").collect())) == sorted(map(tuple, index.drop("path").collect())) and listed.count() == 80
