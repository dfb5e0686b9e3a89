"""Image and label volumes: one file per channel and frame, NPY or TIFF, as rows of voxels.

`read_volumes` reads through Spark's own file readers, so any store that Spark knows will do; `VolumeSource` is the same
as a data source (spark.read.format("volume")) whose partitions are files and whose frame filters prune files before
they are opened. Decoding turns one file into Arrow batches of at most SLAB voxels.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from ..model import TRACK_POINT, without_nan
from .shared import arrow_uri, materialise, tasks

VALUES = {"int": np.int32, "long": np.int64, "double": np.float64}
VOXELS = "channel string, t int, z int, y int, x int, value int"
NAME = re.compile(r"(?:(C\d+)_)?T(\d+)")
SLAB = 1 << 20
KINDS = {1: {8: "u1", 16: "u2", 32: "u4"}, 2: {8: "i1", 16: "i2", 32: "i4"}, 3: {32: "f4", 64: "f8"}}  # TIFF sample formats


def unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widened one code early; 256 clears, 257 ends."""
    clear, end = 256, 257
    words: list[bytes] = []
    out: list[bytes] = []
    held, bits, width, last = 0, 0, 9, b""
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == end:
            break
        if code == clear:
            words, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return b"".join(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}  # TIFF compression schemes
WIDTHS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}  # TIFF tag types


@dataclass(frozen=True)
class Page:
    """A page of a TIFF: its strips (offset, bytes), rows a strip, and how pixels are stored; `images` of equal shape follow one
    another in the only strip of a file that describes them in one page."""

    shape: tuple[int, int]
    dtype: np.dtype
    strips: list[tuple[int, int]]
    rows: int
    packed: int
    step: int
    images: int = 1


def tiff_pages(fetch: Callable[[int, int], bytes]) -> Iterator[Page]:
    """Pages of a TIFF or BigTIFF in strips, one sample a pixel: plain, deflated, LZW or packed bits, with or without
    differences along rows. fetch(at, n) gives n bytes of the file; only headers are fetched."""
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    pointer, count_of, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    take = lambda code, raw, at=0: struct.unpack_from(order + code, raw, at)
    read = lambda code, at: take(code, fetch(at, struct.calcsize(order + code)))
    at, first_page = take(pointer, head, 8 if big else 4)[0], True
    while at:
        n, first = read(count_of, at)[0], at + struct.calcsize(order + count_of)
        listed, tags = fetch(first, entry * n + inline), {}
        for begin in range(0, entry * n, entry):
            tag, form, count = take("HH" + pointer, listed, begin)
            if form in WIDTHS:
                code, width = WIDTHS[form]
                begin += entry - inline
                tags[tag] = read(f"{count}{code}", take(pointer, listed, begin)[0]) if width * count > inline else take(f"{count}{code}", listed, begin)
        at = take(pointer, listed, entry * n)[0]
        packed, step = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        if packed not in UNPACK or step not in (1, 2) or tags.get(277, (1,))[0] != 1 or 273 not in tags:
            raise ValueError("TIFF pages with tiles, several samples a pixel, or a compression other than deflate, LZW and packed bits are not supported")
        dtype = np.dtype(order + KINDS[tags.get(339, (1,))[0]][tags.get(258, (1,))[0]])
        if step == 2 and dtype.kind == "f":
            raise ValueError("differences of floats are not supported")
        shape = (tags[257][0], tags[256][0])
        said = re.search(rb"images=(\d+)", tags.get(270, (b"",))[0])
        images = int(said[1]) if said and packed == 1 and first_page and not at else 1
        first_page = False
        strips = list(zip(tags[273], tags[279], strict=True))
        rows = tags.get(278, (-(-shape[0] // len(strips)),))[0]  # files of several strips should say how high they are
        yield Page(shape, dtype, strips[:1] if images > 1 else strips, min(shape[0], rows), packed, step, images)


def unpack(raw: bytes, dtype: np.dtype, width: int, packed: int, step: int) -> np.ndarray:
    """The rows of a strip."""
    rows = np.frombuffer(UNPACK[packed](raw), dtype).reshape(-1, width)
    return np.cumsum(rows, axis=1, dtype=dtype.newbyteorder("=")) if step == 2 else rows


def decode_tiff(raw: bytes) -> np.ndarray:
    """A TIFF's pages stacked along z. A page whose description counts more images has these right behind it (plain only)."""
    pages = []
    for p in tiff_pages(lambda at, n: raw[at : at + n]):
        if p.images > 1:
            begin, size = p.strips[0][0], p.images * p.shape[0] * p.shape[1] * p.dtype.itemsize
            return np.frombuffer(raw[begin : begin + size], p.dtype).reshape(p.images, *p.shape)
        pages.append(np.concatenate([unpack(raw[o : o + c], p.dtype, p.shape[1], p.packed, p.step) for o, c in p.strips]).reshape(p.shape))
    return np.stack(pages)


def encode_tiff(volume: np.ndarray) -> bytes:
    """A (z, y, x) stack of numbers as an uncompressed little-endian TIFF."""
    pages = np.ascontiguousarray(volume.astype(volume.dtype.newbyteorder("<")))
    out = io.BytesIO()
    out.write(struct.pack("<2sHI", b"II", 42, 8))
    data_at = 8
    for k, page in enumerate(pages):
        raw, (h, w) = page.tobytes(), page.shape
        tags = [(256, w), (257, h), (258, 8 * page.dtype.itemsize), (259, 1), (262, 1), (273, data_at + 2 + 12 * 9 + 4), (277, 1), (279, len(raw)), (339, {"u": 1, "i": 2, "f": 3}[page.dtype.kind])]
        out.write(struct.pack("<H", len(tags)))
        for tag, value in tags:
            out.write(struct.pack("<HHII", tag, 4, 1, value))
        data_at += 2 + 12 * 9 + 4 + len(raw)
        out.write(struct.pack("<I", data_at if k + 1 < len(pages) else 0) + raw)
    return out.getvalue()


def voxels_of(value: str) -> str:
    if value not in VALUES:
        raise ValueError(f"values are read as {', '.join(VALUES)}, not {value}")
    return VOXELS.removesuffix("int") + value


def as_values(stored: np.ndarray, value: str) -> np.ndarray:
    """Stored numbers as the wanted kind; what that kind cannot hold raises and is never cut. NaN becomes NULL in rows_of."""
    if value != "double" and stored.size:
        most = np.iinfo(VALUES[value])
        if stored.dtype.kind == "f" or stored.max() > most.max or stored.min() < most.min:
            raise ValueError(f"{stored.dtype} values do not fit {value}: read them as {'double' if stored.dtype.kind == 'f' else 'long or double'}")
    return stored.astype(VALUES[value])


def decode(name: str, raw: bytes) -> np.ndarray:
    volume = np.load(io.BytesIO(raw), allow_pickle=False) if name.endswith(".npy") else decode_tiff(raw)
    return volume[None] if volume.ndim == 2 else volume


def rows_of(channel: str | None, t: int, z: np.ndarray, y: np.ndarray, x: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    i4 = lambda a: pa.array(np.asarray(a).astype(np.int32))
    return pa.record_batch([pa.array([channel] * len(z), pa.string()), i4(np.full(len(z), t)), i4(z), i4(y), i4(x), pa.array(value, from_pandas=True)], ["channel", "t", "z", "y", "x", "value"])


def batches(name: str, raw: bytes, foreground: bool, kind: str = "int") -> Iterator[pa.RecordBatch]:
    """Voxels of one file; with foreground only those that are not 0. Names without a frame give none."""
    m = NAME.search(name)
    if not m:
        return
    volume = decode(name, raw)
    step = max(1, SLAB // max(1, volume[0].size))
    for z0 in range(0, len(volume), step):
        slab = volume[z0 : z0 + step]
        z, y, x = np.nonzero(slab) if foreground else (a.ravel() for a in np.indices(slab.shape))
        yield rows_of(m[1], int(m[2]), z + z0, y, x, as_values(slab[z, y, x] if foreground else slab.ravel(), kind))


def read_volumes(spark: SparkSession, path: str, frames: list[int] | None = None, channel: str | None = None, foreground: bool = False, value: str = "int") -> DataFrame:
    """Voxels of all volumes under path, their values as int, long or double: what the kind cannot hold raises. Files of other
    frames or channels are dropped by name before their bytes are read."""
    schema = voxels_of(value)
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), "content")
    if frames is not None:
        files = files.where(F.regexp_extract("name", r"T(\d+)", 1).try_cast("int").isin(frames))
    if channel is not None:
        files = files.where(F.contains("name", F.lit(f"{channel}_")))

    def run(rows):
        for b in rows:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from batches(name, raw, foreground, value)

    return files.mapInArrow(run, schema)


def write_volumes(voxels: DataFrame, folder: str, kind: str = "tif", channel: str = "C00", dtype: str = "i4") -> DataFrame:
    """Writes one volume a frame, as TIFF or NPY, named by channel and frame, and returns the written list (t, path, bytes).
    A volume reaches from 0 to the greatest z, y and x of its frame; places without a voxel hold 0. A frame is one file, so
    one group. Each attempt writes a file of its own and moves it into place: a frame that is written again replaces itself. A value
    that dtype cannot hold raises. Voxels are counted first, as tasks sort theirs by frame: each gets some frames of HELD voxels in all."""
    if kind not in ("tif", "npy"):
        raise ValueError(f"no such kind of volume: {kind}")

    def run(rows: pa.Table) -> pa.Table:
        from pyarrow import fs

        t, *at, value = (rows.column(c).to_numpy() for c in ("t", "z", "y", "x", "value"))
        volume = np.zeros([int(a.max()) + 1 for a in at], dtype)
        volume[tuple(at)] = value.astype(dtype)
        if not np.array_equal(volume[tuple(at)], value):
            raise ValueError(f"values of frame {int(t[0])} do not fit {dtype}")
        out = io.BytesIO()
        if kind == "npy":
            np.save(out, volume)
        raw = out.getvalue() if kind == "npy" else encode_tiff(volume)
        system, base = fs.FileSystem.from_uri(arrow_uri(folder))
        system.create_dir(base, recursive=True)
        name = f"{channel}_T{int(t[0]):05d}.{kind}"
        draft = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(draft, compression=None) as f:
            f.write(raw)
        system.move(draft, f"{base}/{name}")
        return pa.table({"t": pa.array([int(t[0])], pa.int64()), "path": [f"{folder}/{name}"], "bytes": pa.array([len(raw)], pa.int64())})

    rows = voxels.select(F.col("t").cast("long").alias("t"), *[F.col(c).cast("int").alias(c) for c in "zyx"], "value")
    n, frames = rows.agg(F.count("*"), F.approx_count_distinct("t")).first()
    n = min(max(tasks(n), rows.sparkSession.sparkContext.defaultParallelism), frames) or 1
    return materialise(rows.repartition(n, "t").groupBy("t").applyInArrow(run, "t long, path string, bytes long"), "volume-list")


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.foreground = options["path"], options.get("foreground", "false").lower() == "true"
        self.value = options.get("value", "int")
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("t",) and isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThanOrEqual)):
                self.tests.append(f)
            yield f  # Spark checks again: pruning only skips files

    def wanted(self, t: int) -> bool:
        for f in self.tests:
            v = f.value
            if isinstance(f, EqualTo) and t != v or isinstance(f, In) and t not in v or isinstance(f, GreaterThanOrEqual) and t < v or isinstance(f, LessThanOrEqual) and t > v:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(arrow_uri(self.path))
        names = [i.path for i in system.get_file_info(fs.FileSelector(base)) if i.is_file]
        return [FilePartition(p) for p in sorted(names) if (m := NAME.search(p.rsplit("/", 1)[-1])) and self.wanted(int(m[2]))]

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(arrow_uri(self.path))
        with system.open_input_stream(partition.path) as f:
            yield from batches(partition.path.rsplit("/", 1)[-1], f.read(), self.foreground, self.value)


class VolumeSource(DataSource):
    """spark.dataSource.register(VolumeSource); spark.read.format("volume").load(uri) with filters on t; the session needs
    spark.sql.python.filterPushdown.enabled for pruning."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return voxels_of(self.options.get("value", "int"))

    def reader(self, schema):
        return VolumeReader(self.options)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """N x 5 matrices (ID, T, Z, Y, X) stored as NPY -> track points; NaN is NULL."""

    def run(rows):
        for b in rows:
            for raw in b.column(0).to_pylist():
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pa.record_batch([pa.array(m[:, 0].astype(np.int64)), pa.array(m[:, 1].astype(np.int32)), *(pa.array(m[:, k].astype(np.float64)) for k in (2, 3, 4))], ["id", "t", "z", "y", "x"])

    return without_nan(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, TRACK_POINT))
