"""A block index of volumes: where in its file every strip of every plane lies. Queries that need voxels around some places read
the strips that these touch and nothing else; other bytes are neither read, decoded nor shuffled.

The index comes from file headers alone (TIFF and NPY in C order) and is a small table that can be written and kept: it stays right as
long as the files do. Planes that are stored plainly are cut into bands of at most BAND rows, others into the strips that they
were packed in. Files are opened by pyarrow's file systems, as byte ranges have no reader of Spark's own.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import voxel
from .shared import arrow_uri, dealt, spread
from .volumes import NAME, as_values, rows_of, tiff_pages, unpack, voxels_of

BAND = 32
FILES = 1000  # whose headers a task reads
PACK = 1 << 16  # voxels that leave a task at once
INDEX = "path string, channel string, t int, z int, y0 int, rows int, width int, at long, bytes long, dtype string, packed int, step int"
Block = tuple[int, int, int, int, int, int, str, int, int]


def bands(z: int, shape: tuple[int, int], y0: int, rows: int, at: int, dtype: np.dtype) -> Iterator[Block]:
    """Plainly stored rows y0 .. y0 + rows of a plane, in bands."""
    line = shape[1] * dtype.itemsize
    for y in range(y0, y0 + rows, BAND):
        n = min(BAND, y0 + rows - y)
        yield z, y, n, shape[1], at + (y - y0) * line, n * line, dtype.str, 1, 1


def npy_blocks(fetch: Callable[[int, int], bytes]) -> Iterator[Block]:
    major = fetch(6, 1)[0]
    size, code = (2, "<H") if major == 1 else (4, "<I")
    n = struct.unpack(code, fetch(8, size))[0]
    head = ast.literal_eval(fetch(8 + size, n).decode("latin1"))
    dtype, shape, at = np.dtype(head["descr"]), head["shape"], 8 + size + n
    if head["fortran_order"] or len(shape) not in (2, 3):
        raise ValueError("only NPY stacks of planes in C order are indexed")
    depth, h, w = (1, *shape)[-3:]
    for z in range(depth):
        yield from bands(z, (h, w), 0, h, at + z * h * w * dtype.itemsize, dtype)


def tiff_blocks(fetch: Callable[[int, int], bytes]) -> Iterator[Block]:
    z = 0
    for page in tiff_pages(fetch):
        h, w = page.shape
        if page.images > 1:
            for k in range(page.images):
                yield from bands(k, page.shape, 0, h, page.strips[0][0] + k * h * w * page.dtype.itemsize, page.dtype)
            return
        for s, (at, n) in enumerate(page.strips):
            y0, rows = s * page.rows, min(page.rows, h - s * page.rows)
            if page.packed == page.step == 1:
                yield from bands(z, page.shape, y0, rows, at, page.dtype)
            else:
                yield z, y0, rows, w, at, n, page.dtype.str, page.packed, page.step
        z += 1


def opened(path: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(arrow_uri(path))
    return system.open_input_file(base)


def volume_index(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all volumes under path, a row each. Files whose names lack a frame have none."""
    return index_files(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")))


def index_files(files: DataFrame) -> DataFrame:
    """volume_index of listed files (path), such as the list that write_volumes returns: then nothing lists a folder anew, which Spark
    does on the driver."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                m = NAME.search(uri.rsplit("/", 1)[-1])
                if not m:
                    continue
                with opened(uri) as f:
                    blocks = list((npy_blocks if uri.endswith(".npy") else tiff_blocks)(lambda at, n, f=f: f.read_at(n, at)))
                columns = [[uri] * len(blocks), [m[1]] * len(blocks), [int(m[2])] * len(blocks), *zip(*blocks, strict=True)] if blocks else [[]] * 12
                kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return spread(files.select("path"), FILES).mapInArrow(run, INDEX)


def touched(index: DataFrame, places: DataFrame) -> DataFrame:
    """The blocks that hold any of the places (t, z, y)."""
    p, index = dealt(places.select(F.col("t").try_cast("int").alias("t"), "z", F.col("y").alias("_y")), index, ["t", "z"], places.count())
    p = p.distinct()
    inside = (index["t"] == p["t"]) & (index["z"] == p["z"]) & (p["_y"] >= index["y0"]) & (p["_y"] < index["y0"] + index["rows"])
    return index.join(p, inside, "left_semi")


def packed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []


def read_blocks(blocks: DataFrame, value: str = "int") -> DataFrame:
    """Voxels (channel, t, z, y, x, value) of blocks of an index; each block is one byte range of its file."""
    schema = voxels_of(value)

    def run(batches):
        for batch in batches:
            at = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            places, held, size = {}, [], 0
            for k, uri in enumerate(at["path"]):
                places.setdefault(uri, []).append(k)
            for uri, mine in places.items():
                with opened(uri) as f:
                    for k in mine:
                        rows = unpack(f.read_at(at["bytes"][k], at["at"][k]), np.dtype(at["dtype"][k]), at["width"][k], at["packed"][k], at["step"][k])
                        y, x = (a.ravel() for a in np.indices(rows.shape))
                        held.append(rows_of(at["channel"][k], at["t"][k], np.full(rows.size, at["z"][k]), y + at["y0"][k], x, as_values(rows.ravel(), value)))
                        size += rows.size
                        if size >= PACK:
                            yield from packed(held)
                            held, size = [], 0
            yield from packed(held)

    return blocks.mapInArrow(run, schema)


def gather(spots: DataFrame, index: DataFrame, around: list[tuple[int, int, int]], channel: str | None = None, value: str = "int") -> DataFrame:
    """voxel.gather(spots, the voxels of the index's files, around): (t, id, value) of the voxels around each spot (t, id, z, y, x),
    read from the blocks that the spots' surroundings touch."""
    index = index if channel is None else index.where(F.col("channel") == channel)
    near = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(y).alias("y")) for z, y in sorted({d[:2] for d in around})]))
    places = spots.select("t", *"zy", near.alias("d")).select("t", *[(F.col(c) + F.col(f"d.{c}")).cast("int").alias(c) for c in "zy"])
    return voxel.gather(spots, read_blocks(touched(index, places), value).drop("channel"), around)
