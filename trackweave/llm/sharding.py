"""Contiguous shards of nearly equal bytes: global prefix sums of sizes from per-partition totals, cut at equal targets.

A document weighs its text's UTF-8 bytes plus HEAD (null: HEAD alone). Narrow rows (id, size, checksum) are written once and
dealt by ranges of (doc_id, size, checksum); each range's total is one row, and the running sum of these few rows gives every range
its offset in bytes and in rows. Within a range a running sum goes on from there. A document belongs to the shard in which
the middle of its bytes falls when all bytes are cut into equal parts, so a shard differs from the target by less than one document
at its two ends. Its slot counts on from the shard's first row. Only range totals (a row a shuffle partition) and shard starts (a
row a shard) meet in one place or are broadcast; `write_shards` moves texts once, by shard and slot, in as many files as fit.

The law is `bytes`: equal texts are not kept together, and a different number of shards cuts everywhere anew.

Nulls and edges: a null text has checksum 0, as an empty one has. Null ids come first. Rows that repeat an id are documents of their
own, ordered by size, checksum and place; a row number spreads any number of equal rows over ranges. A document larger than a
shard's share leaves some shards empty. Empty tables give no rows. Extra columns are not read by `sharded` and kept by `write_shards`
in a struct of their own, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, materialise, table

HEAD, SHARDS = 16, 40
KEYS = ("doc_id", "size", "text_crc32", "row")


def weighed(docs: DataFrame, id_col: str, text_col: str):
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + HEAD
    return id_of(docs, id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32")


def places(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of KEYS -> the same with shard and slot."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    ranges = materialise(rows.repartitionByRange(*KEYS).withColumn("part", F.spark_partition_id()), "shard-ranges")
    totals = ranges.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("part", sum_of("bytes").alias("at_byte"), sum_of("rows").alias("at_row"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    own = Window.partitionBy("part").orderBy(*KEYS)
    here = ranges.select(*KEYS, "part", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("end"), F.row_number().over(own).alias("nth"))
    middle = 2 * (F.col("at_byte") + F.col("end")) - F.col("size")  # twice the middle's offset
    out = here.join(F.broadcast(offsets), "part").select(*KEYS, (F.col("at_row") + F.col("nth") - 1).alias("nth"), F.expr("2 * all_bytes").alias("whole"), middle.alias("middle"))
    out = materialise(out.select(*KEYS, "nth", F.expr(f"cast(middle * {shards} div whole as int)").alias("shard")), "shard-places")
    starts = out.groupBy("shard").agg(F.min("nth").alias("first"))  # one row a shard
    return out.join(F.broadcast(starts), "shard").select(*KEYS, "shard", (F.col("nth") - F.col("first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row a document."""
    rows = docs.select(*weighed(docs, id_col, text_col), F.monotonically_increasing_id().alias("row"))
    return places(materialise(rows, "shard-sizes"), shards).drop("row")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (slot, doc: all columns of the document) to folder, one folder a shard; a shard's files hold consecutive slots."""
    rows = docs.select(*weighed(docs, id_col, text_col), F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    rows = materialise(rows, "shard-texts")
    at = places(rows.select(*KEYS), shards).select("row", "shard", "slot")
    out = rows.select("row", "doc").join(at, "row").select("shard", "slot", "doc")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(folder)


def op11(spark, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute(rows: list[tuple], shards: int = SHARDS) -> list[tuple]:
    """(doc_id, text) -> (doc_id, size, crc, shard, slot), for tests."""
    from zlib import crc32

    sized = sorted((i is not None, i or 0, HEAD + len((t or "").encode()), crc32((t or "").encode())) for i, t in rows)
    total, at, out, slots = sum(r[2] for r in sized), 0, [], [0] * shards
    for known, i, size, crc in sized:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return out


# The checksum by its rule: a table of 256 entries, then byte by byte.
SQL = f"""
WITH crc AS (SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) r(n)),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {HEAD} AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda c, x: xor(tab[CAST(xor(c & 255, x) AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32 FROM b CROSS JOIN crc),
o AS (SELECT *, row_number() OVER k AS nth, CAST(sum(size) OVER k AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS whole FROM d WINDOW k AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST((2 * upto - size) * {SHARDS} // (2 * whole) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
