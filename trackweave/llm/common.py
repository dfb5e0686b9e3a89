"""What several corpus operators share: the folder that all nodes see, written intermediate tables, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import WRITTEN, clear_intermediate, materialise, shared_dir  # noqa: F401  for the operators

FEW = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents. If it has fewer splits than there are cores, its rows are dealt evenly to all: the operators
    work long on each text. Large tables have more splits and are read as they are."""
    docs, n = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(n) if docs.rdd.getNumPartitions() < n else docs


def plain(df: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """df with columns beyond the known ones renamed to _own0, _own1, ...: names that clash with an operator's own or
    hold dots do no harm. The second value is what to give toDF() to have the old names back."""
    first = {c: df.columns.index(c) for c in known}
    return df.toDF(*[c if first.get(c) == k else f"_own{k}" for k, c in enumerate(df.columns)]), list(df.columns)


def ascii_lower(col):
    """Lower-cases A-Z alone; lower() would change other letters too."""
    return F.translate(col, UPPER, LOWER)


def id_of(df: DataFrame, name: str = "doc_id"):
    return F.col(name).cast("long").alias(name)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return run


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a part holds about most_bytes (one row at least): bounded memory for any text lengths."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts' UTF-8 bytes without decoding; null counts as empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i[k] and j[k] for all k; labels[x] is the smallest member of x's class before and after."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := labels[labels], labels):
            labels[:] = nxt


def join_hot(rows: DataFrame, sizes: DataFrame, key: str, by: str, total: int, salts: int = 32) -> DataFrame:
    """rows joined to sizes (key, c rows, ...; one row a key) by key, without c. Hot keys, those with over a 500th of `total`
    rows, are dealt over `salts` parts by the column `by`; as total counts all rows at least, there are fewer than 500 of them
    (below 32,000 rows fewer than total / 64), so their list may be broadcast."""
    hot = F.broadcast(sizes.where(F.col("c") > max(64, total // 500)).select(key, F.lit(salts).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts)).drop("parts")
    right = sizes.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts", "c")
    return left.join(right.hint("merge"), [key, "part"]).drop("part")


def united(edges: pa.Table) -> pa.Table:
    """For applyInArrow: edges (u, v) -> (u, v) with v the smallest node of u's component, for all but the smallest nodes."""
    u, v = (edges.column(c).to_numpy() for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    labels = np.arange(len(nodes))
    unite(labels, at[: len(u)], at[len(u) :])
    own = labels != np.arange(len(nodes))
    return pa.table({"u": nodes[own], "v": nodes[labels[own]]})


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(u, v) long edges -> (node, root): root is the smallest node of node's component; roots themselves are not listed.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins and aggregates; each round is written to
    the shared folder. Only a count and a checksum reach the driver. Up to FEW edges (a counted bound, some 2 MB) are joined by
    one task instead, which saves the rounds. Nulls and loops are ignored; no edges: no rows.
    """

    def stat(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, name)
    last = stat(e)
    if last[0] <= FEW:
        e = materialise(e.groupBy(F.lit("all")).applyInArrow(united, "u long, v long"), name)
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count("*").alias("c"), F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = join_hot(both, low, "u", "v", 2 * last[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), name)
        if (now := stat(e)) == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
