"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter direction is a concatenation of one codeword from each of m random codes, one code per block of the rotated
coordinates (Becker, Ducas, Gama and Laarhoven 2016). A vector is list-decoded to all filters whose product with it
exceeds a threshold: the blocks' products are sorted and combinations pruned as soon as the best rest cannot reach it.
The threshold is calibrated on random vectors to give `per_vector` filters on average at any depth m, and the number of
filters grows with the rows of the largest label so that a bucket holds about `per_bucket` chance members. Vectors that no
filter reaches take their `per_vector` best ones.

Only (filter, vector's hash, 128 sign bits) goes to the filters. Members of a filter whose bits differ by at most BITS are
candidates; a bucket emits a spanning star of them. Vectors themselves are sent once, to their candidate component, where
all pairs are verified by cosine in double precision, in tiles, and counted; a pair stands in one component, so it is counted
once. Filters and components of more than TILE members are dealt as pairs of tiles to several tasks. Which filters are that
crowded is read off a sample of the vectors, by hash; that decides only where pairs are compared, not which.

Equal vectors of a label are one node (its 64-bit hash); each task sends a node's filters once, so an often repeated vector
is no hot row. Recall is measured against brute force in the tests.

Nulls and edges: vectors that are null, zero or hold null or non-finite components, and rows with a null label or id,
link with nothing: n_links 0, component their own id, kept. Only vectors of equal length are compared. Rows that repeat
an id count as vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_hot, materialise, table, unite

TILE = 2048
BITS = 22  # of 128 sign bits; at cosine 0.98 some 8.2 differ, with a deviation of 2.8
SAMPLE = 64  # one of so many vectors tells which filters are crowded
MOST_HOT = 10_000  # a filter is listed as crowded from this part of all entries on, so the broadcast list is no longer than that


class ProductCode:
    def __init__(self, dim: int, n_classes: int, per_vector: int, per_bucket: int, seed: int = 7):
        want = max(64.0, per_vector * n_classes / per_bucket)
        self.m = m = min(dim, next(k for k in (2, 3, 4, 5, 6, 7, 8) if want ** (1 / k) <= 256 or k == 8))
        self.size = size = int(np.ceil(want ** (1 / m)))
        rng = np.random.default_rng(seed + dim)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [round(dim * k / m) for k in range(m + 1)]
        codes = [rng.standard_normal((size, b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(m) for c in codes]
        self.planes = rng.standard_normal((dim, 128))
        self.best = int(min(per_vector, size))
        self.least = self.calibrated(min(per_vector, 0.4 * size**m), rng)

    def products(self, y: np.ndarray) -> list[np.ndarray]:
        return [y[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes, strict=False)]

    def calibrated(self, per_vector: float, rng, n: int = 512, grid: int = 4096) -> float:
        """The threshold at which a random unit vector gets `per_vector` filters on average, `best` ones where none exceeds it.
        The sums over all combinations of code words are counted by convolution of the blocks' histograms, as there are too
        many to list."""
        y = rng.standard_normal((n, self.rotation.shape[0]))
        blocks, width = self.products(y / np.linalg.norm(y, axis=1, keepdims=True)), 2 * grid
        given = np.zeros(grid)
        for k in range(n):
            spectrum = np.ones(grid + 1, complex)
            for p in blocks:
                at = np.round(p[k] * (grid // 2)).astype(np.int64) % width
                spectrum *= np.fft.rfft(np.bincount(at, minlength=width))
            above = np.cumsum(np.fft.irfft(spectrum, width)[:grid][::-1])[::-1]  # by sums of 0 and more
            given += np.where(above < 0.5, self.best, above) / n
        return float((np.flatnonzero(given > per_vector * 1.05)[-1] + 0.5) / (grid // 2))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors x exceed; sorted by row, then filter."""
        products = self.products(x @ self.rotation)
        rest = np.zeros((len(x), self.m + 1))  # what the blocks from k on can still add
        for k in range(self.m - 1, -1, -1):
            rest[:, k] = rest[:, k + 1] + products[k].max(axis=1)
        row = np.flatnonzero(rest[:, 0] >= self.least)
        score, name = np.zeros(len(row)), np.zeros(len(row), np.int64)
        for k, p in enumerate(products):
            at, word = np.nonzero(score[:, None] + p[row] + rest[row, k + 1][:, None] >= self.least)
            row, score, name = row[at], score[at] + p[row[at], word], name[at] * self.size + word
        none = np.setdiff1d(np.arange(len(x)), row)
        if len(none):
            best = self.best_of([p[none] for p in products])
            row, name = np.concatenate([row, np.repeat(none, best.shape[1])]), np.concatenate([name, best.ravel()])
        order = np.lexsort((name, row))
        return row[order], name[order]

    def best_of(self, products: list[np.ndarray]) -> np.ndarray:
        """The `best` filters of each row: the best sums of two blocks are among the sums of each one's best."""
        score, name = np.zeros((len(products[0]), 1)), np.zeros((len(products[0]), 1), np.int64)
        for p in products:
            word = np.argsort(-p, axis=1, kind="stable")[:, : self.best]
            both = (score[:, :, None] + np.take_along_axis(p, word, 1)[:, None, :]).reshape(len(p), -1)
            names = (name[:, :, None] * self.size + word[:, None, :]).reshape(len(p), -1)
            take = np.argsort(-both, axis=1, kind="stable")[:, : self.best]
            score, name = np.take_along_axis(both, take, 1), np.take_along_axis(names, take, 1)
        return name

    def signs(self, x: np.ndarray) -> np.ndarray:
        """128 bits a vector, as two unsigned 64-bit numbers."""
        return np.packbits(x @ self.planes > 0, axis=1, bitorder="little").view(np.uint64)


def usable(vector) -> object:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(values: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the vectors, and the vectors in double precision."""
    flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), values.offsets.to_numpy()
    return np.diff(ends), np.split(flat, ends[1:-1] - ends[0])


def decoder(n_classes: int, per_vector: int, per_bucket: int, memo: int = 1 << 20):
    """Rows (label, node, v) -> (label, dim, filter, node, a, b): a and b are the sign bits. A node that this task has sent
    already is left out; the memo of sent ones is bounded, as sending one again does no harm."""
    codes: dict[int, ProductCode] = {}

    def run(batches):
        sent: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if len(sent) > memo:
                    sent.clear()
                fresh = []
                for k, x in enumerate(batch.column(1).to_pylist()):
                    if x not in sent:
                        sent.add(x)
                        fresh.append(k)
                batch = batch.take(pa.array(fresh, pa.int64()))
                dims, vectors = unit(batch.column(2).cast(pa.list_(pa.float64())))
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    x = np.stack([vectors[k] for k in rows])
                    scaled = x / np.abs(x).max(axis=1, keepdims=True)
                    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
                    code = codes.get(dim) or ProductCode(dim, n_classes, per_vector, per_bucket)
                    codes[dim] = code
                    row, name = code.decode(scaled)
                    take, bits = pa.array(rows[row]), code.signs(scaled)[row].view(np.int64)
                    cols = [batch.column(0).take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(name), batch.column(1).take(take), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
                    yield pa.record_batch(cols, ["label", "dim", "filter", "node", "a", "b"])

    return run


def runs(*keys: np.ndarray):
    """Slices of equal keys, of more than one row, in rows sorted by the keys."""
    new = np.concatenate(([True], np.zeros(max(0, len(keys[0]) - 1), bool), [True]))
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    cut = np.flatnonzero(new[: len(keys[0]) + 1])
    for x in np.flatnonzero(np.diff(cut) > 1):
        yield slice(cut[x], cut[x + 1])


def linked_signs(a: np.ndarray, b: np.ndarray, most: int, block: int = 512) -> np.ndarray:
    """Class labels (smallest index) after joining all whose 128 bits differ in at most `most`. First each goes to the first
    one still free that is near; then only blocks that hold different classes are compared."""
    n, labels = len(a), np.arange(len(a))
    bits = lambda i, j: np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j])
    free = np.arange(n)
    for _ in range(8):
        if len(free) < 2:
            break
        near = bits(free[:1], free) <= most
        labels[free[near]] = free[0]
        free = free[~near]
    order = np.argsort(labels, kind="stable")
    for x in range(0, n, block):
        i = order[x : x + block]
        for y in range(x, n, block):
            j = order[y : y + block]
            if labels[i].min() == labels[j].max() and labels[i].max() == labels[j].min():
                continue
            p, q = np.nonzero(bits(i[:, None], j[None, :]) <= most)
            unite(labels, i[p], j[q])
    return labels


def cap_links(rows: pa.Table) -> pa.Table:
    """For applyInArrow: rows (shard, cap, lo, hi, node, a, b) -> a spanning star (u, v) per group of candidates."""
    cols = [rows.column(c).to_numpy() for c in ("cap", "lo", "hi", "node", "a", "b")]
    order = np.lexsort(cols[3::-1])
    cap, lo, hi, node, a, b = (c[order] for c in cols)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in runs(cap, lo, hi):
        name, first = np.unique(node[own], return_index=True)  # tasks may have sent the same node
        labels = linked_signs(a[own][first].view(np.uint64), b[own][first].view(np.uint64), BITS)
        at = np.flatnonzero(labels != np.arange(len(labels)))
        us.append(name[at])
        vs.append(name[labels[at]])
    return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})


def tile_links(x, n, node, tile, across: bool, least: float, block: int = 512):
    """Links of one candidate component, or of two of its tiles: (node, links, root)."""
    norms = np.linalg.norm(x, axis=1)
    count, labels, touched = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
    for at in range(0, len(x), block):
        own = slice(at, at + block)
        near = (x[own] @ x.T) / np.outer(norms[own], norms) >= least
        near[np.arange(near.shape[0]), np.arange(near.shape[0]) + at] = False
        if across:
            near &= tile[own, None] != tile[None, :]  # pairs within a tile are another task's
        count[own] = near @ n
        i, j = np.nonzero(near)
        touched[i + at] = True
        unite(labels, i + at, j)
    return node[touched], count[touched], node[labels[touched]]


def group_links(least: float):
    """For applyInArrow: rows (shard, grp, lo, hi, tile, node, n, v) -> (node, links, root) of nodes that have links."""

    def run(rows: pa.Table) -> pa.Table:
        dims, vectors = unit(rows.column("v").combine_chunks().cast(pa.list_(pa.float64())))
        cols = [rows.column(c).to_numpy() for c in ("grp", "lo", "hi", "node", "n", "tile")]
        order = np.lexsort((*cols[3::-1], dims))
        grp, lo, hi, node, n, tile = (c[order] for c in cols)
        out = []
        for own in runs(dims[order], grp, lo, hi):
            x = np.stack([vectors[k] for k in order[own]])
            out.append(tile_links(x, n[own], node[own], tile[own], lo[own.start] != hi[own.start], least))
        cols = [np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3)]
        return pa.table(dict(zip(("node", "links", "root"), cols, strict=True)))

    return run


def in_tiles(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows (key, node, k tiles, ...) -> once per pair of tiles that they belong to, with shard, tile, lo and hi."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    return rows.withColumn("shard", F.pmod(F.xxhash64(key, "lo", "hi"), F.lit(shards)))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, per_vector: int = 16, per_bucket: int = 16) -> DataFrame:
    """(id, n_links, component): one row per row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    ok = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = rows.where(ok).withColumn("node", F.xxhash64("label", "v"))
    classes = materialise(good.groupBy("node", "label").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "caps-class")
    most, total = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    shards = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def caps(some: DataFrame) -> DataFrame:
        sent = some.select("label", "node", "v").mapInArrow(decoder(most, per_vector, per_bucket), "label long, dim int, filter long, node long, a long, b long")
        return sent.select(F.xxhash64("label", "dim", "filter").alias("cap"), "node", "a", "b")

    sample = caps(good.where(F.pmod("node", F.lit(SAMPLE)) == 0)).select("cap", "node").distinct().groupBy("cap").agg((F.count("*") * SAMPLE).alias("size"))
    hot = sample.where(F.col("size") >= F.lit(max(2 * TILE, per_vector * total // MOST_HOT)))
    k = F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int").alias("k")
    sent = caps(good).join(F.broadcast(hot), "cap", "left").select("cap", "node", "a", "b", k)
    sent = in_tiles(sent, "cap", shards).select("shard", "cap", "lo", "hi", "node", "a", "b")
    near = connected_components(sent.groupBy("shard").applyInArrow(cap_links, "u long, v long"), "caps-near")

    tops = near.unionAll(near.select("root", "root").distinct())
    sizes = tops.groupBy("root").agg(F.count("*").alias("c")).withColumn("k", F.ceil(F.col("c") / TILE).cast("int"))
    members = materialise(join_hot(tops, sizes, "root", "node", total).join(classes.hint("merge"), "node").select(F.col("root").alias("grp"), "node", "k", F.col("rep").alias("id"), "n"), "caps-group")
    once = good.groupBy("node", "id").agg(F.first("v").alias("v"))  # a row that is often repeated is sent once by each task
    met = in_tiles(once.join(members.hint("merge"), ["node", "id"]), "grp", shards).select("shard", "grp", "lo", "hi", "tile", "node", "n", "v")
    found = materialise(met.groupBy("shard").applyInArrow(group_links(least), "node long, links long, root long"), "caps-links")

    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "caps-cc")
    tops = roots.unionAll(roots.select("root", "root").distinct()).join(classes.select("node", "rep").hint("merge"), "node")
    lowest = tops.groupBy("root").agg(F.count("*").alias("c"), F.min("rep").alias("component"))
    component = join_hot(tops, lowest, "root", "node", total).select("node", "component")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(links, "node", "left").join(component, "node", "left")
    known = known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = good.select("id", "node").join(known.hint("merge"), "node").select("id", "n_links", "component")
    return linked.unionAll(rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op10(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


SQL = """
WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT low.a AS vec_id, coalesce(n.n, 0) AS n_links, low.m AS component_id, low.a = low.m AS kept FROM low LEFT JOIN n ON low.a = n.a
"""
