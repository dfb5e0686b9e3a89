"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison of exclusive-ors, components of links.

Fingerprints are made where the text is read, so texts are never shuffled for them. Equal fingerprints are collapsed to one
class (partial aggregates take the heat out of large groups of copies). Two fingerprints within `radius` bits agree on at
least c of radius + c blocks of bits, so each class goes to the buckets of every choice of c blocks; c grows with the
number of classes so that buckets stay small. Inside a bucket the comparison is exact and tiled: classes are ordered by
population count and tile pairs whose counts differ beyond the radius are skipped. A bucket of more than TILE classes is
dealt to several tasks as pairs of tiles of one population count each; pairs beyond the radius are never dealt. A bucket
emits a spanning star for each group it finds, never all pairs.

`keep_one` looks for similarity 0.8 of word shingles, some ten bits of 64: too many for blocks. There BANDS bands of ROWS
minimum hashes deal the texts to buckets, so a row has BANDS replicas at any size, and the tiled comparison within a bucket
uses fingerprints of the distinct shingles.

Nulls: a null text counts as empty (fingerprint 0, linked like any other). A null id keeps its fingerprint and its
class; the component id is the smallest id that is not null (null if there is none). Repeated rows are kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, connected_components, documents, join_hot, materialise, plain, slices, unite, utf8

TILE = 1024
CHANCE = 256
BANDS, ROWS = 20, 5  # a pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 5) ** 20 = 0.0004
SHARD_BYTES = 16 << 20  # shingles that a task compares at once
SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than `shingle`: the whole sequence is one; none: none."""
    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks alone
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = len(words) - k + 1 if words else 0
    xx = xxhash.xxh64_intdigest
    a, b = starts[:n].tolist(), (ends[k - 1 :] - 1).tolist() if n else []
    return np.fromiter((xx(joined[x:y], 42) for x, y in zip(a, b, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the shingles' hashes, repeats included."""
    return majority(shingle_hashes(text, shingle))


def shingle_set(text: bytes, shingle: int) -> set:
    """The distinct shingles as words, for comparison in tests."""
    words = text.lower().split()
    return {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def distinct_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles, sorted. A text without words has one, so such texts are alike."""
    return np.unique(shingle_hashes(text, shingle)) if text.split() else np.zeros(1, np.uint64)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band of minimum hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, ((hashes[at : at + 2048, None] ^ SEEDS[0]) * SEEDS[1]).min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, th, fp): one row per row of docs; fp holds the 64 bits as a signed long, th is the text's hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(fp)], ["id", "th", "fp"])

    text = F.col(text_col).cast("string").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text)
    return rows.mapInArrow(by_batch(run), "id long, th long, fp long")


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (id, th, text) -> (id, th, fp, n, bands): fingerprint, number and band keys of the distinct shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [distinct_hashes(t, shingle) for t in utf8(batch.column(2))]
        fp = pa.array(np.array([majority(h) for h in sets], np.uint64).view(np.int64))
        n = pa.array(np.array([len(h) for h in sets], np.int64))
        bands = pa.array([bands_of(h) for h in sets], pa.list_(pa.int64()))
        return pa.record_batch([batch.column(0), batch.column(1), fp, n, bands], ["id", "th", "fp", "n", "bands"])

    return rows.mapInArrow(by_batch(run), "id long, th long, fp long, n long, bands array<long>")


def block_masks(radius: int, n_classes: int) -> list[int]:
    """One mask per choice of c out of radius + c blocks; c is the least that leaves about CHANCE chance members a bucket."""
    for c in range(1, 8):
        blocks = radius + c
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        if n_classes / 2 ** (64 * c // blocks) <= CHANCE or c == 7:
            break
    parts = [((1 << (y - x)) - 1) << x for x, y in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, c)]


def close_pairs(fps: np.ndarray, radius: int, tile: int):
    """Tile by tile the pairs (i < j, bits) within radius; fps must be ordered by population count."""
    ones = np.bitwise_count(fps)
    for x in range(0, len(fps), tile):
        for y in range(x, len(fps), tile):
            if int(ones[y]) - int(ones[min(x + tile, len(fps)) - 1]) > radius:
                break  # later tiles have still higher counts
            bits = np.bitwise_count(fps[x : x + tile, None] ^ fps[None, y : y + tile])
            near = bits <= radius
            i, j = np.nonzero(np.triu(near, 1) if x == y else near)
            yield i + x, j + y, bits[i, j]


def compare_tiles(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """Class labels (smallest index) after linking all fps within radius."""
    labels = np.arange(len(fps))
    for i, j, _ in close_pairs(fps, radius, tile):
        unite(labels, i, j)
    return labels


def groups_of(*keys: np.ndarray):
    """Slices of equal keys, of more than one row, in rows sorted by the keys."""
    new = np.zeros(len(keys[0]) + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    cut = np.flatnonzero(new)
    for a in np.flatnonzero(np.diff(cut) > 1):
        yield slice(cut[a], cut[a + 1])


def star(us: list, vs: list) -> pa.Table:
    none = np.zeros(0, np.int64)
    return pa.table({"u": np.concatenate([none, *us]), "v": np.concatenate([none, *vs])})


def bucket_links(radius: int):
    """For applyInArrow: rows (shard, bucket, lo, hi, fp, rep) of some buckets, or pairs of their tiles -> a spanning star
    (u, v) per linked group."""

    def run(rows: pa.Table) -> pa.Table:
        cols = [rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "fp", "rep")]
        order = np.lexsort((np.bitwise_count(cols[3].view(np.uint64)), *cols[:3]))
        bucket, lo, hi, fp, rep = (c[order] for c in cols)
        us, vs = [], []
        for own in groups_of(bucket, lo, hi):
            labels = compare_tiles(fp[own].view(np.uint64), radius)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            us.append(rep[own][linked])
            vs.append(rep[own][labels[linked]])
        return star(us, vs)

    return run


def in_buckets(classes: DataFrame, radius: int) -> DataFrame:
    """classes (fp, ...) once for each choice of blocks: (bucket, ...)."""
    masks = block_masks(radius, classes.count())
    keyed = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)])
    return classes.withColumn("bucket", F.explode(keyed))


def tile_counts(rows: DataFrame, tile: int) -> DataFrame:
    """(bucket, ones, parts) of the buckets that hold more than `tile` rows: tiles by population count."""
    each = rows.groupBy("bucket", F.bit_count("fp").alias("ones")).agg(F.count("*").alias("c"))
    crowded = each.groupBy("bucket").agg(F.sum("c").alias("all")).where(F.col("all") > tile).select("bucket")
    return each.join(crowded, "bucket", "left_semi").select("bucket", "ones", F.ceil(F.col("c") / tile).cast("int").alias("parts"))


def dealt(rows: DataFrame, radius: int, tile: int | None = None) -> DataFrame:
    """rows (bucket, fp, ...) with (shard, lo, hi): whole buckets, or for crowded ones each pair of tiles whose population
    counts differ by at most radius; the others are never dealt."""
    tile = tile or TILE
    shards = 8 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = materialise(tile_counts(rows, tile), "simhash-tiles")
    ones = F.bit_count("fp").cast("int")
    marked = rows.join(sizes.groupBy("bucket").agg(F.lit(True).alias("crowded")), "bucket", "left")
    small = marked.where("crowded is null").select(*rows.columns, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    large = marked.where("crowded").withColumn("ones", ones).join(sizes.withColumnRenamed("parts", "mine"), ["bucket", "ones"])
    large = large.withColumn("other", F.explode(F.sequence(F.col("ones") - radius, F.col("ones") + radius)))
    met = sizes.select("bucket", F.col("ones").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    large = large.join(met, ["bucket", "other"])
    here = F.shiftleft(F.col("ones").cast("long"), 32) + F.pmod(F.xxhash64("fp", F.lit(1)), F.col("mine"))
    there = F.shiftleft(F.col("other").cast("long"), 32) + F.col("part")
    large = large.select(*rows.columns, F.least(here, there).alias("lo"), F.greatest(here, there).alias("hi"))
    return small.unionAll(large).withColumn("shard", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shards)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, th, fp, component): component is the smallest id reachable over links of at most `radius` differing bits."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    classes = materialise(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-class")
    edges = dealt(in_buckets(classes, radius), radius).groupBy("shard").applyInArrow(bucket_links(radius), "u long, v long")
    roots = connected_components(edges, "simhash-cc")
    found = classes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return fps.join(found.hint("merge"), "fp", "left").select("id", "th", "fp", "component")


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of at least `least`."""
    both = np.sort(np.concatenate((x, y)))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared)


def alike(least: float):
    """Of rows (u, v, a, b) the u and v of those whose sets of hashes a and b are similar."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                a, b = (batch.column(k).cast(pa.binary()) for k in (2, 3))
                mask = pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return run


def hashed(shingle: int):
    """Rows (node, text) -> (node, hashes of the distinct shingles)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([distinct_hashes(t, shingle).tobytes() for t in utf8(batch.column(1))], pa.binary())
        return pa.record_batch([batch.column(0), sets], ["node", "hashes"])

    return by_batch(run)


def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def pointers(members: DataFrame, radius: int, least: float) -> DataFrame:
    """(u, v): for each node the nearest one, by bits, among one node of another root per bucket. One row a node at most."""
    end = F.struct("root", "node", "fp", "n")
    ends = members.groupBy("bucket").agg(F.min(end).alias("first"), F.max(end).alias("last")).where("first.root <> last.root")
    other = F.when(F.col("root") == F.col("first.root"), F.col("last")).otherwise(F.col("first"))
    met = members.join(ends.hint("merge"), "bucket").select("node", "fp", "n", other.alias("o"))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("o.fp")))
    close = (bits <= radius) & (F.least("n", "o.n") >= F.lit(least) * F.greatest("n", "o.n"))
    near = met.where(close).groupBy("node").agg(F.min(F.struct(bits.alias("bits"), F.col("o.node").alias("v"))).alias("p"))
    return near.select(F.col("node").alias("u"), F.col("p.v").alias("v"))


def verified(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets in own (node, hashes) are similar."""
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("hashes").alias("a")).hint("merge"), "u").join(own.select(F.col("node").alias("v"), F.col("hashes").alias("b")).hint("merge"), "v")
    return both.select("u", "v", "a", "b").mapInArrow(alike(least), "u long, v long")


def bucket_verified(radius: int, least: float):
    """For applyInArrow: rows (shard, bucket, lo, hi, tile, node, root, fp, hashes) -> links (u, v) that join the roots of
    all similar pairs within radius; pairs that are joined already, in the table or here, are not compared."""

    def run(rows: pa.Table) -> pa.Table:
        cols = [rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "fp", "node", "root", "tile")]
        order = np.lexsort((np.bitwise_count(cols[3].view(np.uint64)), *cols[:3]))
        bucket, lo, hi, fp, node, root, tile = (c[order] for c in cols)
        raw = rows.column("hashes").combine_chunks()
        us, vs = [], []
        for own in groups_of(bucket, lo, hi):
            if (root[own] == root[own.start]).all():
                continue
            hashes = [np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in order[own]]
            names, label = np.unique(root[own], return_inverse=True)
            joined, where = list(range(len(names))), tile[own]
            size = np.array([len(h) for h in hashes])

            def top(x: int, joined: list[int] = joined) -> int:
                while joined[x] != x:
                    joined[x] = x = joined[joined[x]]
                return x

            for i, j, _ in close_pairs(fp[own].view(np.uint64), radius, TILE):
                fit = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
                if lo[own.start] != hi[own.start]:
                    fit &= where[i] != where[j]  # pairs within a tile are another task's
                for x, y in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                    a, b = top(label[x]), top(label[y])
                    if a != b and similar(hashes[x], hashes[y], least):
                        joined[max(a, b)] = min(a, b)
                        us.append(node[own][x : x + 1])
                        vs.append(node[own][y : y + 1])
        return star(us, vs)

    return run


def left_links(members: DataFrame, own: DataFrame, radius: int, least: float) -> DataFrame:
    """Links between the roots that still differ within a bucket, from an exact comparison of all its pairs."""
    ends = members.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count("*").alias("c")).where("first <> last")
    k = F.ceil(F.col("c") / F.lit(TILE)).cast("int")
    still = materialise(members.join(ends.select("bucket", k.alias("k")).hint("merge"), "bucket"), "simhash-open")
    total = still.agg(F.sum(8 * F.col("n") * F.col("k"))).first()[0] or 0
    shards = max(8 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES + 1)
    rows = still.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    rows = rows.join(own.hint("merge"), "node").withColumn("shard", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shards)))
    rows = rows.select("shard", "bucket", "lo", "hi", "tile", "node", "root", "fp", "hashes")
    return rows.groupBy("shard").applyInArrow(bucket_verified(radius, least), "u long, v long")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 22, least: float = 0.8, rounds: int = 1) -> DataFrame:
    """docs without those that repeat a document of smaller id: exact copies, and documents linked to one. Links join
    texts that share a band of minimum hashes and whose fingerprints differ by at most radius bits, if the Jaccard
    similarity of their shingles is at least `least` (exact, by 64-bit hashes); the smallest id of each connected component
    stays. In each of `rounds` rounds every text points to one text of its buckets that earlier links have not joined to it,
    which joins large groups of copies at a cost linear in their size. Then all pairs of a bucket that are still apart are
    compared, in place, so no link is lost to the rounds and none but a spanning set is written. A chance neighbour fails the
    exact comparison and binds nobody, so groups do not run together as the corpus grows. Rows with a null id stay, as do
    repeats of a row that stays."""
    rows, names = plain(docs, ("doc_id", "text"))
    text = F.col("text").cast("string").alias("text")
    own_id, hash_ = F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th")
    marks = materialise(sketches(rows.select(own_id, hash_, text), shingle), "simhash-sketch").where("id is not null")
    node = lambda i, th: F.xxhash64(i, th)  # noqa: E731  ids may repeat
    texts = marks.groupBy("th", "fp", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands")).withColumn("node", node("id", "th"))
    texts = materialise(texts, "simhash-texts")  # one row per different text
    dealt_out = texts.select(F.explode("bands").alias("bucket"), "node", "fp", "n")
    shared = dealt_out.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("bucket")
    members = materialise(dealt_out.join(shared.hint("merge"), "bucket", "left_semi"), "simhash-members")
    named = members.select("node").distinct()
    whole = rows.select(node(own_id, hash_).alias("node"), text).join(named, "node", "left_semi")
    own = materialise(whole.dropDuplicates(["node"]).mapInArrow(hashed(shingle), "node long, hashes binary"), "simhash-own")
    links = roots = None
    for k in range(rounds + 1):
        held = rooted(members, roots)
        found = left_links(held, own, radius, least) if k == rounds else verified(materialise(pointers(held, radius, least), "simhash-pointers"), own, least)
        found = materialise(found, "simhash-links")
        links = found if links is None else links.unionAll(found)
        roots = connected_components(links, "simhash-cc")
    tops = roots.unionAll(roots.select("root", "root").distinct())
    grouped = materialise(tops.join(texts.select("node", "id", "th").hint("merge"), "node").select("root", "id", "th"), "simhash-groups")
    first = grouped.groupBy("root").agg(F.count("*").alias("c"), F.min(F.struct("id", "th")).alias("first"))
    repeats = join_hot(grouped, first, "root", "id", grouped.count()).where("struct(id, th) <> first").select("id", "th")
    copies = marks.select("id", "th", "fp").join(texts.select("th", "fp", F.col("id").alias("first")).hint("merge"), ["th", "fp"]).where("id <> first").select("id", "th")
    go = materialise(repeats.unionAll(copies), "simhash-go").distinct()
    gone = (F.col("doc_id").cast("long") == F.col("_go.id")) & (F.xxhash64(text) == F.col("_go.th"))
    return rows.join(go.hint("merge").alias("_go"), gone, "left_anti").toDF(*names)


def op6(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
