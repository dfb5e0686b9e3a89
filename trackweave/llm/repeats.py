"""Removal of repeated byte strings with enhanced suffix arrays over content-chosen shards.

Every window of `length` bytes chooses its anchor: the 16-byte string in it with the smallest hash, leftmost among
equals. Equal windows choose equal anchors, so windows that repeat meet at anchors that repeat. Neighbouring windows with
the same anchor form a run, stored as (anchor hash, document, first byte, end); no text moves. Anchors that occur once are
dropped by an aggregate and a join; for the others the runs' bytes are cut from the texts and dealt by anchor hash.

In a shard, suffixes are the runs' windows. Their suffix array is ordered up to the run's end, the LCP array is scanned
with a stack, and each interval of the common-prefix tree with an LCP of at least `length` whose occurrences have
different left neighbours (a run's start counts as different) is a maximal repeat group; all its occurrences are known.
The earliest occurrence (document, then place) stays, of the others the common prefix goes. Groups of windows that all
have the same left neighbour are left out before the scan: the group one byte to the left stands for them.

Texts are dealt once, by document and packed, for the cutting and the result. Anchors are found twice rather than kept, which
would cost more disk than the work is worth; 40 bits of their hashes are dealt. Anchors that share these by chance only meet for
nothing, as windows are told apart by their bytes. Hashes of texts are dealt only where an id comes with different texts.

An anchor with more than `hot` runs would fill a task: its windows are instead aggregated by their bytes for the earliest
place, which Spark combines before the shuffle, and all windows at other places go: a join by place, which has no hot keys.
The result is the same. The number of shards grows with the runs, so a shard's memory does not.

Nulls and edges: a null text counts as empty. Null ids come last in the order. Rows that repeat an id with another text
are ordered by the text's hash; rows equal in both are one document and get equal results. Texts shorter than `length`
lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, table

GRAM = 16
HOT = 100_000
LAST = 2**63 - 1  # stands for a null id
BITS = 24  # of a place in a slice of texts; more for a longer slice
SLICE = 1 << 19  # bytes of text whose anchors are found at a time
SHARD_RUNS = 100_000  # runs in a shard, some 16 MB of their bytes, about ten times that while it is sorted
SUB = 4  # parts of a shard that are sorted one after the other
BLOB = 8 << 20  # bytes of runs that are packed at a time
DEALT = np.int64((1 << 40) - 1)  # bits of an anchor's hash that are dealt


def words64(buf: np.ndarray, n: int, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each of the first n places on, as numbers; buf must have 7 more bytes."""
    return np.ndarray(n, kind, buf, 0, (1,)).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE, UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k modulo 2 ** 64 for k < n."""
    if len(POWERS[0]) < n:
        for k, base in enumerate((BASE, UNBASE)):
            step = np.full(2 * n, base, np.uint64)
            step[0] = 1
            POWERS[k] = np.cumprod(step)
    return POWERS[0][:n], POWERS[1][:n]


def window_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of the windows, from sums over prefixes; bytes are compared later."""
    up, down = powers(len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[buf] * up, out=prefix[1:])
    return (prefix[at + length] - prefix[at]) * down[at]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i that has so many."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchor_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, first byte, end) of all runs of windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if total < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    bits = max(BITS, int(total).bit_length())
    buf = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
    w = words64(buf, total)
    n = total - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << bits) - 1)
    place = (sliding_min((h & ~low) | np.arange(n, dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(place))
    ok = start + length <= ends[text[: len(place)]]
    start, place, text = start[ok], place[ok], text[: len(ok)][ok]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:] - 1, [len(start) - 1])) if len(start) else new[:0]
    new = new[: len(last)]
    base = (ends - sizes)[text[new]]
    return text[new], h[place[new]].view(np.int64), start[new] - base, start[last] + length - base


def maximal_repeats(order: np.ndarray, contexts: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a shard, their bytes joined -> (run, start within it, bytes to remove from there).

    order[k] must ascend with (document, first byte); of runs that are equal in both the first one counts."""
    none = np.zeros(0, np.int64)
    if len(sizes) < 2:
        return none, none, none
    again = np.ones(len(sizes), bool)
    again[np.unique(order, return_index=True)[1]] = False
    windows = np.where(again, 0, sizes - length + 1)
    buf = np.frombuffer(contexts + bytes(length + 8), np.uint8)
    begin = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(sizes)), windows)
    off = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[run] + off
    sums = window_hashes(buf, at, length)
    by = np.argsort(sums)
    edge = np.flatnonzero(np.concatenate(([True], sums[by][1:] != sums[by][:-1], [True])))
    size = np.diff(edge)
    group_of = np.repeat(np.arange(len(size)), size)
    # a group is worth a scan if it has two members with different left neighbours
    left = np.where(off > 0, buf[at - 1].astype(np.int64), -1 - run)[by]
    change = np.concatenate(([0], np.cumsum(np.concatenate(([False], left[1:] != left[:-1])))))
    differs = change[edge[1:]] - change[edge[:-1] + 1] > 0
    keep = ((size > 1) & differs)[group_of]
    if not keep.any():
        return none, none, none
    pick, group, left = by[keep], group_of[keep], left[keep]
    # suffix array of what is left: bytes from the window's start to the run's end, then the run's order
    far = sizes[run[pick]] - off[pick]
    width = int(far.max() + 7) // 8 * 8
    grid = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(width, np.uint8)]), width)[at[pick]]  # a byte a place, no table of places
    grid[np.arange(width)[None, :] >= far[:, None]] = 0
    keys = np.ascontiguousarray(grid).view(">u8")
    sa = np.lexsort((order[run[pick]], far, *(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)), group))
    pick, group, left, far, grid = pick[sa], group[sa], left[sa], far[sa], grid[sa]
    same = grid[1:] == grid[:-1]
    lcp = np.where(same.all(axis=1), grid.shape[1], same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(far[1:], far[:-1]))
    lcp[(lcp < length) | (group[1:] != group[:-1])] = 0  # a hash that two windows share by chance ends here
    first = np.empty(len(pick), np.int64)
    first[np.lexsort((off[pick], order[run[pick]]))] = np.arange(len(pick))
    cut = scan_intervals(lcp, left, first)
    got = np.flatnonzero(cut)
    return run[pick][got], off[pick][got], cut[got]


def scan_intervals(lcp: np.ndarray, left: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Stack scan of the common-prefix interval tree; lcp[i] is of suffixes i and i + 1, 0 ends a group. For each suffix
    the longest common prefix of an interval with different left neighbours in which it is not the earliest."""
    best = np.zeros(len(first), np.int64)
    change = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    stack: list[tuple[int, int]] = []  # (lcp, left end)
    for i, value in enumerate([*lcp.tolist(), 0]):
        lo = i
        while stack and stack[-1][0] > value:
            depth, lo = stack.pop()
            if change[i] > change[lo]:
                own = best[lo : i + 1]
                k = int(first[lo : i + 1].argmin())
                held = own[k]
                np.maximum(own, depth, out=own)
                own[k] = held
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, lo))
    return best


RUN = "h long, doc long, th long, place long"
SPAN_BITS = 24  # of a run's length in `place`, which holds first byte << SPAN_BITS | length


def runs(rows: DataFrame, length: int, piece: int = 4 * SLICE) -> DataFrame:
    """A window's anchor depends on the window alone, so a text longer than `piece` is worked off in pieces that share
    length - 1 bytes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                texts = [t.as_py() for t in batch.column(2)]
                row = np.array([k for k, t in enumerate(texts) for _ in range(0, max(1, len(t) - length + 1), piece)])
                base = np.array([s for t in texts for s in range(0, max(1, len(t) - length + 1), piece)])
                parts = [texts[k][s : s + piece + length - 1] for k, s in zip(row.tolist(), base.tolist(), strict=True)]
                step = len(parts) if sum(map(len, parts)) <= 2 * piece else 1
                for x in range(0, len(parts), step):
                    part, h, a, e = anchor_runs(parts[x : x + step], length)
                    at = pa.array(row[part + x])
                    place = (a + base[part + x]) << SPAN_BITS | (e - a)
                    yield pa.record_batch([pa.array(h & DEALT), batch.column(0).take(at), batch.column(1).cast(pa.int64()).take(at), pa.array(place)], ["h", "doc", "th", "place"])

    return rows.mapInArrow(run, RUN)


def packed(shard: np.ndarray, doc: np.ndarray, th: np.ndarray, a: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
    """Runs of a shard, of its SUB parts one after the other, as one compressed value: columns, then bytes."""
    order = np.argsort(shard, kind="stable")
    part = (shard % SUB).astype(np.int8)
    shard = shard // SUB
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    squeeze = zstandard.ZstdCompressor(level=3).compress
    blobs = []
    for x, y in zip(cut, cut[1:], strict=False):
        own = order[x:y]
        bytes_ = [parts[k] for k in own]
        sizes = np.array([len(p) for p in bytes_], np.int32)
        blobs.append(squeeze(b"".join([np.int64(len(own)).tobytes(), doc[own].astype(np.int64).tobytes(), th[own].astype(np.int64).tobytes(), a[own].astype(np.int32).tobytes(), sizes.tobytes(), part[own].tobytes(), *bytes_])))
    return pa.record_batch([pa.array(shard[order][cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    cols, rest = [[], [], [], [], []], []
    for raw in map(zstandard.ZstdDecompressor().decompress, blobs):
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for col, kind in zip(cols, (np.int64, np.int64, np.int32, np.int32, np.int8), strict=True):
            col.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        rest.append(raw[at:])
    return (*(np.concatenate(c) for c in cols), b"".join(rest))


def pack_texts(batches):
    """Rows (doc, th, text) with each text packed, which deals fewer bytes than what shuffles pack."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for big in batches:
        for batch in slices(big, 2 << 20):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(map(squeeze, batch.column(2).to_pylist()), pa.binary())], ["doc", "th", "text"])


def open_texts(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def pack_runs(batches):
    """Rows (doc, th, packed text, cold) -> the runs' bytes, by shard."""
    held: list[tuple] = []
    parts: list[bytes] = []
    size = 0
    for big in batches:
        for batch in slices(big, 1 << 20):
            texts, lists = open_texts(batch.column(2)), batch.column(3)
            if not (flat := lists.flatten()):
                continue
            row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            shard, place = flat.field("shard").to_numpy(), flat.field("place").to_numpy()
            a, n = place >> SPAN_BITS, place & ((1 << SPAN_BITS) - 1)
            parts += [texts[r][x:y] for r, x, y in zip(row.tolist(), a.tolist(), (a + n).tolist(), strict=True)]
            held.append((shard, batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], a))
            size += int(n.sum())
            if size > BLOB:
                yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)), parts)
                held, parts, size = [], [], 0
    if held:
        yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)), parts)


def single_windows(length: int):
    """Rows (doc, th, packed text, warm) -> one row per window."""

    def run(batches):
        for big in batches:
            for batch in slices(big, 1 << 18):
                out: list[tuple] = []
                for doc, th, text, places in zip(*(batch.column(c).to_pylist() for c in (0, 1)), open_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    for p in places:
                        a, n = p >> SPAN_BITS, p & ((1 << SPAN_BITS) - 1)
                        out += [(doc, th, s, text[s : s + length]) for s in range(a, a + n - length + 1)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "th", "s", "bytes"])

    return run


def shard_repeats(length: int):
    def run(rows: pa.Table) -> pa.Table:
        doc, th, a, sizes, part, contexts = unpacked(rows.column("blob").to_pylist())
        by = np.lexsort((a, th, doc))
        keys = np.stack([doc[by], th[by], a[by]])
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        end = np.cumsum(sizes)
        found = []
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            bytes_ = b"".join([contexts[x:y] for x, y in zip((end - sizes)[own].tolist(), end[own].tolist(), strict=True)])
            of, *rest = maximal_repeats(order[own], bytes_, sizes[own], length)
            found.append((own[of], *rest))
        run_, off, cut = (np.concatenate(x) for x in zip(*found, strict=True))
        # overlapping spans of a document are one
        s = a[run_] + off
        e, doc, th = s + cut, doc[run_], th[run_]
        by = np.lexsort((s, th, doc))
        s, e, doc, th = s[by], e[by], doc[by], th[by]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))[: len(s)]
        text = np.cumsum(new)
        reach = np.maximum.accumulate(e + text * (1 << 40)) if len(e) else e
        first = new | np.concatenate(([True], s[1:] + text[1:] * (1 << 40) > reach[:-1]))[: len(s)]
        at = np.flatnonzero(first)
        last = np.append(at[1:] - 1, len(s) - 1)[: len(at)]
        return pa.table({"doc": doc[at], "th": th[at], "span": s[at] << 32 | (reach[last] - text[last] * (1 << 40))})

    return run


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans array<struct<s,e>>, kept binary): spans are the maximal removed runs of bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    if rows.groupBy("doc").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").isEmpty():
        rows = rows.withColumn("th", F.lit(0).cast("long"))  # ids tell texts apart
    texts = rows.mapInArrow(pack_texts, "doc long not null, th long not null, text binary")
    found = runs(rows, length)
    often = materialise(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeats-anchors")
    n_runs = often.where(F.col("n") <= hot).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_runs // SHARD_RUNS + 1)
    hits = found.join(often.hint("merge"), "h").select("doc", "th", "n", "place", F.pmod("h", F.lit(SUB * shards)).cast("int").alias("shard"))
    lists = {"cold": F.collect_list(F.when(F.col("n") <= hot, F.struct("shard", "place"))), "warm": F.collect_list(F.when(F.col("n") > hot, F.col("place")))}
    warm = not often.where(F.col("n") > hot).isEmpty()
    near = texts.join(hits.groupBy("doc", "th").agg(*[lists[c].alias(c) for c in lists if c == "cold" or warm]).hint("merge"), ["doc", "th"])
    cold = near.select("doc", "th", "text", "cold").mapInArrow(pack_runs, "shard int, blob binary")
    spans = cold.groupBy("shard").applyInArrow(shard_repeats(length), "doc long, th long, span long")
    if warm:
        each = near.where(F.size("warm") > 0).select("doc", "th", "text", "warm").mapInArrow(single_windows(length), "doc long, th long, s long, bytes binary")
        first = each.groupBy("bytes").agg(F.min(F.struct("doc", "th", "s")).alias("first")).select("first.*")
        later = each.select("doc", "th", "s").join(first.hint("merge"), ["doc", "th", "s"], "left_anti")  # by place: no hot key
        spans = spans.unionAll(later.select("doc", "th", F.shiftleft("s", 32).bitwiseOR(F.col("s") + length).alias("span")))
    gone = spans.groupBy("doc", "th").agg(F.collect_list("span").alias("spans"))
    ends = texts.join(gone.hint("merge"), ["doc", "th"], "left").select(F.nullif("doc", F.lit(LAST)).alias("id"), "text", "spans")

    def run(batches):
        for big in batches:
            for batch in slices(big, 2 << 20):
                ids, n, out, kept = batch.column(0), [], [], []
                for text, spans in zip(open_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    cuts = merged((x >> 32, x & 0xFFFFFFFF) for x in spans or ())
                    edges = [0, *(x for c in cuts for x in c), len(text)]
                    n.append(len(text))
                    out.append([{"s": a, "e": b} for a, b in cuts])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return ends.mapInArrow(run, "id long, n_bytes long, spans array<struct<s:int,e:int>>, kept binary")


def op5(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute(texts: list[bytes], length: int = 100) -> list[tuple[int, int, int, str]]:
    """The contract word for word, for tests: texts in the order of their ids."""
    seen, rows = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(t[s : s + length])
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        rows.append((len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return rows


SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s - 1, 200)) AS k FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) // 2 - 99)) AS s FROM h WHERE len(x) >= 200)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
edge AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER v + 100 THEN 0 ELSE 1 END AS new FROM later WINDOW v AS (PARTITION BY doc_id ORDER BY s)),
isle AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM edge),
gone AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM isle GROUP BY doc_id, g),
kept AS (SELECT gone.doc_id, coalesce(lag(b) OVER v, 1) AS a, gone.a AS b FROM gone WINDOW v AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT doc_id, max(b), 1000000000 FROM gone GROUP BY doc_id),
left_ AS (SELECT kept.doc_id, string_agg(substr(h.x, 2 * kept.a - 1, 2 * (kept.b - kept.a)), '' ORDER BY kept.a) AS x FROM kept JOIN h ON h.doc_id = kept.doc_id GROUP BY 1),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT h.doc_id, len(h.x) // 2 AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed, coalesce(n.spans, 0) AS n_spans, sha256(unhex(coalesce(left_.x, CASE WHEN n.spans IS NULL THEN h.x ELSE '' END))) AS kept_sha256
FROM h LEFT JOIN n ON n.doc_id = h.doc_id LEFT JOIN left_ ON left_.doc_id = h.doc_id
"""
