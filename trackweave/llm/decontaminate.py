"""Benchmark decontamination with one FM-index per shard of training text.

A shard is a slice of an Arrow batch (SHARD bytes of text). Its words that stand anywhere in the benchmark get numbers; runs of
such words that are long enough to hold a window are kept as the indexed sequence (a window cannot reach over an unknown
word), each run ended by a separator. The index is a word-level FM-index: suffix array by prefix doubling, Burrows-Wheeler
transform in a wavelet matrix with packed rank counts, and suffix positions sampled at run starts and at every SAMPLE-th
position. It is built once per shard. All windows of a block of the benchmark are searched backward at once; equal windows
meet in one suffix interval, whose occurrences are located once, by walking to a sampled position; overlapping occurrences
are merged into removal spans, and owners are looked up for each text and interval, not for each occurrence.

Texts never leave their task and nothing is shuffled. The benchmark is cut into blocks of `block_bytes` of text (longer items
into pieces that overlap by a window less a word). One pass over the rows searches the blocks of `pass_bytes` of benchmark
text, one block after the other; they are broadcast, a few bytes a word. A larger benchmark takes further passes, each
written to the shared folder before the next one's blocks are broadcast, so what is broadcast at a time is bounded.

Nulls and edges: null or empty texts and items have no words. An item with a null id marks words but is not listed.
Repeated items or rows change nothing for others. An empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, materialise, plain, slices, table, utf8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SAMPLE = 8
SHARD = 4 << 20
STATE = "id long, text string, hit array<struct<start:int,end:int>>, items array<long>, n_words long"
HIT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class WaveletMatrix:
    """Ranks of symbols below 2 ** levels in a sequence; every level holds packed bits and a count per 64 of them."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.n, self.levels, self.rows = len(seq), levels, []
        for level in range(levels - 1, -1, -1):
            bits = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            zeros = len(seq) - int(counts[-1])
            self.rows.append((level, words, counts, zeros))
            seq = np.concatenate((seq[bits == 0], seq[bits == 1]))

    @staticmethod
    def ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        part = words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return counts[w] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before i."""
        lo = np.zeros_like(i)
        for level, words, counts, zeros in self.rows:
            one = (symbol >> level & 1).astype(bool)
            a, b = self.ones(words, counts, lo), self.ones(words, counts, i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, words, counts, zeros in self.rows:
            one = words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)
            a = self.ones(words, counts, i)
            out |= one.astype(np.int64) << level
            i = np.where(one.astype(bool), zeros + a, i - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; 0 is a separator, and separators differ from each other, so no repeat reaches over one."""
    n = len(seq)
    gaps = seq == 0
    rank = np.where(gaps, np.cumsum(gaps), seq.astype(np.int64) + int(gaps.sum()) + 1)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] if step < n else 0
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1])))
        rank, step = new, step * 2
        if rank[order[-1]] == n:
            return order


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.sa_order = order = suffix_array(seq)
        bwt = seq[order - 1].astype(np.int64)
        self.tree = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        starts = np.ones(len(seq), bool)
        starts[1:] = seq[:-1] == 0
        marked = (starts | (np.arange(len(seq)) % SAMPLE == 0))[order]
        self.marked, self.at = marked, np.cumsum(marked) - 1
        self.samples = order[marked]
        del self.sa_order

    def search(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns flat[begin:begin+length], by backward search of all at once."""
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), self.tree.n, np.int64)
        alive = np.arange(len(begin))
        for back in range(1, int(length.max(initial=0)) + 1):
            alive = alive[(length[alive] >= back) & (lo[alive] < hi[alive])]
            if not len(alive):
                break
            s = flat[begin[alive] + length[alive] - back]
            base = self.first[s]
            lo[alive], hi[alive] = base + self.tree.rank(s, lo[alive]), base + self.tree.rank(s, hi[alive])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix rows: step back until a sampled position is met."""
        out, steps, todo = np.full(len(rows), -1, np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.marked[rows]
            out[todo[done]] = self.samples[self.at[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            s = self.tree.access(rows)
            rows = self.first[s] + self.tree.rank(s, rows)
            steps += 1
        return out


class Numbers(dict):
    """Numbers words from 1 on as they are looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Phrases:
    """The windows of some benchmark items: the items' words as numbers from 1, and where in them each window begins."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        vocabulary = Numbers()
        parts, begin, length, owner, at = [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            ids = np.array([vocabulary[w] for w in WORD.findall(text.lower())], np.int32)
            n = max(1, len(ids) - window + 1) if len(ids) else 0
            parts.append(ids)
            begin.append(np.arange(at, at + n, dtype=np.int32))
            length.append(np.full(n, min(window, len(ids)), np.int32))
            owner.append(np.full(n, k, np.int32))
            at += len(ids)
        whole = lambda xs: np.concatenate([np.zeros(0, np.int32), *xs])
        self.words, self.flat = b" ".join(vocabulary), whole(parts)
        self.begin, self.length, self.owner = whole(begin), whole(length), whole(owner)
        self.item = [i for i, _ in items]
        self.shortest = int(self.length.min()) if len(self.length) else 0


def runs_of(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Places of the words in runs of known words that can hold a window, each run with the place after it (a 0)."""
    edge = np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ok = b - a >= shortest
    mark = np.zeros(len(ids) + 2, np.int8)
    mark[a[ok]] = 1
    mark[b[ok] + 1] -= 1
    return np.flatnonzero(np.cumsum(mark, dtype=np.int8)[: len(ids)])


def search_block(index: FMIndex, phrases: Phrases, number: np.ndarray, doc: np.ndarray, step: np.ndarray, items: list[set]) -> None:
    """Marks the words that the block's windows cover in step (+1 where a cover starts, -1 after it), and adds the items of
    windows that occur to those of their texts. number: the index's symbols of the block's words, 0 for those it lacks."""
    symbols = number[phrases.flat]
    ok = np.concatenate(([0], np.cumsum(symbols == 0)))
    begin, length = phrases.begin.astype(np.int64), phrases.length.astype(np.int64)
    which = np.flatnonzero(ok[begin + length] == ok[begin])  # all words known here
    lo, hi = index.search(symbols, begin[which], length[which])
    which, lo, hi = which[lo < hi], lo[lo < hi], hi[lo < hi]
    if not len(which):
        return
    keys = lo * (int(length.max()) + 1) + length[which]
    _, first, same = np.unique(keys, return_index=True, return_inverse=True)  # equal windows have one interval
    n = hi[first] - lo[first]
    at = index.locate(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[first], n))
    np.add.at(step, at, 1)
    np.add.at(step, at + np.repeat(length[which][first], n), -1)
    held = np.unique(np.repeat(np.arange(len(first)), n) * len(items) + doc[at])  # interval and text
    owned = np.unique(same * len(phrases.item) + phrases.owner[which])
    owner, cut = owned % len(phrases.item), np.searchsorted(owned // len(phrases.item), np.arange(len(first) + 1))
    for interval, d in zip((held // len(items)).tolist(), (held % len(items)).tolist(), strict=True):
        items[d].update(phrases.item[k] for k in owner[cut[interval] : cut[interval + 1]].tolist())


def scan_shard(texts: list[bytes], *blocks: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]], list[int]]:
    """Per text: merged spans of hit words, ids of items with occurring windows, number of words."""
    vocabulary = Numbers()
    n_words, parts = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        n_words.append(len(words))
        parts += [np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    known = np.zeros(len(vocabulary) + 1, bool)
    numbers = []
    for block in blocks:
        numbers.append(np.fromiter(map(vocabulary.get, block.words.split(), repeat(0)), np.int32))
        known[numbers[-1]] = True
    known[0] = False
    ids = np.concatenate([*parts, np.zeros(0, np.int32)])
    kept = runs_of(np.where(known[ids], ids, 0), min((b.shortest for b in blocks if b.shortest), default=1))
    if len(kept) and blocks:
        size = np.array(n_words) + 1
        doc = np.repeat(np.arange(len(texts)), size)[kept]
        word = kept - (np.cumsum(size) - size)[doc]
        held, seq = np.unique(np.where(known[ids[kept]], ids[kept], 0), return_inverse=True)  # 0, the end of a run, is the least
        index = FMIndex(seq, len(held) - 1)
        symbol = np.zeros(len(vocabulary) + 1, np.int64)
        symbol[held] = np.arange(len(held))
        step = np.zeros(len(seq) + 1, np.int64)
        for block, number in zip(blocks, numbers, strict=True):
            search_block(index, block, symbol[np.concatenate(([0], number))], doc, step, items)
        edge = np.diff(np.concatenate(([0], (np.cumsum(step)[:-1] > 0).view(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            spans[doc[a]].append((int(word[a]), int(word[b - 1]) + 1))
    return spans, [sorted(x - {None}) for x in items], n_words


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:  # touching spans are one, as within a pass
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(text: bytes, window: int, most: int):
    """text in pieces of about `most` bytes; each but the last holds window - 1 words of the next one, so no window is lost.
    A piece shorter than a window is never made, as that would be an item of its own."""
    if len(text) <= most:
        yield text
        return
    at = [m.span() for m in WORD.finditer(text.lower())]
    first = 0
    while first < len(at):
        last = first + window - 1
        while last + 1 < len(at) and at[last][1] - at[first][0] < most:
            last += 1
        last = min(last, len(at) - 1)
        yield text[at[first][0] : at[last][1]]
        if last == len(at) - 1:
            return
        first = last - window + 2


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """(Phrases, bytes) of at most about block_bytes of text each."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        for piece in pieces(row[1].encode(), window, block_bytes):
            if block and held + len(piece) > block_bytes:
                yield Phrases(block, window), held
                block, held = [], 0
            block.append((row[0], piece))
            held += len(piece)
    yield Phrases(block, window), held


def benchmark_passes(spark, benchmark: DataFrame, window: int, block_bytes: int, pass_bytes: int):
    """Lists of broadcast blocks of at most pass_bytes of benchmark text (one block at least)."""
    some, held = [], 0
    for block, n in benchmark_blocks(benchmark, window, block_bytes):
        if some and held + n > pass_bytes:
            yield some
            some, held = [], 0
        some.append(spark.sparkContext.broadcast(block))
        held += n
    yield some


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, cut: bool = False, carry: tuple[str, ...] = (), pass_bytes: int = 32 << 20) -> DataFrame:
    """(id, n_words, n_hit, hit, items, *carry), with cut=True also clean: the text without its hit spans (null stays null)."""
    empty = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), empty[0].alias("hit"), empty[1].alias("items"), F.lit(0).cast("long").alias("n_words"), *carry)
    shape = StructType([*StructType.fromDDL(STATE).fields, *(docs.schema[c] for c in carry)])
    passes = benchmark_passes(docs.sparkSession, benchmark, window, block_bytes, pass_bytes)
    blocks = next(passes)
    while (after := next(passes, None)) is not None:
        rows = materialise(rows.mapInArrow(one_pass(blocks, False, cut), shape), "benchmark-pass")
        for block in blocks:
            block.unpersist()
        blocks = after
    rows = rows.mapInArrow(one_pass(blocks, True, cut), shape)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.select("id", "n_words", n_hit.alias("n_hit"), "hit", "items", *carry, *([F.col("text").alias("clean")] if cut else []))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the words that any benchmark window covers; documents of which no word is left go. n_chars follows."""
    rows, names = plain(docs, ("doc_id", "text", "n_chars"))
    own = tuple(c for c in rows.columns if c != "text")
    out = contamination(rows, benchmark, cut=True, carry=own).where("n_hit = 0 or n_hit < n_words")
    n_chars = F.when(F.col("n_hit") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[{"text": F.col("clean").alias("text"), "n_chars": n_chars}.get(c, F.col(c)) for c in rows.columns]).toDF(*names)


def one_pass(blocks: list, last: bool, cut: bool):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, SHARD):
                texts = list(utf8(batch.column(1)))
                spans, items, n_words = scan_shard(texts, *(b.value for b in blocks))
                before = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                spans = [merged([(s["start"], s["end"]) for s in old or ()] + new) for old, new in zip(before[0], spans, strict=True)]
                items = [sorted({*(old or ()), *new}) for old, new in zip(before[1], items, strict=True)]
                text = batch.column(1)
                if last and cut:
                    cleaned = [cut_words(t, s).decode() if s else None for t, s in zip(texts, spans, strict=True)]
                    text = pa.array([c if s else o for c, s, o in zip(cleaned, spans, text.to_pylist(), strict=True)], pa.string())
                elif last:
                    text = pa.nulls(len(texts), pa.string())
                hit = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], HIT)
                yield pa.record_batch([batch.column(0), text, hit, pa.array(items, pa.list_(pa.int64())), pa.array(n_words, pa.int64()), *batch.columns[5:]], ["id", "text", "hit", "items", "n_words", *batch.schema.names[5:]])

    return run


def op9(spark, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute(texts: dict[int, str | None], items: dict[int, str | None], window: int = 10) -> list[tuple]:
    """The contract word for word, for tests."""
    rows, wins = [], []
    for i, t in items.items():
        w = [x.decode() for x in WORD.findall((t or "").encode().lower())]
        wins += [(i, w[a : a + window]) for a in range(max(1, len(w) - window + 1))] if w else []
    for d, t in texts.items():
        w, hit, found = [x.decode() for x in WORD.findall((t or "").encode().lower())], set(), set()
        for i, p in wins:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    found.add(str(i))
        rows.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return rows


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.s = array_to_string(dw.w[dw.p : dw.p + dw.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
