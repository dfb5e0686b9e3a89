"""Ranked lexical search: each query's best documents by saturated term frequency and rarity, all in 64-bit integers.

Terms are runs of letters, digits and characters beyond ASCII; A-Z are lower-cased. Queries come in blocks of at most
`block_bytes` of distinct terms (one query at least), whose terms and weights are broadcast; each block reads the texts once.
That pass writes one row of postings a document: its length and the counts of the block's terms. N, L and document frequencies
are aggregates of these rows. Then postings are dealt by windows of WINDOW consecutive ids. A task takes its windows in
order of ids, turns each into posting lists, and for each query adds the lists' contributions into one array of the window's
scores, while the lists' bitsets are or-ed to an occupancy; what is occupied is harvested into the query's heap of k documents,
and the array is cleared there. Tasks give k rows a query at most; the k best of these are the result. A task holds one window of
postings, one block of terms and its heaps, whatever the number of documents.

Nulls and edges: null and empty texts, and texts without a term, have no postings and do not count in N. Rows that repeat an id
are documents of their own; beyond WINDOW of them they are scored window by window. Rows without an id are spread over windows
of their own and come last among equal scores. Rows of one query id are one query; a null query id is an id. Ties go to the smaller
doc_id. Queries without terms or without a score above 0 give no rows, and so do empty tables. Extra columns are not read. Texts
are cut into words in pieces of PIECE bytes, so a very long text needs some ten times PIECE.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, id_of, materialise, slices, table, utf8

WINDOW = 2048  # ids of a window; its scores take 16 KB
BLOCK = 4 << 20
PIECE = 1 << 20
NO_ID = -(1 << 63)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FLAT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
POSTINGS = "doc_id long, win long, n long, term array<int>, tf array<int>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some PIECE bytes at a time."""
    flat, at = text.translate(FLAT), 0
    while at < len(flat):
        end = len(flat)
        if end - at > PIECE:
            cut = flat.rfind(b" ", at, at + PIECE)
            cut = cut if cut >= 0 else flat.find(b" ", at + PIECE)
            end = cut + 1 if cut >= 0 else end
        yield flat[at:end].split()
        at = end


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, its terms), in lists of at most block_bytes of terms. The driver holds one block."""
    terms = queries.select(id_of(queries, "item_id"), F.explode(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), 0)).alias("term"))
    block, held, last = [], 0, object()
    for item, term in terms.distinct().orderBy("item_id", "term").toLocalIterator():
        if item != last:
            if held > block_bytes:
                yield block
                block, held = [], 0
            block.append((item, []))
            last = item
        block[-1][1].append(term.encode())
        held += len(term.encode())
    if block:
        yield block


def postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """One row a document with terms: its length in terms and the vocabulary's terms with their counts."""

    def run(batches):
        known = vocabulary.value
        for whole in batches:
            for batch in slices(whole):
                out = []
                for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                    counts, n = Counter(), 0
                    for some in words(text):
                        n += len(some)
                        counts.update(some)
                    if n:
                        held = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
                        win = i // WINDOW if i is not None else NO_ID + (n + sum(t * c for t, c in held)) % WINDOW
                        out.append((i, win, n, [t for t, _ in held], [c for _, c in held]))
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "win", "n", "term", "tf"])

    return docs.select(id_of(docs, id_col), F.col(text_col).cast("string")).mapInArrow(run, POSTINGS)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by win -> one table a window, of WINDOW rows at most."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        win = batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(win[1:] != win[:-1]) + 1), len(win)]
        for a, b in zip(edges, edges[1:], strict=False):
            while a < b:
                if held and (win[a] != last or rows == WINDOW):
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                part = batch.slice(a, min(b - a, WINDOW - rows))
                held.append(part)
                last, rows, a = win[a], rows + part.num_rows, a + part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L; by whole numbers of any size where 64 bits are too few."""
    wide = n.astype(object) if 90 * int(n.max()) * docs >= 1 << 63 else n
    return (10 + 90 * wide * docs // total).astype(np.int64)


class Scorer:
    """Scores windows for all queries of a block; best[q] is the heap of query q: (score, -doc_id)."""

    def __init__(self, queries: list[np.ndarray], weight: np.ndarray, docs: int, total: int, k: int):
        self.weight, self.docs, self.total, self.k = weight, docs, total, k
        self.terms = np.concatenate(queries)
        self.ends = np.cumsum([len(q) for q in queries])
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.scores = np.zeros(WINDOW, np.int64)

    def add(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        id_ = np.array([NO_ID if i is None else -i for i in rows.column(0).to_pylist()], object)
        m = length_norm(rows.column(2).to_numpy(), self.docs, self.total)
        lists = rows.column(3).combine_chunks()
        slot = np.repeat(np.arange(len(id_)), lists.value_lengths().to_numpy())
        term, tf = lists.flatten().to_numpy(), rows.column(4).combine_chunks().flatten().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, tf, slot = term[order], tf[order], slot[order]
        gain = self.weight[term] * (10**9 * tf // (1000 * tf + 8 * m[slot]))
        held, start, list_of = np.unique(term, return_index=True, return_inverse=True)
        start = np.append(start, len(term))
        bits = np.zeros((len(held), WINDOW // 8), np.uint8)
        np.bitwise_or.at(bits, (list_of, slot >> 3), (128 >> (slot & 7)).astype(np.uint8))
        at = np.minimum(np.searchsorted(held, self.terms), max(0, len(held) - 1))
        found = held[at] == self.terms if len(held) else np.zeros(len(self.terms), bool)
        begin = 0
        for heap, end in zip(self.best, self.ends, strict=True):
            mine = at[begin:end][found[begin:end]]
            begin = end
            if len(mine):
                for a, b in zip(start[mine], start[mine + 1], strict=True):
                    self.scores[slot[a:b]] += gain[a:b]  # a document stands once in a list
                self.harvest(heap, np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[mine], axis=0))), id_)

    def harvest(self, heap: list[tuple[int, int]], occupied: np.ndarray, id_: np.ndarray) -> None:
        score = self.scores[occupied]
        self.scores[occupied] = 0
        least = max(1, heap[0][0] if len(heap) == self.k else 1)
        if len(score) > self.k:
            least = max(least, int(np.partition(score, -self.k)[-self.k]))
        good = score >= least
        for s, i in heapq.nlargest(self.k, zip(score[good].tolist(), id_[occupied[good]].tolist(), strict=True)):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, i))
            else:
                heapq.heappushpop(heap, (s, i))


def ranked_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, doc_id, score): of each task and query of the block the k best documents."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    index = materialise(postings(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "search-postings")
    n_docs, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = index.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()  # a row a term of the block at most
    df = np.zeros(len(vocabulary), np.int64)
    df[counts.column("term").to_numpy()] = counts.column("count").to_numpy()
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    items = [i for i, _ in block]
    held = spark.sparkContext.broadcast(([np.array([vocabulary[t] for t in terms], np.int32) for _, terms in block], weight))

    def run(batches):
        scorer = Scorer(*held.value, n_docs, total, k)
        for rows in windows(batches):
            scorer.add(rows)
        out = [(items[q], None if i == NO_ID else -i, s) for q, heap in enumerate(scorer.best) for s, i in heap]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    rows = index.where("size(term) > 0").repartition("win").sortWithinPartitions("win", "doc_id")
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """queries (item_id, text) -> (item_id, rank, doc_id, score): the k documents of highest score above 0."""
    out = None
    for block in query_blocks(queries, block_bytes):
        part = ranked_block(docs, block, k, id_col, text_col)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def brute(texts: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """The contract word for word, for tests."""
    import re

    low = lambda t: re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, w) for i, t in texts if (w := low(t))]
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(low(t))
    total = sum(len(w) for _, w in rows)
    df = Counter(x for _, w in rows for x in set(w))
    out = []
    for item, terms in asked.items():
        found = []
        for i, w in rows:
            m, tf = 10 + 90 * len(w) * len(rows) // total, Counter(w)
            s = sum(floor(1000 * log((2 * len(rows) + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms if tf[x])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
tot AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p CROSS JOIN tot GROUP BY term, nn),
g AS (SELECT r, doc_id, p.term, wt.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))) AS gain FROM p JOIN wt ON wt.term = p.term CROSS JOIN tot),
s AS (SELECT item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN g ON g.term = q.term GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0) WHERE k <= 10
"""
