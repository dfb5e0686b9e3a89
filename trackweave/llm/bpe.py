"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: a bucket's displacement sends all its keys to
free places; no place stays empty) tells in one probe and one comparison whether a pre-token is in the vocabulary as it
stands. Tier two: the other pre-tokens are merged by a heap of (rank, place) over a doubly linked list of bytes.
Each worker keeps a bounded memo of pre-tokens it has resolved. The vocabulary file is read on the driver from the path
given, its size is checked, and it is broadcast; texts stay in their task, nothing is shuffled.

Nulls and edges: a null text counts as empty (no ids); a null id stays. Rows that repeat are encoded each. An empty table gives
no rows. Special tokens are never made: their strings are ordinary text. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

MEMO = 600_000  # pre-tokens a worker remembers before it starts anew,
MEMO_BYTES = 16 << 20  # and bytes of them, so that long ones do not fill it
MOST_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes; it would not be safe to broadcast")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over h and a displacement."""
    x = h ^ (by.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash64(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)


class PerfectHash:
    """Minimal: n keys have places 0..n-1. place(hashes) is right for keys and arbitrary for others."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        h = hash64(keys)
        bucket = (mixed(h, np.zeros(len(h))) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(size)
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        tries = np.arange(1, 257)
        for b in np.argsort(-size, kind="stable"):
            if not size[b]:
                break
            own, base = h[order[ends[b] - size[b] : ends[b]]], 0
            while True:
                at = (mixed(own[:, None], (base + tries)[None, :]) % np.uint64(n)).astype(np.int64)
                free = ~taken[at].any(axis=0)
                if len(own) > 1:
                    ordered = np.sort(at, axis=0)
                    free &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b] = base + tries[k]
                    taken[at[:, k]] = True
                    break
                base += len(tries)
                if base > 1 << 24:
                    raise ValueError("no perfect hash found: keys repeat")

    def place(self, h: np.ndarray) -> np.ndarray:
        bucket = (mixed(h, np.zeros(len(h))) % np.uint64(self.buckets)).astype(np.int64)
        return (mixed(h, self.shift[bucket]) % np.uint64(self.n)).astype(np.int64)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = np.zeros(len(keys), np.uint32)
        for key, p in zip(keys, self.hash.place(hash64(keys)).tolist(), strict=True):
            self.keys[p], self.ids[p] = key, ranks[key]
        self.packed = [x.to_bytes(4, "little") for x in self.ids.tolist()]
        self.packed_id = {r: r.to_bytes(4, "little") for r in ranks.values()}
        self.bytes_of = {r: k for k, r in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        splits = ((ranks.get(key[:c]), ranks.get(key[c:]), r) for key, r in ranks.items() for c in range(1, len(key)))
        self.pairs = {a << 32 | b: r for a, b, r in splits if a is not None and b is not None}
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def merge(self, raw: bytes) -> bytes:
        """Tier two: the lowest-ranked pair first, leftmost among equals. A heap entry is rank << 32 | place; it is stale
        unless the two parts that now meet at its place still merge to that rank."""
        n, pair = len(raw), self.pairs.get
        ids = list(map(self.byte_id.__getitem__, raw))
        heap = [r << 32 | k for k in range(n - 1) if (r := pair(ids[k] << 32 | ids[k + 1])) is not None]
        if heap:
            heapify(heap)
            before, after = list(range(-1, n)), list(range(1, n + 1))
            ids.append(-1)  # nothing merges with the end
        while heap:
            top = heappop(heap)
            k, rank = top & 0xFFFFFFFF, top >> 32
            right = after[k]
            if ids[k] < 0 or ids[right] < 0 or pair(ids[k] << 32 | ids[right]) != rank:
                continue
            ids[k], ids[right] = rank, -1
            after[k] = right = after[right]
            before[right] = k
            if right < n and (r := pair(rank << 32 | ids[right])) is not None:
                heappush(heap, r << 32 | k)
            if (left := before[k]) >= 0 and (r := pair(ids[left] << 32 | rank)) is not None:
                heappush(heap, r << 32 | left)
        return b"".join([self.packed_id[i] for i in ids if i >= 0])

    def resolve(self, tokens: set[str]) -> None:
        if len(self.memo) > MEMO or self.held > MEMO_BYTES:
            self.held = 0
            self.memo.clear()  # before this text's tokens, all of which are resolved below
        new = [t for t in tokens if t not in self.memo]
        if not new:
            return
        raw = [t.encode() for t in new]
        self.held += sum(map(len, raw))
        keys, packed, memo = self.keys, self.packed, self.memo
        for t, r, p in zip(new, raw, self.hash.place(hash64(raw)).tolist(), strict=True):
            memo[t] = packed[p] if keys[p] == r else self.merge(r)

    def encode(self, text: str) -> np.ndarray:
        tokens = self.find(text)
        self.resolve(set(tokens))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, tokens)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


HELD: list = []  # this worker's codec and what it was made of: one worker runs many tasks


def codec_of(vocabulary: tuple[dict[bytes, int], str]) -> Codec:
    if not HELD or HELD[0] != vocabulary:
        HELD[:] = [vocabulary, Codec(*vocabulary)]
    return HELD[1]


def tokenised(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]); ids_sha256 is over little-endian 32-bit ids, and
    decoded_sha256 over the bytes that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))

    def run(batches):
        codec = codec_of(shared.value)
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                n, sha, back, all_ids = [], [], [], []
                for text in batch.column(1):
                    ids = codec.encode(text.as_py() or "")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                cols, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(ends, np.concatenate([*all_ids, np.zeros(0, np.int32)])))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4(spark, sf_dir: str) -> DataFrame:
    return tokenised(documents(spark, sf_dir), *vocabulary(), with_ids=False).withColumnRenamed("id", "doc_id")
