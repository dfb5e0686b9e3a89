"""Ranked search and byte shards against brute force, and their edges."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackweave.llm import search, sharding

from .conftest import texts_of


def answers(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def expected(texts, items, k=10):
    return sorted(search.brute(texts, items, k), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def queries(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_search_follows_the_contract_on_odd_rows(spark, odd_docs):
    items = [(1, "the quick BROWN fox the fox"), (2, None), (3, ""), (4, "absent words"), (5, "lorem ipsum ünïcode 1.2"), (None, "text id"), (1, "over again"), (6, "...")]
    got = answers(search.search(odd_docs, queries(spark, items)))
    assert got == expected(texts_of(odd_docs), items) and {r[0] for r in got} == {None, 1, 5}
    assert any(r[2] is None for r in got)


def test_search_equals_brute_force_on_the_table(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.collect()]
    want = expected(texts_of(docs), items)
    assert answers(search.search(docs, bench)) == want
    assert answers(search.search(docs.repartition(7), bench, block_bytes=300)) == want  # many blocks, other partitions


def test_search_windows_ties_and_more_equal_ids_than_a_window_holds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, 7, None, rng.randrange(-9000, 9000)]), " ".join(rng.choices("a b c d e f g".split(), k=rng.randrange(0, 6)))) for _ in range(5000)]
    items = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=3))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(search.search(df, queries(spark, items), k=25)) == expected(rows, items, 25)


def test_search_without_documents_or_queries(spark, docs):
    none = docs.where("false")
    assert answers(search.search(none, queries(spark, [(1, "the")]))) == [] and answers(search.search(docs, queries(spark, []))) == []
    assert answers(search.search(docs.withColumn("text", F.lit(None).cast("string")), queries(spark, [(1, "the")]))) == []


def test_search_cuts_long_texts_between_words(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 16)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aB é.9 ") for _ in range(rng.randrange(0, 120))).encode()
        assert [w for some in search.words(text) for w in some] == text.translate(search.FLAT).split()


def test_search_window_stream_keeps_rows_and_bounds():
    win = np.sort(np.random.default_rng(1).integers(0, 4, 9000))
    table = pa.table({"doc_id": np.arange(9000), "win": win})
    got = list(search.windows(iter(table.to_batches(max_chunksize=700))))
    assert all(t.num_rows <= search.WINDOW and len(set(t.column(1).to_pylist())) == 1 for t in got)
    assert np.array_equal(np.concatenate([t.column(0).to_numpy() for t in got]), np.arange(9000))


def test_search_length_norm_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert search.length_norm(n, 10**12, 10**15).tolist() == [10 + 90 * 10**12 // 10**15, 10 + 90 * 10**9 * 10**12 // 10**15]


def places(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_shards_equal_brute_force(spark, docs, odd_docs, n):
    for df in (docs, odd_docs, docs.limit(1), docs.where("false")):
        assert places(sharding.sharded(df, n)) == sorted(sharding.brute(texts_of(df), n), key=repr)


def test_shards_are_near_equal_contiguous_and_gapless(spark, docs):
    rows = sorted(tuple(r) for r in sharding.sharded(docs, 7).collect())
    assert [r[3] for r in rows] == sorted(r[3] for r in rows)
    size = {s: sum(r[1] for r in rows if r[3] == s) for s in range(7)}
    assert max(abs(b - sum(size.values()) / 7) for b in size.values()) < max(r[1] for r in rows)
    assert all([r[4] for r in rows if r[3] == s] == list(range(sum(r[3] == s for r in rows))) for s in range(7))


def test_shards_deal_many_equal_rows_to_many_ranges(spark, monkeypatch):
    seen = []
    real = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    df = spark.createDataFrame([(1, "same text")] * 6000 + [(k, "x" * (k % 50)) for k in range(2000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows make one range
    try:
        assert places(sharding.sharded(df, 13)) == sorted(sharding.brute([tuple(r) for r in df.collect()], 13), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = dict(seen)["shard-ranges"].groupBy("part").count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 4000


def test_written_shards_hold_whole_documents_in_order(spark, odd_docs, tmp_path):
    clash = odd_docs.withColumn("shard", F.lit("own")).withColumn("slot", F.lit(-1))
    for _ in range(2):  # a second run replaces the first
        sharding.write_shards(clash, f"file://{tmp_path}/out", 5)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((repr(r) for r in got.select("doc.*").collect())) == sorted(repr(r) for r in clash.select(*got.select("doc.*").columns).collect())
    want = sharding.brute(texts_of(odd_docs), 5)
    assert sorted(((r.doc.doc_id, r.shard, r.slot) for r in got.collect()), key=repr) == sorted(((r[0], r[3], r[4]) for r in want), key=repr)
    with pytest.raises(ValueError):
        sharding.sharded(odd_docs, 0)
