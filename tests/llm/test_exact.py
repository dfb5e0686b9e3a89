"""Operators whose results a brute-force version fixes: PII base spans, licences, BPE, repeats, SimHash, decontamination."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, texts_of
from trackweave.llm import bpe, common, decontaminate, licenses, pii, repeats, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_row(rows):
    return Counter(tuple(r) for r in rows)


# ---- PII ----

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = {"ip": lambda: max(map(int, m[0].split("."))) > 255, "card": lambda d=digits: not (16 <= len(d) <= 19 and luhn(d)), "phone": lambda d=digits: not 8 <= len(d) <= 15}.get(kind, lambda: False)
            if not bad():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +12345678 999.1.1.1.1 4111 1111 1111 1111 1.2.3.0000255 \U0001f600 a@b.co", "1" * 60000, "a" * 60000, "+" + "1-" * 20000,
    "1.2" * 2000 + " 4111-1111-1111-1111", "a@b.c" * 1500, "é@b.c é+1 234 567 89", "..@-.-", "4111  1111 1111 1111",
]


def listed(df):
    base = F.flatten(F.array(*[pii.listing(k) for k in pii.KINDS]))
    return df.select("id", base.alias("base"), pii.listing("term").alias("terms"), pii.sanitised(F.col("text"), F.col("removed")).alias("clean"))


def test_pii_base_spans(spark, odd_docs):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in listed(pii.scanned(hard)).collect():
        assert r.base == base_spans(HARD[r.id]), r.id
    got = by_row((r.id, ",".join(r.base)) for r in listed(pii.scanned(odd_docs)).collect())
    assert got == by_row((i, ",".join(base_spans(t))) for i, t in DOCS)


def test_pii_terms_follow_the_corpus(spark):
    near = [(k, f"w{chr(97 + k)} Zebedee writes from zeb{chr(64)}mail.org on day {chr(97 + k)}") for k in range(4)]
    rows = [*near, *[(10 + k, f"plain text on writes from day {k}") for k in range(40)]]
    got = {r.id: r for r in listed(pii.scanned(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k, t in near:
        assert got[k].terms == [f"term:{t.index('Zebedee')}:{t.index('Zebedee') + 7}"]  # only Zebedee stands in no other row
        assert got[k].clean == t.replace("Zebedee", "").replace("zeb@mail.org", "[EMAIL]")
    assert not any(got[10 + k].terms for k in range(40))
    pair = spark.createDataFrame(near[:2] + rows[4:], "doc_id long, text string")
    assert not any(r.terms for r in listed(pii.scanned(pair)).collect())  # two texts are too few to tell


def test_pii_sql_agrees_where_terms_are_found(spark, as_table, tmp_path):
    rows = [(k, f"w{chr(97 + k)} Zebedee Éric writes from zeb{chr(64)}mail.org, Zebedee, +1 (988) 555-248{k} on day {chr(97 + k)}") for k in range(5)]
    rows += [(10 + k, f"plain text on writes from day {k} 4111 1111 1111 1111") for k in range(40)] + [(60, HARD[0]), (61, None), (62, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    as_table(pii, documents=df)
    con = duckdb.connect()
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    rel = con.sql(pii.sql())
    got = pii.op1(spark, "").select(*rel.columns).collect()
    assert by_row(got) == by_row(rel.fetchall()) and sum(r.n_terms for r in got) >= 10


def test_pii_lists_beyond_the_broadcast(spark, monkeypatch, docs):
    rows = [(k, f"Write to jo.bloggs@ex.org, ask for Bloggs at desk {'abcdefgh'[k]}") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100))
    few = {r.id: (r.term, r.removed) for r in pii.scanned(df).collect()}
    monkeypatch.setattr(pii, "MOST_TERMS", 0)
    monkeypatch.setattr(pii, "MOST_ROWS", 0)
    assert few == {r.id: (r.term, r.removed) for r in pii.scanned(df).collect()} and any(few[k][0] for k in range(8))


def test_pii_disclosure_is_the_formula(spark):
    rows = [(k, f"alpha beta x{chr(64)}y.org gamma") for k in range(5)] + [(9 + k, "alpha other") for k in range(5)] + [(50 + k, "nothing here") for k in range(30)]
    rows = [(k, f"{t} uniq{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}") for k, t in rows]
    df = spark.createDataFrame(rows, "id long, text string")
    told = {r.term: r for r in pii.disclosing_terms(df, 6, 0.0, 0.9, 3)[1].collect()}
    n, n_e = len(rows), 5
    assert told["beta"].disclosed == pytest.approx(1.0) and told["beta"].remove
    assert told["alpha"].disclosed == pytest.approx(np.log2(5 * n / (n_e * 10)) / np.log2(n / n_e)) and not told["alpha"].remove


def test_pii_stage_keeps_columns(spark, odd_docs):
    out = pii.without_pii(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(DOCS)
    got = {r["id"]: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == (None, None) and got[0][0].startswith("Call me at [PHONE] or [EMAIL]. The") and got[4][0] == DOCS[4][1]
    assert pii.without_pii(odd_docs.limit(0)).count() == 0 and pii.scanned(odd_docs.limit(0)).count() == 0


# ---- licences ----


def licence_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.fixture
def as_table(monkeypatch):
    """Lets a query read a given table."""

    def give(module, **tables):
        monkeypatch.setattr(module, "documents", lambda spark, sf_dir: tables["documents"])

    return give


def test_licence_base(spark, docs, odd_docs, as_table):
    more = [(20, "under the mit license under the mit license"), (21, "Apache License, Version 2 CC-BY-NC cc by nc"), (22, "under the mit licenses cc by"), (23, "UNDER THE KIT LICENSE underé the mit license")]
    rows = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame(more, "doc_id long, text string"))
    as_table(licenses, documents=rows)
    got = licenses.op2(spark, "").collect()
    assert by_row((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == by_row((i, *licence_base(t)) for i, t in texts_of(rows))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_licence_templates_need_position_and_phrase(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = [gpl, gpl.replace("Public License", "licence public"), " ".join(sorted(gpl.split())), f"intro words first {gpl} and more", "", None] + [f"ordinary words number {k}" for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in licenses.licences(rows).collect()}
    assert [bool(got[k].found) for k in range(6)] == [True, False, False, True, False, False] and got[0].found == ["gpl-3"]
    assert licenses.licences(rows.limit(0)).count() == 0


def test_licence_files_of_several_licences(spark):
    """All of a file's licences are found, however many words they have together."""
    text_of = {label: text for label, text, _ in licenses.TEMPLATES}  # the last, longest one of each label
    sets = [("mit", "bsd-3"), ("bsd-3", "apache-2"), ("mit", "bsd-3", "apache-2"), tuple(text_of), ("bsd-3",)]
    texts = [" ".join(f"part {k} {text_of[label]}." for k, label in enumerate(labels)) for labels in sets]
    texts += [f"Licensed under the GNU General Public License version 3. {text_of['bsd-3']}"] + [f"ordinary words number {k}" for k in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: set(r.found) for r in licenses.licences(rows).collect()}
    assert [got[k] for k in range(len(sets))] == [set(labels) for labels in sets]
    assert got[len(sets)] == {"gpl-3", "bsd-3"} and not any(got[k] for k in range(len(sets) + 1, len(texts)))


def test_licences_score_whole_templates_and_follow_the_sql(spark, as_table):
    """A template word for word scores 1, alone or beside others, in rare and in crowded tables; the SQL gives the same rows."""
    import duckdb

    mit, apache, gpl, bsd = (max((t for label, t, _ in licenses.TEMPLATES if label == want), key=len) for want in ("mit", "apache-2", "gpl-3", "bsd-3"))
    texts = [mit, f"first {bsd} then {mit}", ". ".join((apache, bsd, gpl, mit)), mit.replace("free of charge", "for a fee"), "", None] + [f"ordinary words number {k}" for k in range(97)]
    for more in ([], [mit] * 90, [f"{bsd} {k}" for k in range(300)]):
        rows = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
        as_table(licenses, documents=rows)
        got = {r.doc_id: r for r in licenses.op2(spark, "").collect()}
        assert [got[k].score for k in range(3)] == [1, 1, 1] and got[3].score < 1 and [got[k].score for k in (4, 5)] == [0, 0]
        assert [got[k].labels for k in range(4)] == ["mit", "bsd-3,mit", "apache-2,bsd-3,gpl-3,mit", ""]
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts + more)))
        cursor = con.execute(licenses.sql())
        names = [d[0] for d in cursor.description]
        want = {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}
        assert all({**r.asDict(), "score": None} == {**want[k], "score": None} and abs(r.score - want[k]["score"]) < 2e-6 for k, r in got.items()) and len(want) == len(got)


def test_licences_that_many_rows_hold(spark):
    """Common licence words: a header in a third of the rows, in all rows, and tables of few rows."""
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: file"
    tables = [[f"{head} {k}" if k % 3 == 0 else f"ordinary words number {k}" for k in range(60)], [f"{head} {k}" for k in range(20)], [head, "ordinary words"], [head]]
    for texts in tables:
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.id: r.found for r in licenses.licences(rows).collect()} == {k: ["bsd-3"] if head in t else [] for k, t in enumerate(texts)}


# ---- BPE ----


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(bpe.vocabulary()[0]), bpe.vocabulary()[1])


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80) | st.text("abc éß\n 12!", max_size=80))
def test_bpe_is_the_library(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_long_tokens_and_specials(codec, reference):
    for text in ("é" * 3000, "ab" * 5000, "\U0001f600" * 400, "<|endoftext|>", "zqxj" * 700):
        assert codec.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_memo_is_bounded_by_bytes(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1000)
    texts = [f"{chr(97 + k % 26) * 400}{k} word{k} two" for k in range(30)]
    assert all(codec.encode(t).tolist() == reference.encode_ordinary(t) for t in texts)
    assert sum(len(t.encode()) for t in codec.memo) <= 1000 + 2 * 410


def test_perfect_hash_is_minimal(codec):
    keys = list(codec.ranks)
    assert sorted(codec.hash.place(bpe.hash64(keys)).tolist()) == list(range(len(keys)))


def test_bpe_table(spark, odd_docs, reference, codec):
    def want(t):
        ids = reference.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    out = bpe.tokenised(odd_docs, *bpe.vocabulary())
    rows = out.collect()
    assert by_row((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == by_row((i, *want(t)) for i, t in DOCS)
    assert all(len(r.ids) == r.n_tokens for r in rows) and bpe.tokenised(odd_docs.limit(0), *bpe.vocabulary()).count() == 0


# ---- repeats ----


def removed(texts, length):
    """(bytes, removed, runs) by the operator's kernel alone."""
    text, h, a, e = repeats.anchor_runs(texts, length)
    order = np.lexsort((a, text))
    text, a, e = text[order], a[order], e[order]
    run, off, cut = repeats.maximal_repeats(np.arange(len(text)), b"".join(texts[k][x:y] for k, x, y in zip(text, a, e, strict=True)), e - a, length)
    spans = [[] for _ in texts]
    for r, o, c in zip(run, off, cut, strict=True):
        spans[text[r]].append((a[r] + o, a[r] + o + c))
    merged = [repeats.merged(s) for s in spans]
    return [(len(t), sum(y - x for x, y in m), len(m)) for t, m in zip(texts, merged, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_repeats_kernel_is_the_contract(data):
    letters = data.draw(st.sampled_from(["a", "ab", "abcdefgh"]))
    bases = data.draw(st.lists(st.text(letters, max_size=160), min_size=1, max_size=3))
    texts = []
    for _ in range(data.draw(st.integers(1, 6))):
        b = data.draw(st.sampled_from(bases))
        at = data.draw(st.integers(0, len(b)))
        texts.append((b[at:] + data.draw(st.text(letters, max_size=3)) + b[:at]).encode())
    length = data.draw(st.sampled_from([17, 24, 40]))
    assert removed(texts, length) == [x[:3] for x in repeats.brute(texts, length)]


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats_table(spark, docs, odd_docs, hot):
    rows = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text").where("doc_id is null or doc_id <> 5").selectExpr("doc_id + 1000000", "text"))
    got = by_row((r.id, r.n_bytes, r.n, r.sha) for r in repeats.without_repeats(rows, hot=hot).select("id", "n_bytes", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")).collect())
    order = sorted(texts_of(rows), key=lambda x: (x[0] is None, x[0] or 0))
    want = repeats.brute([(t or "").encode() for _, t in order])
    unique = Counter(i for i, _ in order)
    have = Counter({k: v for k, v in got.items() if unique[k[0]] == 1})
    assert have == by_row((i, w[0], w[2], w[3]) for (i, _), w in zip(order, want, strict=True) if unique[i] == 1)
    assert sum(got.values()) == len(order)


def test_repeats_treats_repeated_rows_as_one_document(spark):
    t = " ".join(str(k * k) for k in range(40))[:150]
    rows = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    assert by_row((r.id, len(r.kept)) for r in repeats.without_repeats(rows).collect()) == by_row([(1, 150), (1, 150), (2, 0), (None, 0)])
    assert repeats.without_repeats(rows.limit(0)).count() == 0


def test_repeats_deal_texts_once_packed_and_their_hashes_only_where_ids_repeat(spark):
    rng = random.Random(5)
    line = " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(40))
    texts = [line + f" {k} " + " ".join(str(rng.random()) for _ in range(20)) for k in range(30)]
    want = [n - cut for n, cut, *_ in repeats.brute([t.encode() for t in texts])]
    for ids, hashed in ((list(range(30)), False), ([0, 0, *range(2, 30)], True)):
        got = repeats.without_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
        kept = [(r.id, len(r.kept)) for r in got.collect()]
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("MapInArrow pack_texts") == 1 and plan.count("ReusedExchange") == 1 and ("xxhash64" in plan) == hashed
        assert hashed or by_row(kept) == by_row(zip(ids, want, strict=True))
    assert all(0 <= r.h < 1 << 40 for r in repeats.runs(spark.createDataFrame([(1, 0, texts[0].encode())], "doc long, th long, text binary"), 100).collect())


def test_repeats_in_pieces_of_a_long_text(spark):
    rng = np.random.default_rng(0)
    t = bytes(rng.integers(97, 101, 5000, np.uint8)).decode()
    t = t + t[1000:2300] + "x" + t[:150]
    rows = spark.createDataFrame([(1, 0, t.encode())], "doc long, th int, text binary")
    windows = lambda df: Counter((r.h, s) for r in df.collect() for s in range(r.place >> 24, (r.place >> 24) + (r.place & 0xFFFFFF) - 99))
    whole = windows(repeats.runs(rows, 100))
    assert windows(repeats.runs(rows, 100, piece=333)) == whole and sorted(s for _, s in whole) == list(range(len(t) - 99))


def test_repeat_groups_hold_all_occurrences():
    left = np.array([1, 2, 2, 3])
    assert repeats.scan_intervals(np.array([30, 50, 30]), left, np.array([3, 1, 2, 0])).tolist() == [30, 30, 30, 0]
    assert repeats.scan_intervals(np.array([30, 50, 30]), np.array([7, 7, 7, 7]), np.array([3, 1, 2, 0])).tolist() == [0, 0, 0, 0]


# ---- SimHash ----


def brute_fingerprint(text, k=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[a : a + k]) for a in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[j] for j in ids if i == j or linked(i, j)]) for i in ids}
        if new == low:
            return low
        low = new


def test_simhash(spark, docs):
    base = texts_of(docs)[:120]
    rows = base + [(10_000 + k, t + " extra") for k, (_, t) in enumerate(base[:30])] + [(20_000, None), (20_001, ""), (20_002, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(list(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = {r.id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_simhash_hash_is_sparks(spark):
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), seed=42)


@pytest.mark.parametrize("radius,tile,n_classes", [(2, 4, 10), (2, 64, 10**9), (5, 16, 10**7), (10, 1024, 200_000)])
def test_buckets_and_tiles_lose_no_link(radius, tile, n_classes):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 40, np.uint64)
    near = fps.copy()
    for k, f in enumerate(fps):
        for b in rng.choice(64, k % (radius + 2), replace=False):
            near[k] = f = f ^ np.uint64(1 << int(b))
    fps = np.unique(np.concatenate([fps, near]))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    d = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    assert simhash.compare_tiles(fps, radius, tile).tolist() == list(brute_components(range(len(fps)), lambda i, j: d[i, j]).values())
    masks = np.array(simhash.block_masks(radius, n_classes), np.uint64)
    i, j = np.nonzero(d)
    assert ((fps[i][:, None] & masks) == (fps[j][:, None] & masks)).any(axis=1).all()


def test_simhash_odd_rows(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(DOCS)
    zero = [r for r in got if r.fp == 0]
    assert {r.component for r in zero} == {2} and len(zero) == 4  # null, empty, blank and the null id's
    same = {r.id: r.component for r in got}
    assert same[7] == same[8] == 7 and same[5] == 5
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_keep_one(spark, odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    left = by_row((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    gone = by_row(DOCS) - left
    assert gone == by_row([(3, ""), (4, " \n\t "), (8, DOCS[8][1])])  # one of each group stays, null ids and repeats of a kept row too
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] + ["changed"] + words[101:])), (3, " ".join(reversed(words)))]
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1, 3}


def test_keep_one_compares_all_neighbours(spark):
    """Near copies go although their nearest fingerprint, here the same one, is that of a different text."""
    stutter = "again " * 700
    own = lambda name: [f"{name}{k}" for k in range(200)]
    changed = own("b")[:100] + ["changed"] + own("b")[101:]
    rows = [(k, stutter + " ".join(w)) for k, w in enumerate((own("a"), own("b"), changed, own("c")), 1)]
    assert len({simhash.fingerprint(t.encode(), 5) for _, t in rows}) == 1
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1, 2, 4}


def planted_pairs(rng, n, words, least, most):
    """Texts of chance words and copies with some of them changed, with the similarity of each pair's shingles."""
    out = []
    while len(out) < n:
        a = [f"t{x}" for x in rng.integers(0, 10**9, words)]
        b = list(a)
        for k in rng.choice(words, rng.integers(1, max(2, words // 30)), replace=False):
            b[k] = f"c{rng.integers(0, 10**9)}"
        x, y = (simhash.shingle_set(" ".join(t).encode(), 5) for t in (a, b))
        if least <= len(x & y) / len(x | y) < most:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_keep_one_recall(spark):
    """Against all pairs, by ranges of similarity; pairs below 0.8 stay apart."""
    rng = np.random.default_rng(5)
    ranges = [(0.7, 0.8), (0.8, 0.85), (0.85, 0.95), (0.95, 1.01)]
    pairs = [planted_pairs(rng, 200, words, *r) for r, words in zip(ranges, (120, 120, 200, 400), strict=True)]
    rows = [(1000 * r + 2 * k + side, text) for r, some in enumerate(pairs) for k, pair in enumerate(some) for side, text in enumerate(pair)]
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    caught = [np.mean([1000 * r + 2 * k + 1 not in left for k in range(200)]) for r in range(4)]
    print("recall of near copies by similarity:", dict(zip(ranges[1:], caught[1:], strict=True)))
    assert all(1000 * r + 2 * k in left for r in range(4) for k in range(200))
    assert caught[0] == 0 and min(caught[1:]) >= 0.98


def test_keep_one_groups_of_near_copies(spark, monkeypatch):
    """A large group whose members are near a few others only, in buckets of several tiles, against all pairs."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(6)
    base, rows = [f"b{k}" for k in range(150)], []
    for i in range(150):
        words = list(base)
        for k in rng.choice(150, rng.integers(0, 7), replace=False):
            words[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    low = brute_components(range(150), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(left) > 3 and left == set(low.values())


def test_crowded_buckets_are_dealt_as_tiles(spark):
    """Tile pairs beyond the radius by population count are not dealt, and no link is lost."""
    rng = np.random.default_rng(7)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 250, np.uint64), np.bitwise_or(*(np.uint64(1) << rng.integers(0, 63, (2, 150), np.uint64)))]))
    rows = spark.createDataFrame([(1, int(f), k) for k, f in enumerate(fps)], "bucket long, fp long, rep long")
    tiles = simhash.tile_counts(rows, 20).collect()
    dealt = simhash.dealt(rows, 2, tile=20)
    all_pairs = sum(r.parts for r in tiles) * (sum(r.parts for r in tiles) + 1) // 2
    some = dealt.select("lo", "hi").distinct().count()
    print("tile pairs skipped by population count:", all_pairs - some, "of", all_pairs)
    assert 0 < some < all_pairs / 2
    edges = dealt.groupBy("shard").applyInArrow(simhash.bucket_links(2), "u long, v long")
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    want = brute_components(range(len(fps)), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 2)
    assert got == {k: v for k, v in want.items() if k != v} and len(got) > 100


@pytest.mark.parametrize("few", [common.FEW, 0])
def test_components_in_one_task_and_by_stars(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (190, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (6000, None)]
    low = {x: x for e in edges for x in e if x is not None}
    for _ in range(400):
        for a, b in edges:
            if b is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in low.items() if k != v}


def test_components_of_hubs(spark, monkeypatch):
    """A hub with most of the links is dealt over several tasks; the result does not change."""
    monkeypatch.setattr(common, "FEW", 0)
    edges = spark.createDataFrame([(0, k) for k in range(1, 900)] + [(k, k + 1000) for k in range(1, 200)] + [(5000, 5001)], "u long, v long")
    low = common.connected_components(edges).collect()
    assert {r.node: r.root for r in low} == {**{k: 0 for k in range(1, 900)}, **{k + 1000: 0 for k in range(1, 200)}, 5001: 5000}


# ---- decontamination ----


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_decontamination_kernel_is_the_contract(data):
    words = st.lists(st.sampled_from(["a", "b", "c", "dd", "É", "x1"]), max_size=30)
    items = {k: " ".join(data.draw(words)) for k in range(data.draw(st.integers(0, 4)))}
    texts = {k: ", ".join(data.draw(words) + data.draw(st.sampled_from([[], items.get(0, "").split()]))) for k in range(3)}
    window = data.draw(st.sampled_from([2, 3, 10]))
    phrases = decontaminate.Phrases([(k, t.encode()) for k, t in items.items()], window)
    spans, found, n = decontaminate.scan_shard([t.encode() for t in texts.values()], phrases)
    got = [(k, n[k], sum(b - a for a, b in spans[k]), len(found[k])) for k in texts]
    assert got == [w[:4] for w in decontaminate.brute(texts, items, window)]


def test_fm_index_against_scans():
    rng = np.random.default_rng(0)
    seq = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in (40, 1, 25, 60)])
    index = decontaminate.FMIndex(seq, 4)
    for length in (1, 2, 4):
        for pattern in {tuple(seq[k : k + length]) for k in range(len(seq) - length)} | {(4,) * length}:
            if 0 in pattern:
                continue
            lo, hi = index.search(np.array(pattern), np.array([0]), np.array([length]))
            want = [k for k in range(len(seq) - length + 1) if tuple(seq[k : k + length]) == pattern]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_table(spark, odd_docs, docs, block_bytes):
    items = [(1, "quick brown fox jumps over the lazy dog again and again"), (2, "Lazy DOG"), (2, "ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum"), (None, "MIT License"), (3, None), (4, ""), (5, "no such words at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 1000, "text"))
    got = decontaminate.contamination(rows, bench, block_bytes=block_bytes)
    got = by_row((r.id, r.n_words, r.n_hit, ",".join(sorted(map(str, r["items"])))) for r in got.collect())
    words = lambda t: decontaminate.WORD.findall((t or "").encode().lower())
    wins = [(i, w[a : a + 10]) for i, t in items for w in [words(t)] if w for a in range(max(1, len(w) - 9))]

    def want(text):
        w, hit, ids = words(text), set(), set()
        for i, p in wins:
            for a in range(len(w) - len(p) + 1):
                if w[a] == p[0] and w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    ids |= {str(i)} if i is not None else set()
        return len(w), len(hit), ",".join(sorted(ids))

    assert got == by_row((i, *want(t)) for i, t in texts_of(rows))


def test_decontamination_of_many_blocks(spark, docs):
    """Blocks of one item or of a piece of one, in one pass or in several: the same result, and one Python node a pass."""
    texts = texts_of(docs)
    cuts = [(k, " ".join(t.split()[3 : 20 + k % 40])) for k, (_, t) in enumerate(texts) if t and len(t.split()) > 70]
    long = (10_000, " ".join(t for _, t in texts[:40] if t))
    bench = spark.createDataFrame([*cuts, *((20_000 + k, cuts[0][1]) for k in range(300)), long], "item_id long, text string")
    got = {}
    for name, sizes in {"whole": {}, "blocks": {"block_bytes": 300}, "passes": {"block_bytes": 3000, "pass_bytes": 25_000}}.items():
        df = decontaminate.contamination(docs, bench, **sizes)
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got[name] = by_row((r.id, r.n_words, r.n_hit, tuple(map(tuple, r.hit)), tuple(r["items"])) for r in df.collect())
    assert len(cuts) > 50 and got["whole"] == got["blocks"] == got["passes"]
    assert max(len(r[4]) for r in got["whole"]) > 300


def test_decontamination_pieces_hold_all_windows():
    words = [f"w{k}" for k in range(500)]
    for most in (1, 40, 333, 10**6):
        some = list(decontaminate.pieces(" , ".join(words).encode(), 10, most))
        wins = {tuple(p.split(b" , ")[a : a + 10]) for p in some for a in range(max(1, len(p.split(b" , ")) - 9))}
        assert wins == {tuple(w.encode() for w in words[a : a + 10]) for a in range(491)}


def test_decontamination_stage(spark, odd_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (2, "x")], "item_id long, text string")
    out = decontaminate.without_benchmark(odd_docs, bench)
    assert out.columns == odd_docs.columns
    got = {r["id"]: (r.text, r.n_chars) for r in out.collect()}
    assert 12 not in got and len(got) == len(DOCS) - 1  # of "x" nothing is left
    assert got[7] == ("The  today.", 11) and got[0][0].endswith("com. The  today.") and got[1] == (None, None) and got[4][0] == DOCS[4][1]
    assert decontaminate.without_benchmark(odd_docs.limit(0), bench).count() == 0
    assert decontaminate.without_benchmark(odd_docs, bench.limit(0)).count() == len(DOCS)
