"""Operators that are tested by recall, held-out accuracy or round trips: embeddings, quality, URLs, WARC; the pipeline."""

import hashlib
import importlib.util
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS, texts_of
from trackweave.llm import common, decontaminate, embeddings, pii, quality, simhash, urlfilter, warc
from trackweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def content(names, rows):
    norm = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert content(df.columns, [tuple(r) for r in df.collect()]) == content(rel.columns, rel.fetchall())


# ---- components ----


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (6000, None)]
    low = {x: x for e in edges for x in e if x is not None}
    for _ in range(400):
        for a, b in edges:
            if b is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in low.items() if k != v}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    df = common.materialise(spark.range(5), "test-clear")
    assert df.count() == 5 and common.clear_intermediate(spark) >= 1
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        df.count()
    assert common.clear_intermediate(spark) == 0


# ---- embeddings ----


def vectors(seed=0, groups=150, dim=24):
    """Chance vectors, near copies at cosines around the threshold, equal and scaled ones."""
    rng = np.random.default_rng(seed)
    out, label = [], []
    for g in range(groups):
        x = rng.normal(size=dim)
        out.append(x)
        for _ in range(g % 4):
            out.append(x + rng.normal(size=dim) * rng.uniform(0, 0.3) * np.linalg.norm(x) / np.sqrt(dim))
        if g % 5 == 0:
            out += [x, 3 * x]
        out[len(label) :] = [v.astype(np.float32) for v in out[len(label) :]]
        label += [g % 3] * (len(out) - len(label))
    return [(k, [float(x) for x in v], c) for k, (v, c) in enumerate(zip(out, label, strict=True))]


def brute_links(rows, least=0.98):
    """id -> (links, component)."""
    links = {i: set() for i, _, _ in rows}
    good = [(i, c, np.array(v, np.float64)) for i, v, c in rows if c is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, (i, c, x) in enumerate(good):
        for j, d, y in good[:k]:
            if c == d and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i].add(j)
                links[j].add(i)
    low = {i: i for i in links}
    for _ in range(len(low)):
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
        if new == low:
            break
        low = new
    return {i: (len(links[i]), low[i]) for i in links}


@pytest.mark.parametrize("tile", [embeddings.TILE, 3])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vectors()
    rows += [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] + [1.0] * 23, 1), (9003, [None] + [1.0] * 23, 1), (9004, [float("inf")] + [1.0] * 23, 1), (9005, rows[0][1], None), (9006, [], 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "rep": F.lit(2)})
    want = brute_links(rows)
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()}
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert links > 300 and sum(n for n, _ in got.values()) >= 0.99 * links  # recall; none is made up:
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i] == (0, i) for i in (9000, 9001, 9002, 9003, 9004, 9005, 9006)) and got[9008] == (1, 9007)


def test_embedding_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 0), (4, v, 0), (4, v, 0), (3, v, 0)], "vec_id long, embedding array<float>, label int")
    assert Counter((r.id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()) == Counter([(None, 0, None), (4, 2, 3), (4, 2, 3), (3, 2, 3)])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_filters_are_those_that_exceed():
    code = embeddings.ProductCode(16, 2000, 16, 16)
    x = np.random.default_rng(1).normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, name = code.decode(x)
    assert code.m == 2
    a, b = (((x @ code.rotation)[:, p:q] @ c.T) for p, q, c in zip(code.cuts, code.cuts[1:], code.codes))
    whole = a[:, :, None] + b[:, None, :]
    for k in range(20):
        want = np.flatnonzero(whole[k].ravel() >= code.least)
        got = name[row == k]
        assert set(want) == set(got) if len(want) else len(got) >= 1


@pytest.mark.parametrize("rows,depth", [(2_000, 2), (1_000_000, 3), (1_000_000_000, 4)])
def test_filters_a_vector_and_recall_by_depth(rows, depth):
    """Pairs at cosine 0.98 exactly, dimension 64: filters a vector stay near per_vector, and pairs share one."""
    code, rng = embeddings.ProductCode(64, rows, 16, 16), np.random.default_rng(2)
    x, z = rng.standard_normal((2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    caps = [[set() for _ in x], [set() for _ in x]]
    for side, v in enumerate((x, y)):
        for at in range(0, len(v), 50):
            for row, name in zip(*(a.tolist() for a in code.decode(v[at : at + 50])), strict=True):
                caps[side][at + row].add(name)
    n = np.mean([len(c) for c in caps[0]])
    recall = np.mean([bool(a & b) for a, b in zip(*caps, strict=True)])
    print(f"depth {code.m}: {n:.1f} filters a vector, recall {recall:.3f}")
    assert code.m == depth and 12 <= n <= 20 and recall >= 0.92
    assert (np.bitwise_count(code.signs(x) ^ code.signs(y)).sum(axis=1) <= embeddings.BITS).all()


def test_embedding_groups_over_tiles_and_crowded_filters(spark, monkeypatch):
    """One large group of near copies, dealt as tile pairs in its filters and in its component: every link is counted once."""
    for name, value in (("TILE", 8), ("SAMPLE", 1), ("MOST_HOT", 10**9)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=32)
    copies = x + rng.normal(size=(120, 32)) * 0.1 * np.linalg.norm(x) / np.sqrt(32)
    rows = [(k, [float(c) for c in v.astype(np.float32)], 0) for k, v in enumerate(np.concatenate([copies, rng.normal(size=(60, 32))]))]
    want = brute_links(rows)
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(n for n, _ in want.values()) > 5000 and got == want


# ---- quality ----


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where("doc_id % 2 = 0")
    got = quality.scored(docs, quality.trained(docs, kept)).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality_score", "score_metadata", "quality").toPandas()
    good, bad = got[got.quality == 1].quality_score, got[got.quality == 0].quality_score
    assert (good >= 0.5).mean() > 0.99 and (bad < 0.5).mean() > 0.95
    assert got.score_metadata.between(0, 1).all()


def test_quality_views_teach_each_other():
    """Few labelled rows: what the metadata view passes on lets the text view learn."""
    rng = np.random.default_rng(0)
    n, known = 900, 80
    y = rng.random(n) < 0.5
    text = rng.normal(size=(n, 60)) + np.outer(2.0 * y - 1, np.r_[np.full(4, 0.7), np.zeros(56)])
    meta = rng.normal(size=(n, 2)) * 0.2 + np.outer(2.0 * y - 1, [1, 1])
    noise = rng.normal(size=(n, 2))
    label = np.where(np.arange(n) < known, y.astype(float), np.nan)
    right = lambda m: ((m.text.log_odds(text) > 0) == y)[known:].mean()
    alone = right(quality.co_train(text, meta, label, rounds=0))
    assert right(quality.co_train(text, meta, label, rounds=4, per_round=100, confidence=0.9)) > alone + 0.03
    assert right(quality.co_train(text, noise, label, rounds=4, per_round=100)) == alone  # a view that knows nothing passes nothing


def test_quality_exchange_looks_at_every_unlabelled_row(spark, monkeypatch):
    """Rows and labels that pass in each round are those of the computation in memory, over all rows and over tables."""
    rng = np.random.default_rng(1)
    word = lambda good: "".join(rng.choice(list("abcdefgh" if good else "mnopqr#{"), rng.integers(2, 8)))
    rows = []
    for k in range(600):
        good = bool(rng.random() < 0.6)
        text = " ".join(word(good if rng.random() < 0.8 else not good) for _ in range(rng.integers(5, 40)))
        rows.append((k, text, "en" if good == (rng.random() < 0.9) else "de", f"s{int(good) + 2 * int(rng.random() < 0.1)}", len(text), int(good)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows[:120]], "doc_id long, quality int, toxic int")
    passed = {"memory": [], "tables": []}
    real = quality.exchange

    def noted(name):
        def run(views, label, choose, *more):
            def seen(*args):
                out = choose(*args)
                passed[name].append({v: sorted((round(float(x.sum()), 4), float(y)) for x, y in zip(*got, strict=True)) for v, got in out.items()})
                return out

            return real(views, label, seen, *more)

        return run

    monkeypatch.setattr(quality, "exchange", noted("tables"))
    a = quality.trained(docs, labels, per_round=40, confidence=0.8)
    monkeypatch.setattr(quality, "exchange", noted("memory"))
    x = np.array([quality.text_features(r[1].encode()) for r in rows], np.float64)
    m = np.array([quality.meta_features(*r[2:5]) for r in rows], np.float64)
    b = quality.co_train(x, m, np.array([r[5] if r[0] < 120 else np.nan for r in rows]), per_round=40, confidence=0.8)
    assert passed["tables"] == passed["memory"] and len(passed["memory"]) == 3 and sum(len(v) for r in passed["memory"] for v in r.values()) > 60
    assert np.allclose(a.scores(x, m)[0], b.scores(x, m)[0])


def test_quality_does_not_depend_on_partitions(spark):
    """Many near ties: one model and one score a row, however the rows are dealt."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(words[: 6 + 6 * (k % 2)], 4)), "en", f"s{k % 3}", 10 * (k % 4)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(160)], "doc_id long, quality int, toxic int")
    got = [sorted(tuple(r) for r in quality.scored(d, quality.trained(d, labels, per_round=30, confidence=0.7)).select("doc_id", "quality_score", "score_text", "score_metadata").collect()) for d in (docs.repartition(n) for n in (1, 3, 7))]
    assert got[0] == got[1] == got[2] and len({r[1] for r in got[0]}) > 50


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(odd_docs, labels)
    assert out.columns == odd_docs.columns and Counter(texts_of(out)) == Counter(DOCS)  # one quality only: all score its share, 1
    assert quality.keep_good(odd_docs.limit(0), labels).count() == 0 and quality.keep_good(odd_docs, labels.limit(0)).count() == len(DOCS)
    many = spark.createDataFrame([(k, f"{'bad### ' * 30 if k % 2 else 'fine words here ' * 9}{k}", None, None, None) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.keep_good(many, marks).collect()} == set(range(0, 60, 2))


# ---- URLs ----


def test_url_rules():
    trie = urlfilter.Trie(urlfilter.RULES)
    cases = {
        "http://a.example.com/en/7": ("example.com/en/7", "allow"), "http://EXAMPLE.com/en/71?x": ("example.com/en/7", "allow"), "http://a.com/en/": ("com/en/", "block"),
        "http://a.com/en": (None, None), "http://x.example.net/de/8": ("example.net/de/8", "block"), "http://net/de/": ("net/de/", "allow"), "http://notexample.com/en/7": ("com/en/", "block"),
        "http://org/es/?q": ("org/es/", "block"), "http://orgx/es/": (None, None), "mailto:x": (None, None), "://": (None, None),
    }
    for url, want in cases.items():
        assert trie.match(*urlfilter.split_url(url)) == want, url
    tie = urlfilter.Trie([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "", "")])
    assert tie.match("z.a.b", "/xy") == ("a.b/x", "block") and tie.match("q", "/") == ("", "allow")
    with pytest.raises(ValueError):
        urlfilter.Trie([("allow", "a", "/")] * 3, max_rules=2)


def test_url_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "HTTP://A.COM/En/?q#f"), (4, "a://b#c/d")], "page_id long, url string").withColumn("id", F.lit("z"))
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(rows).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), None: ("a.com", "/En/", None, "allow"), 4: ("b", "", None, "allow")}
    assert urlfilter.judged(rows.limit(0)).count() == 0


def test_url_rules_by_join_and_by_trie(spark):
    """Rules beyond max_rules are joined: the same result, ties between hosts of equal length and long urls included."""
    rng = np.random.default_rng(4)
    hosts, segments = ["com", "a.com", "b.a.com", "net", "c.net", ""], ["", "x", "xy", "xyz", "q"]
    some = lambda n: ["/" + "/".join(rng.choice(segments, rng.integers(0, 4))) for _ in range(n)]
    rules = [(str(rng.choice(["block", "allow"])), str(h), p[: rng.integers(0, len(p) + 1)]) for h, p in zip(rng.choice(hosts, 60), some(60))]
    rules += [("allow", "a.com", "/x/"), ("block", "c.net", "/x/"), ("block", "a.com", "/x/")]
    urls = [f"http://{h}{p}{q}" for h, p, q in zip(rng.choice([*hosts, "z.b.a.com", "xcom", "A.COM"], 200), some(200), rng.choice(["", "?q", "#f"], 200))]
    urls += [None, "none", "http://a.com/" + "x/" * 20_000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    tuples = lambda df: Counter(tuple(r) for r in df.select("id", "host", "path", "rule", "verdict").collect())
    want = tuples(urlfilter.judged(rows, rules))
    assert want == tuples(urlfilter.judged(rows, table)) == tuples(urlfilter.judged(rows, table, max_rules=5)) == tuples(urlfilter.judged(rows, rules, max_rules=5))
    assert want == tuples(urlfilter.judged(rows, table, max_bytes=40)) == tuples(urlfilter.judged(rows, rules, max_bytes=40))

    def brute(url):
        host, path = urlfilter.split_url(url)
        fits = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in rules if (host or path) and (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=(0, False, None, "allow"))[2:]

    assert {k: (r, v) for k, _, _, r, v in want} == {k: brute(u) for k, u in enumerate(urls)}


# ---- WARC ----


def test_warc_plans_repeats_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "u", str(k % 4) * (990 + k % 3 * 10)) for k in range(40)] + [(50, "u", "y" * 200_000)] * 2, "page_id long, url string, html string")
    plan = lambda: Counter((r.id, r.refers) for r in warc.planned(rows).collect())
    one = plan()
    monkeypatch.setattr(warc, "MOST_REPEATED", 0)
    assert one == plan() and sum(n for (_, refers), n in one.items() if refers is not None) > 10


def test_warc_round_trip(spark):
    big, other = "<p>é\r\n\r\n" + "x" * 1200, "y" * 999
    rows = [(1, "http://a/b?c", big), (2, "http://a\nWARC-Type: fake", big), (3, None, big), (4, "u", other), (5, "u", other), (6, "u", None), (None, "u", big), (3, "again", big), (7, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "digest": F.lit(2)})
    manifest = warc.write_archives(warc.planned(df), roll_bytes=700)
    assert manifest.count() > 1
    records = warc.read_archives(manifest)
    assert dict(records.groupBy("type").count().collect()) == {"response": 7, "revisit": 2, "request": 9, "metadata": 9}
    got = warc.transactions(records).collect()
    assert len(got) == 9 and all(r.n_request == r.n_metadata == 1 for r in got)
    seen = Counter((r.metadata.page_id, r.response.type, r.response.refers_to, r.metadata.payload_bytes, r.response.payload_digest, None if r.response.payload is None else bytes(r.response.payload)) for r in got)
    raw = [(i, (t or "").encode()) for i, _, t in rows]
    stored = lambda i, b: len(b) < 1000 or i is None or i == 3
    assert seen == Counter((i, "response" if stored(i, b) else "revisit", None if stored(i, b) else f"urn:x-page:3:{hashlib.sha1(b).hexdigest()}", len(b), hashlib.sha1(b).hexdigest(), b if stored(i, b) else None) for i, b in raw)
    revisits, ids = records.where("type = 'revisit'"), records.groupBy("record_id").count()
    assert ids.where("count > 1").isEmpty() and revisits.join(records.where("type = 'response'").selectExpr("record_id refers_to", "payload_digest of"), "refers_to").where("of = payload_digest").count() == revisits.count() == 2
    empty = warc.write_archives(warc.planned(df.limit(0)))
    assert warc.transactions(warc.read_archives(empty)).count() == 0


def test_warc_missing_companions(spark):
    manifest = warc.write_archives(warc.planned(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")))
    alone = warc.read_archives(manifest).where("type = 'response'")
    row = warc.transactions(alone).first()
    assert row.request is None and row.metadata is None and bytes(row.response.payload) == b"x"


# ---- pipeline ----


def kept_by_similarity(texts):
    """The stated rule over all pairs: texts with a similarity of 0.8 or more of their five-word shingles are near copies, and
    of each component of near copies the smallest id stays."""
    grams = {i: simhash.shingle_set((t or "").encode(), 5) for i, t in texts.items()}
    low = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and (texts[i] == texts[j] or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]))]
    for _ in texts:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return set(low.values())


def test_pipeline_is_its_stages(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialise(stage(spark, docs, SF), f"test-stage-{k}")
        after.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in after[:-1])
    texts = [dict(texts_of(d)) for d in after[:-1]]
    assert all(set(b) <= set(a) for a, b in zip(texts, texts[1:]))
    assert set(texts[1]) == kept_by_similarity(texts[0]) and len(texts[1]) < len(texts[0])
    # decontamination and personal data
    items = {r.item_id: r.text for r in bench.collect()}
    dirty = {w[0]: w for w in decontaminate.brute(texts[1], items)}
    for i, t in texts[1].items():
        if not dirty[i][2]:
            assert texts[2][i] == t
        elif dirty[i][2] < dirty[i][1]:
            assert len(decontaminate.WORD.findall(texts[2][i].encode().lower())) == dirty[i][1] - dirty[i][2]
        else:
            assert i not in texts[2]
    left = pii.scanned(after[3]).select(F.sum(sum((F.size(k) for k in pii.KINDS), F.lit(0)))).first()[0]
    assert left == 0
    tokens = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in after[4].collect()}
    assert {i: v[1] for i, v in tokens.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts[3].items()}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in whole} == tokens


def test_pipeline_near_dedup_is_similarity_by_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(texts_of(docs))
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    want = kept_by_similarity(texts)
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == want and len(want) < len(texts) - 10


def test_pipeline_stages_take_odd_rows(spark, odd_docs, tmp_path):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = common.materialise(stage(spark, rows, str(tmp_path)), "test-odd")
    assert rows.count() == 0


def test_the_rest_imports_without_these(tmp_path):
    """As when the corpus folders and the pipeline are deleted."""
    root = Path(importlib.util.find_spec("trackweave").origin).parents[1]
    code = (
        "import sys, shutil; from pathlib import Path; root, to = map(Path, sys.argv[1:]);"
        "shutil.copytree(root / 'trackweave', to / 'trackweave', ignore=shutil.ignore_patterns('llm', '__pycache__')); shutil.copytree(root / 'jobs', to / 'jobs'); shutil.copy(root / '__spark_entry__.py', to);"
        "sys.path.insert(0, str(to)); import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-B", "-c", code, str(root), str(tmp_path)], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)
