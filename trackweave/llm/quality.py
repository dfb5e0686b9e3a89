"""Quality classifier by co-training of two views.

The text view sees shares of a document's bytes and words, the metadata view its language, source and length. Both start from
a bounded sample of labelled rows (`max_labelled`, those of smallest id hash). In each round both views score every
unlabelled document; of those that a view is sure of, the `per_round` surest are labelled and handed to the other view,
which learns from them as well (`per_round` bounds the sample that models are fitted on, not what is looked at). At the end a
logistic model on held-out labelled rows calibrates the two views' log odds and combines them; it scores every document in
one pass, without a shuffle. Models are a few hundred numbers and are broadcast.

A model does not depend on how rows are dealt to partitions: odds are summed row by row and rounded to 1e-9 before they are
compared, and ties go to the smaller id. Features are made once and written; a round reads them and writes the ids and odds of the sure documents, which lose those
that have labels in a join of ids.

Nulls and edges: a null text counts as empty; null metadata has a bucket of its own. Labels with null id or quality are
ignored, and of labels that disagree on an id the higher counts. If the sample lacks one of the two qualities, every
document gets the share of good ones (1 if there are no labels) as its score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import documents, materialise, plain, slices, table

DENSE = 13
TEXT_DIM = 256 + DENSE
SOURCES, LANGS, SIZES = 64, 16, 20
META_DIM = SOURCES + LANGS + SIZES
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True


def text_features(text: bytes) -> np.ndarray:
    """Byte shares, and shares of symbols, capitals, digits, repeated words, lines, word pairs and stutters, redundancy; no
    length, which is the other view's."""
    out = np.zeros(TEXT_DIM, np.float32)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / len(text))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    ends = sum(1 for w in words if SYMBOLS[w[-1]])
    unique = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(map(bytes.__eq__, words, words[1:]))
    out[256:] = (
        1, int(counts[SYMBOLS].sum()) / len(text), int(counts[65:91].sum()) / letters, int(counts[48:58].sum()) / len(text),
        ends / n, unique / n, pairs / n, len(set(lines)) / len(lines), len(text) / n / 10, len(lines) / n, sum(map(bytes.isupper, words)) / n,
        len(zlib.compress(text, 1)) / len(text), again / n,
    )
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_DIM, np.float32)
    out[SOURCES - 1 if source is None else zlib.crc32(source.encode()) % (SOURCES - 1)] = 1
    out[SOURCES + (LANGS - 1 if lang is None else zlib.crc32(lang.encode()) % (LANGS - 1))] = 1
    size = SIZES - 1 if n_chars is None else min(SIZES - 2, int(np.log2(max(0, n_chars) + 1)))
    out[SOURCES + LANGS + size] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
        return cls(w, mean, scale)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Summed row by row, in one order, and rounded: a matrix product's last bits depend on how many rows it is given, and
        rows of equal odds would be chosen by them."""
        return np.round(np.clip(np.add.reduce((x - self.mean) / self.scale * self.weights[:-1], axis=1) + self.weights[-1], -30, 30), 9)


@dataclass
class CoTrained:
    text: Logistic | None
    meta: Logistic | None
    both: Logistic | None
    share: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: combined, by text, by metadata."""
        if self.both is None:
            return (np.full(len(text), self.share),) * 3
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        sure = lambda odds: 1 / (1 + np.exp(-odds))
        return sure(self.both.log_odds(np.column_stack([a, b]))), sure(a), sure(b)


def quota(share: float, most: int) -> tuple[int, int]:
    """How many good and bad rows make up `most`, in the labelled rows' proportion, one of each at least."""
    good = max(1, round(most * share))
    return good, max(1, most - good)


def most_sure(odds: np.ndarray, share: float, most: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` rows, good and bad by quota(), of the highest and lowest calibrated log odds beyond `sure`; of equal
    ones the first."""
    good, bad = quota(share, most)
    up, down = np.argsort(-odds, kind="stable"), np.argsort(odds, kind="stable")
    rows = np.concatenate([up[odds[up] >= sure][:good], down[odds[down] <= -sure][:bad]])
    return rows, (odds[rows] > 0).astype(float)


def exchange(views: dict[str, np.ndarray], label: np.ndarray, choose, rounds: int, per_round: int, confidence: float) -> CoTrained:
    """Co-training on labelled rows (label 1 good, 0 bad). A quarter of the rows of either kind is held out; it calibrates each
    view before it may pass labels on, so a view that tells little passes nothing, and it calibrates the combination at the
    end. choose(models, calibrated, share, per_round, sure) gives, by view, the features and labels that the other view
    hands to it in a round."""
    share = float(label.mean()) if len(label) else 1.0
    held = np.concatenate([np.flatnonzero(label == c)[::4] for c in (0.0, 1.0)])
    own = np.setdiff1d(np.arange(len(label)), held)
    if min(len({*label[held]}), len({*label[own]})) < 2:
        return CoTrained(None, None, None, share)
    x = {v: [views[v][own]] for v in views}
    y = {v: [label[own]] for v in views}
    fit = lambda: {v: Logistic.fit(np.concatenate(x[v]), np.concatenate(y[v])) for v in views}
    models, sure = fit(), float(np.log(confidence / (1 - confidence)))
    for _ in range(rounds):
        calibrated = {v: Logistic.fit(models[v].log_odds(views[v][held])[:, None], label[held]) for v in views}
        for v, (more, said) in choose(models, calibrated, share, per_round, sure).items():
            x[v].append(more)
            y[v].append(said)
        models = fit()
    odds = np.column_stack([models[v].log_odds(views[v][held]) for v in ("text", "meta")])
    return CoTrained(models["text"], models["meta"], Logistic.fit(odds, label[held]), share)


OTHER = {"text": "meta", "meta": "text"}


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 3, per_round: int = 500, confidence: float = 0.97) -> CoTrained:
    """exchange() in memory; label: 1 good, 0 bad, NaN unlabelled."""
    known, pool = np.flatnonzero(~np.isnan(label)), np.flatnonzero(np.isnan(label))
    views = {"text": text, "meta": meta}
    free = dict.fromkeys(views, pool)

    def choose(models, calibrated, share, most, sure):
        out = {}
        for a, b in OTHER.items():
            if len(free[b]):
                rows, said = most_sure(calibrated[a].log_odds(models[a].log_odds(views[a][free[b]])[:, None]), share, most, sure)
                out[b] = views[b][free[b][rows]], said
                free[b] = np.delete(free[b], rows)
        return out

    return exchange({v: m[known] for v, m in views.items()}, label[known], choose, rounds, per_round, confidence)


def features(batch: pa.RecordBatch, text: int, lang: int, source: int, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    x = [text_features(t.as_py() or b"") for t in batch.column(text).cast(pa.binary())]
    m = [meta_features(*r) for r in zip(*(batch.column(k).to_pylist() for k in (lang, source, n_chars)), strict=True)]
    return np.array(x, np.float32).reshape(-1, TEXT_DIM), np.array(m, np.float32).reshape(-1, META_DIM)


SEEN = "cast(text as string) text, cast(lang as string) lang, cast(source as string) source, cast(n_chars as long) n_chars"


VIEWS = "doc_id long, x binary, m binary"


def viewed(docs: DataFrame) -> DataFrame:
    """(doc_id, x, m): both views' features as 32-bit floats, of the rows that have an id."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                x, m = features(batch, 1, 2, 3, 4)
                yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], ["doc_id", "x", "m"])

    return docs.selectExpr("cast(doc_id as long) doc_id", *SEEN.split(", ")).where("doc_id is not null").mapInArrow(run, VIEWS)


def matrices(x: pa.Array, m: pa.Array) -> dict[str, np.ndarray]:
    of = lambda column, dim: np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
    return {"text": of(x, TEXT_DIM), "meta": of(m, META_DIM)}


def sure_rows(rows: DataFrame, models: dict, calibrated: dict, sure: float) -> DataFrame:
    """(doc_id, text, meta): calibrated log odds of the rows that either view is sure of."""
    shared = rows.sparkSession.sparkContext.broadcast((models, calibrated))

    def run(batches):
        models, calibrated = shared.value
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                views = matrices(batch.column(1), batch.column(2))
                odds = {v: calibrated[v].log_odds(models[v].log_odds(views[v])[:, None]) for v in views}
                some = pa.array(np.maximum(np.abs(odds["text"]), np.abs(odds["meta"])) >= sure)
                yield pa.record_batch([batch.column(0).filter(some), *(pa.array(odds[v]).filter(some) for v in ("text", "meta"))], ["doc_id", "text", "meta"])

    return rows.mapInArrow(run, "doc_id long, text double, meta double")


def trained(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, rounds: int = 3, per_round: int = 500, confidence: float = 0.97) -> CoTrained:
    """A model for docs. At most max_labelled labelled and 2 * rounds * per_round other rows reach the driver. Of rows that
    repeat an id the greatest by features stands for all in the exchange."""
    spark = docs.sparkSession
    rows = materialise(viewed(docs), "quality-views")
    marks = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as double) quality").where("doc_id is not null and quality is not null")
    sample: dict[int, float] = {}
    for r in marks.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_labelled).collect():
        sample[r[0]] = max(sample.get(r[0], 0.0), r[1])

    def fetch(chosen: dict[int, float]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Features and labels of the chosen ids, in the order of ids; few enough to be broadcast."""
        few = F.broadcast(spark.createDataFrame([*chosen.items()], "doc_id long, said double"))
        got = rows.join(few, "doc_id").groupBy("doc_id", "said").agg(F.max(F.struct("x", "m")).alias("r")).select("doc_id", "said", "r.x", "r.m").toArrow().sort_by([("doc_id", "ascending")])
        return matrices(got.column("x"), got.column("m")), got.column("said").to_numpy()

    taken: dict[str, dict[int, float]] = {"text": {}, "meta": {}}

    def choose(models, calibrated, share, most, sure):
        free = sure_rows(rows, models, calibrated, sure).join(marks.select("doc_id"), "doc_id", "left_anti")
        free = materialise(free.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("meta").alias("meta")), "quality-sure")
        out = {}
        for a, b in OTHER.items():
            if taken[b]:
                free_b = free.join(F.broadcast(spark.createDataFrame([(i,) for i in taken[b]], "doc_id long")), "doc_id", "left_anti")
            else:
                free_b = free
            good, bad = quota(share, most)
            up = free_b.where(F.col(a) >= sure).orderBy(F.desc(a), "doc_id").limit(good).collect()
            down = free_b.where(F.col(a) <= -sure).orderBy(a, "doc_id").limit(bad).collect()
            if chosen := {r["doc_id"]: float(r[a] > 0) for r in (*up, *down)}:
                taken[b] |= chosen
                views, said = fetch(chosen)
                out[b] = views[b], said
        return out

    if not sample:
        return CoTrained(None, None, None, 1.0)
    views, label = fetch(sample)
    return exchange(views, label, choose, rounds, per_round, confidence)


def scored(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """docs with the columns quality_score, score_text, score_metadata and quality_keep added (docs must not have them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]
    added = ["quality_score", "score_text", "score_metadata", "quality_keep"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                both, a, b = shared.value.scores(*features(batch, *at))
                yield pa.record_batch([*batch.columns, pa.array(both), pa.array(a), pa.array(b), pa.array(both >= threshold)], [*batch.schema.names, *added])

    kinds = zip(added, (DoubleType(), DoubleType(), DoubleType(), BooleanType()), strict=True)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, kind) for name, kind in kinds)]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier accepts, with docs's columns."""
    rows, names = plain(docs, ("doc_id", "text", "lang", "source", "n_chars"))
    return scored(rows, trained(rows, labels), threshold).where("quality_keep").select(*rows.columns).toDF(*names)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs, table(spark, sf_dir, "labels"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", *SEEN.split(", "))
    return scored(rows, model).select("doc_id", F.col("quality_score").alias("score"), "score_text", "score_metadata", F.col("quality_keep").alias("keep"))
