"""Linking frames as they arrive: mutual nearest neighbours and their chains, as linking.mutual_links and linking.chains find them on a
whole table.

A frame's event time is the end of the frame, (t + 1) times `frame_seconds`; frames count from 0. Frames may come in any order and in pieces, up to `delay` frames behind the
latest one; the watermark then closes them, and what comes later still is dropped. A movie's state is the frames that are not
closed yet and the points of its last closed frame, each with the first point of its chain: these are the open tracks. A frame is
linked when it closes; its points are given out then, and the frame before it is forgotten. A timer at the next frame's time forgets
the open tracks of a movie that has ended, so state is bounded by what is open and never by a movie's length.

The last `delay` frames wait until later ones close them; a row of a later frame without an id does that and is nothing else. Points
without a place are chains of their own. Ids are unique over a movie's frames. State lives in RocksDB, which the session must have
chosen (`with_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import near

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = "id array<long>, x array<double>, y array<double>, z array<double>"


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def mutual(a: np.ndarray, a_id: np.ndarray, b: np.ndarray, b_id: np.ndarray, max_dist: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a and b that are each other's nearest, closer than max_dist; of equal distances the smaller id."""
    placed_a, placed_b = (np.flatnonzero(np.isfinite(p).all(axis=1)) for p in (a, b))
    i, j = near(a[placed_a], b[placed_b], max_dist)
    i, j = placed_a[i], placed_b[j]
    dist = np.linalg.norm(a[i] - b[j], axis=1)

    def best(of: np.ndarray, other: np.ndarray) -> np.ndarray:
        order = np.lexsort((other, dist, of))
        return order[np.concatenate(([True], np.diff(of[order]) != 0))] if len(order) else order

    both = np.intersect1d(best(i, b_id[j]), best(j, a_id[i]))
    return i[both], j[both]


class Linker(StatefulProcessor):
    def __init__(self, key: str, max_dist: float, frame_seconds: int):
        self.key, self.max_dist, self.frame_ms = key, max_dist, 1000 * frame_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t int", FRAME)
        self.open = handle.getValueState("open", f"t int, {FRAME}, head array<long>, place array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            for t, frame in some[some["id"].notna()].groupby("t"):
                at = (int(t),)
                held = self.waiting.getValue(at) if self.waiting.containsKey(at) else ([],) * 4
                self.waiting.updateValue(at, tuple([*old, *frame[c].astype("int64" if c == "id" else "float64").tolist()] for old, c in zip(held, ("id", *"xyz"), strict=True)))
                self.handle.registerTimer((at[0] + 1) * self.frame_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // self.frame_ms - 1
        for t in sorted(k[0] for k in self.waiting.keys() if k[0] <= closed):
            frame = self.waiting.getValue((t,))
            self.waiting.removeKey((t,))
            id_, place = np.array(frame[0], np.int64), np.array(frame[1:], float).T
            head, steps = id_.copy(), np.zeros(len(id_), np.int32)
            before = self.open.get() if self.open.exists() else None
            if before is not None and before[0] == t - 1:
                i, j = mutual(np.array(before[2:5], float).T, np.array(before[1], np.int64), place, id_, self.max_dist)
                head[j], steps[j] = np.array(before[5], np.int64)[i], np.array(before[6], np.int32)[i] + 1
            self.open.update((t, *frame, head.tolist(), steps.tolist()))
            self.handle.registerTimer((t + 2) * self.frame_ms)
            yield pd.DataFrame({self.key: [key[0]] * len(id_), "id": id_, "t": np.full(len(id_), t, np.int32), "head": head, "place": steps})
        if self.open.exists() and self.open.get()[0] < closed:  # no frame can follow it any more
            self.open.clear()


def stream_chains(points: DataFrame, key: str, max_dist: float, delay: int = 10, frame_seconds: int = 60) -> DataFrame:
    """Stream of (key, t, id, x, y, z) -> stream of (key, id, t, head, place): the first point of each point's chain and the steps
    from it, given out once the frame is closed."""
    at = F.timestamp_seconds((F.col("t").cast("long") + 1) * frame_seconds)
    rows = points.select(key, F.col("t").cast("int").alias("t"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], at.alias("at")).where(f"{key} is not null and t >= 0")
    kind = dict(points.dtypes)[key]
    return rows.withWatermark("at", f"{delay * frame_seconds} seconds").groupBy(key).transformWithStateInPandas(
        statefulProcessor=Linker(key, max_dist, frame_seconds), outputStructType=f"{key} {kind}, id long, t int, head long, place int", outputMode="Append", timeMode="EventTime"
    )
