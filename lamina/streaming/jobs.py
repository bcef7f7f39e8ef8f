"""Job states as state of a stream, and the ring of the last measurements, both kept in the store batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lamina.operators.jobs import ENDS, OPEN
from lamina.sources.store import Store

STATES, RING = "job_states", "recent"
FOLDED = "job_id string, state string, since timestamp, n_events long, n_refused long"


class JobStates(StatefulProcessor):
    """Folds a job's events in the order of their times. An event waits until the watermark has passed it, so that those that come out of order are folded in
    order; one that is told again while it waits counts once, and what comes behind the watermark is dropped, as late rows are."""

    def init(self, handle: Any) -> None:
        self.waiting = handle.getListState("waiting", "at timestamp, n long, status string")
        self.folded = handle.getValueState("folded", "state string, since timestamp, n_events long, n_refused long")
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(r.ts.to_pydatetime(), int(r.event_id), r.status) for r in part.itertuples(index=False)])
            for at in part["ts"].unique():
                self.handle.registerTimer(int(pd.Timestamp(at).value // 1_000_000) + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").to_pydatetime()
        events = sorted({tuple(e) for e in self.waiting.get()}, key=lambda e: e[:2])
        due, rest = [e for e in events if e[0] <= passed], [e for e in events if e[0] > passed]
        if not due:
            return
        self.waiting.put(rest) if rest else self.waiting.clear()
        state, since, n, refused = self.folded.get() if self.folded.exists() else (None, None, 0, 0)
        for at, _, status in due:
            if state is None and status == OPEN or state == OPEN and status in ENDS:
                state, since = status, at
            else:
                refused += 1
            n += 1
        self.folded.update((state, since, n, refused))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "since": pd.to_datetime(pd.Series([since])), "n_events": [n], "n_refused": [refused]})

    def close(self) -> None:
        pass


def follow(events: DataFrame, folder: str, state: str, late: str = "10 minutes") -> StreamingQuery:
    """Keeps the states of the jobs of an event stream (job_id, ts, event_id, status) in the store; what :func:`current` reads equals ``jobs.states`` of the events that the watermark has passed."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where(F.col("job_id").isNotNull()).select("job_id", "ts", F.col("event_id").cast("long").alias("event_id"), "status").withWatermark("ts", late)
    folded = rows.groupBy("job_id").transformWithStateInPandas(JobStates(), FOLDED, "Update", "EventTime")

    def keep(batch: DataFrame, number: int) -> None:
        with Store(batch.sparkSession, folder).begin(number) as tx:
            tx.write(STATES, batch)

    return folded.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, state, since, n_events, n_refused): each job's newest state."""
    rows = Store(spark, folder).read(STATES, FOLDED)
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct("state", "since", "n_events", "n_refused"), F.struct("batch", "n_events")).alias("m"))
    return newest.select("job_id", "m.*")


def measure(events: DataFrame, folder: str, state: str, last: int = 1000, at: str = "ts", order: str = "event_id", value: str = "value") -> StreamingQuery:
    """Keeps the last measurements of a stream: after each batch the ring and the batch's rows together give up all but the newest ``last``.

    The limit keeps a heap in each task, so a batch of any size comes down to ``last`` rows; an event that is told again counts once, and a batch that
    is repeated finds the ring that was there before it.
    """
    rows = events.select(F.col(at).alias("ts"), F.col(order).cast("long").alias("event_id"), F.col(value).cast("double").alias("value"))

    def keep(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, folder)
        before = ring(batch.sparkSession, folder, before=number)
        with store.begin(number) as tx:
            tx.write(RING, before.unionByName(batch).dropDuplicates(["ts", "event_id"]).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(last))

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()


def ring(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(ts, event_id, value) of the newest batch's ring, or of the newest one before a batch; empty after :func:`reset`."""
    store = Store(spark, folder)
    found = store.manifest()["tables"].get(RING, {"parts": []})["parts"]
    known = [p["batch"] for p in found if before is None or p["batch"] < before]
    return store.read(RING, "ts timestamp, event_id long, value double", batches=[max(known)] if known else []).drop("batch")


def reset(spark: SparkSession, folder: str) -> int:
    """Empties the ring: earlier parts are no longer named, and the newest is empty."""
    store = Store(spark, folder)
    seen = store.manifest()
    parts = seen["tables"].get(RING, {"parts": []})["parts"]
    if not parts:
        return seen["version"]
    tx = store.begin(max(p["batch"] for p in parts))
    tx.write(RING, ring(spark, folder).where(F.lit(False)))
    tx.replaced[RING] = {p["path"] for p in parts}
    return tx.commit()
