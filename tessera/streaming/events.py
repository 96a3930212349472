"""Structured Streaming plans over event files: windows with a watermark, sessions, incremental ingest and history."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.collections import Collections

#: Parts of a store that is ingested into.
PARTS = 64


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """The event files of a folder as a stream with an event-time timestamp."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str | None = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    return rows.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def history(events: DataFrame, last: int = 10) -> DataFrame:
    """The last event ids of each user, kept in state and capped."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            held = sorted([*held, *b["event_id"].tolist()])[-last:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "recent": [held]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, recent array<long>", "recent array<long>", "update", GroupStateTimeout.NoTimeout)


class LastEvents(StatefulProcessor):
    """The last event ids of a user as a value in state; every batch of a user's events gives one row."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "recent array<long>")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()[0]) if self.held.exists() else []
        for b in rows:
            held = sorted([*held, *b["event_id"].tolist()])[-self.last :]
        self.held.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "recent": [held]})

    def close(self) -> None:
        pass


def history_with_state(events: DataFrame, last: int = 10) -> DataFrame:
    """``history`` by transformWithState; it needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(LastEvents(last), "user_id long, recent array<long>", "update", "none")


class Progress(StreamingQueryListener):
    """Calls back with what a stream does: (event, facts), where the event is started, progress or ended."""

    def __init__(self, say: Callable[[str, dict], None]):
        self.say = say

    def onQueryStarted(self, event) -> None:
        self.say("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.say("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say("ended", {"id": str(event.id), "error": event.exception})


def ingest_once(stream: DataFrame, store: str, checkpoint: str, key: str):
    """Appends rows whose key the store doesn't have; started with availableNow.

    The store is divided by a hash of the key, so a batch reads the keys of the parts that it has rows for, no others.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS at most
        try:
            new = new.join(spark.read.parquet(store).where(F.col("part").isin(parts)).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").partitionBy("part").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(files: DataFrame, held: Collections, name: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, stream: str):
    """Upserts the points of files (path, content), each file's content once; started with availableNow.

    parse gets (path, content, file_hash) and returns points with their file_hash. Files whose hash the collection has are
    left out, and of equal files in a batch one is taken. A batch is committed with its number, so that one which is run
    again, because it failed or because its end wasn't written down, changes nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        if held.manifest(name)["streams"].get(stream, -1) >= number:
            return
        hashed = batch.select("path", "content", F.sha2("content", 256).alias("file_hash"))
        first = hashed.groupBy("file_hash").agg(F.min("path").alias("path"))
        new = first.join(held.points(name).select("file_hash"), "file_hash", "left_anti")
        held.upsert(name, parse(hashed.join(new, ["file_hash", "path"], "left_semi").select("path", "content", "file_hash")), (stream, number))

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Loops(StatefulProcessor):
    """How often each route of a workflow was taken, as a map in state, with a cap.

    By event time: a timer clears a workflow that has had no event for ``gap`` milliseconds, and tells so; a new event puts
    it off. By processing time: a route's count lives ``ttl`` milliseconds from its last change. Counts of earlier runs come
    in as initial state.
    """

    def __init__(self, cap: int, gap: int | None, ttl: int | None):
        self.cap, self.gap, self.ttl = cap, gap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "route string", "n long", self.ttl)
        self.until = handle.getValueState("until", "at long")

    def _add(self, route: str, n: int) -> int:
        held = self.counts.getValue((route,))[0] if self.counts.containsKey((route,)) else 0
        self.counts.updateValue((route,), (held + n,))
        return held + n

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: Any) -> None:
        for route, n in zip(initialState["route"].tolist(), initialState["n"].tolist(), strict=True):
            self._add(route, n)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest, seen = 0, []
        for b in rows:
            latest = max(latest, int(b["ts"].astype("datetime64[ms]").astype("int64").max()))
            seen += b.sort_values(["ts", "event_id"])["route"].tolist()
        out = [(key[0], r, n, "continue" if n <= self.cap else "max_iterations_exceeded") for r in seen for n in [self._add(r, 1)]]
        if self.gap is not None:
            before = self.until.get()[0] if self.until.exists() else 0
            if latest + self.gap > before:
                if before:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(latest + self.gap)
                self.until.update((latest + self.gap,))
        yield pd.DataFrame(out, columns=["workflow", "route", "n", "decision"])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        total = sum(v[0] for v in self.counts.values())
        self.counts.clear()
        self.until.clear()
        yield pd.DataFrame({"workflow": [key[0]], "route": [None], "n": [total], "decision": ["expired"]})

    def close(self) -> None:
        pass


def loops(events: DataFrame, cap: int, gap: int | None = None, ttl: int | None = None, initial: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """(workflow, route, n, decision) for every event (workflow, event_id, ts, route): the how-manieth of its route it is, and
    whether the loop goes on; with gap (milliseconds of event time) a row ``expired`` where a workflow has come to rest.

    initial: (workflow, route, n), the counts to start from. Events later than the watermark are left out.
    """
    if (gap is None) == (ttl is None):
        raise ValueError("either a gap in event time or a time to live in processing time")
    rows = events.withWatermark("ts", late) if gap is not None else events
    start = initial.groupBy("workflow") if initial is not None else None
    return rows.groupBy("workflow").transformWithStateInPandas(Loops(cap, gap, ttl), "workflow long, route string, n long, decision string", "append", "eventTime" if gap is not None else "processingTime", start)
