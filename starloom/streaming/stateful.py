"""Stateful streams with timers: rows released in order of event time, leases that expire, and crossings.

Files reach a stream in any order. A key's rows wait in its state until the watermark has passed them, and are then taken in
order of event time, whatever batch they came in; what comes later than that is put out as late and changes nothing. (Spark
itself drops what is later than its watermark, so that is kept back by a grace, and only rows later than this too are lost.)
Timers on event time release rows and end leases, so nothing waits for a key's next row, and state is removed when it is
over: a key holds the rows that wait, and the last one or its open lease.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from starloom.sources.storage import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Takes a key's rows (at in milliseconds, id, value) in order once the watermark has passed them."""

    columns: list[str] = []
    grace_ms = 0  # by which Spark's watermark is behind the one that rows are released by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, value double")

    def step(self, at: int, id_: int, value: float) -> list[tuple]:
        """What a row, the next in order, gives."""
        raise NotImplementedError

    def passed(self, watermark: int) -> list[tuple]:
        """What the passing of time alone gives, and when to ask again."""
        return []

    def due(self) -> int | None:
        """When time alone gives something next."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, late, new = timerValues.getCurrentWatermarkInMs() + self.grace_ms, [], []
        for part in rows:
            for at, id_, value in zip(part["at"].tolist(), part["id"].tolist(), part["value"].tolist(), strict=True):
                (late if at < watermark else new).append((at, id_, value))
        out = [self.late(*r) for r in late]
        yield from self._told(key, out + self._released(watermark, new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, self._released(timerValues.getCurrentWatermarkInMs() + self.grace_ms, []))

    def load(self) -> None:
        """Takes the key's own state into memory, where step(), passed() and due() use it: a key's rows cost one read and one write."""

    def save(self) -> None:
        """Writes the state back if it has changed."""

    def _released(self, watermark: int, new: list[tuple]) -> list[tuple]:
        rows = sorted([*((int(r[0]), int(r[1]), float(r[2])) for r in self.waiting.get()), *new])
        ready = bisect_left(rows, (watermark,))
        rest = rows[ready:]
        self.load()
        out = [x for r in rows[:ready] for x in self.step(*r)] + self.passed(watermark)
        self.save()
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        elif new:
            self.waiting.appendList(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [t for t in (rest[0][0] + 1 if rest else None, self.due()) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1) - self.grace_ms)
        return out

    def late(self, at: int, id_: int, value: float) -> tuple:
        raise NotImplementedError

    def _told(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *self.columns])

    def close(self) -> None:
        pass


class Leases(InOrder):
    """Beats renew a lease; it expires when lease_ms have passed since the last, when the watermark says so and not later."""

    columns = ["kind", "started_at", "last_at", "beats"]
    schema = "key bigint, kind string, started_at bigint, last_at bigint, beats bigint"

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "started bigint, last bigint, beats bigint")

    def load(self) -> None:
        held = self.open.get()
        self.lease = self.held = tuple(int(v) for v in held) if held is not None else None

    def save(self) -> None:
        if self.lease != self.held:
            self.open.update(self.lease) if self.lease else self.open.clear()

    def _ended(self) -> list[tuple]:
        ended, self.lease = self.lease, None
        return [("expired", *ended)]

    def step(self, at: int, id_: int, value: float) -> list[tuple]:
        out = self._ended() if self.lease and at - self.lease[1] > self.lease_ms else []
        self.lease = (self.lease[0], at, self.lease[2] + 1) if self.lease else (at, at, 1)
        return out

    def passed(self, watermark: int) -> list[tuple]:
        return self._ended() if self.lease and watermark - self.lease[1] > self.lease_ms else []

    def due(self) -> int | None:
        return self.lease[1] + self.lease_ms + 1 if self.lease else None

    def late(self, at: int, id_: int, value: float) -> tuple:
        return ("late", at, at, 1)


class Crossings(InOrder):
    """Where a key's value rises over a level: the row with the one before it."""

    columns = ["kind", "before_id", "id"]
    schema = "key bigint, kind string, before_id bigint, id bigint"

    def __init__(self, level: float):
        self.level = level

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "id bigint, value double")

    def load(self) -> None:
        held = self.last.get()
        self.row = self.held = (int(held[0]), float(held[1])) if held is not None else None

    def save(self) -> None:
        if self.row is not self.held:
            self.last.update(self.row)

    def step(self, at: int, id_: int, value: float) -> list[tuple]:
        before, self.row = self.row, (id_, value)
        return [("crossing", before[0], id_)] if before and before[1] < self.level <= value else []

    def late(self, at: int, id_: int, value: float) -> tuple:
        return ("late", None, id_)


def in_order(stream: DataFrame, processor: InOrder, key: str, id_: str, value: str, at: str, delay_s: int, grace_s: int = 86_400) -> DataFrame:
    """A stream (key, at as a timestamp, ...) through a processor. Rows may be late by the delay; later ones are put out as
    late, as long as they are not later by the grace."""
    processor.grace_ms = grace_s * 1000
    rows = stream.withWatermark(at, f"{delay_s + grace_s} seconds").select(F.col(key).cast("long").alias("key"), at, F.unix_millis(at).alias("at_ms"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumnRenamed(at, "event_time").withColumnRenamed("at_ms", "at")
    return rows.groupBy("key").transformWithStateInPandas(processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stateful stream over all that is there, in as many batches as its source makes, and reads back what it put out."""
    spark = stream.sparkSession
    before, out = spark.conf.get(PROVIDER), scratch(spark, name)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", scratch(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(out)
