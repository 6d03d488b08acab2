"""Keyed state over streams: rolling turns, first rows and last writers.

State is small and expires: what a session's last turns hold, or one order to a key. It lives in
the state store (RocksDB, on the executors' disks, with changes in the checkpoint), so neither a
batch nor a restart reads what came before. Rows pass through as JSON text; everything that
can be a column expression stays one, before and after the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from skeinworks.operators import masking
from skeinworks.session import reach_workers

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Turns(StatefulProcessor):
    """Emits a message once it is known whether its turn is among its session's last `keep`:
    as stale when a later turn pushes it out, as it is when the session has been idle. Messages
    wait until those before them have come; one that came before is dropped."""

    def __init__(self, keep: int, idle_ms: int) -> None:
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, turn long")
        self.held = handle.getListState("held", "pos long, turn long, row string")
        self.early = handle.getListState("early", "pos long, closes boolean, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, turn = self.place.get() if self.place.exists() else (0, 0)
        waiting = {pos: (closes, row) for pos, closes, row in self.early.get()} if self.early.exists() else {}
        held, latest, fresh = (list(self.held.get()) if self.held.exists() else []), 0, []
        for pdf in rows:
            for pos, closes, row, ms in zip(pdf["pos"], pdf["closes"], pdf["row"], pdf["ms"]):
                latest = max(latest, int(ms))
                if pos >= at:
                    waiting.setdefault(int(pos), (bool(closes), row))
        while at in waiting:
            closes, row = waiting.pop(at)
            fresh.append((at, turn, row))
            last = turn
            at, turn = at + 1, turn + closes
        if fresh:
            held += fresh
            out = [h for h in held if last - h[1] >= self.keep]
            held = [h for h in held if last - h[1] < self.keep]
            self.place.update((at, turn))
            self._keep(self.held, held)
            if out:
                yield self._rows(key, out, True)
        self._keep(self.early, [(p, *w) for p, w in waiting.items()])
        due = latest + self.idle_ms
        timers = list(self.handle.listTimers())
        if not timers or due > max(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The idle session ends: gaps are skipped, what is left is emitted, all is forgotten."""
        _, turn = self.place.get() if self.place.exists() else (0, 0)
        held = list(self.held.get()) if self.held.exists() else []
        last = held[-1][1] if held else 0
        for pos, closes, row in sorted(self.early.get()) if self.early.exists() else []:
            held.append((pos, turn, row))
            last, turn = turn, turn + closes
        for state in (self.place, self.held, self.early):
            state.clear()
        for stale in (True, False):
            rows = [h for h in held if (last - h[1] >= self.keep) == stale]
            if rows:
                yield self._rows(key, rows, stale)

    def close(self) -> None:
        pass

    @staticmethod
    def _keep(state, rows: list) -> None:
        state.put(rows) if rows else state.clear()

    @staticmethod
    def _rows(key, held: list, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"pos": [h[0] for h in held], "turn_id": [h[1] for h in held], "stale": stale, "row": [h[2] for h in held]})


def rolling_turns(messages: DataFrame, session: str, pos: str, at: str, closes: Column, keep: int = masking.TURNS, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """messages with turn_id and stale, as `masking.turns` and `masking.outside_window` give them,
    over a stream: pos counts a session's messages from 0, `at` is their time. A message of a
    stale turn comes as soon as it is stale, the others once the session has been idle; what
    comes after that begins the session anew."""
    reach_workers(messages.sparkSession)
    others = [c for c in messages.columns if c != pos]
    payload = messages.select(*others).schema
    rows = messages.withWatermark(at, late).select(
        _never_null(F.col(session)).alias("session"), F.col(pos).cast("long").alias("pos"), F.coalesce(closes, F.lit(False)).alias("closes"), F.to_json(F.struct(*others)).alias("row"), F.unix_millis(at).alias("ms"), F.col(at).alias("__at"),
    )
    out = rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=_Turns(keep, _millis(messages.sparkSession, idle)), outputStructType=StructType.fromDDL("pos long, turn_id long, stale boolean, row string"), outputMode="Append", timeMode="EventTime",
    )
    return out.select(F.col("pos").alias(pos), F.from_json("row", payload).alias("r"), "turn_id", "stale").select(pos, "r.*", "turn_id", "stale")


class _Last(StatefulProcessor):
    """Emits the row of a key with the greatest order where it is greater than any before."""

    def __init__(self, first: bool, idle_ms: int) -> None:
        self.first, self.idle_ms = first, idle_ms

    def init(self, handle) -> None:
        self.handle, self.best = handle, handle.getValueState("best", "ord long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()[0] if self.best.exists() else None
        found, latest = None, 0
        for pdf in rows:
            latest = max(latest, int(pdf["ms"].max()))
            at = pdf["ord"].idxmin() if self.first else pdf["ord"].idxmax()
            row = (int(pdf["ord"][at]), pdf["row"][at])
            if found is None or (row[0] < found[0] if self.first else row[0] > found[0]):
                found = row
        due = latest + self.idle_ms
        timers = list(self.handle.listTimers())
        if not timers or due > max(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)
        if held is None or not self.first and found[0] > held:
            self.best.update((found[0],))
            yield pd.DataFrame({"ord": [found[0]], "row": [found[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield from ()

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, key: Column, order: str, at: str, first: bool, keep: str, late: str) -> DataFrame:
    reach_workers(rows.sparkSession)
    packed = rows.withWatermark(at, late).select(_never_null(key).alias("key"), F.col(order).cast("long").alias("ord"), F.to_json(F.struct(*rows.columns)).alias("row"), F.unix_millis(at).alias("ms"), F.col(at).alias("__at"))
    out = packed.groupBy("key").transformWithStateInPandas(statefulProcessor=_Last(first, _millis(rows.sparkSession, keep)), outputStructType=StructType.fromDDL("ord long, row string"), outputMode="Append", timeMode="EventTime")
    return out.select(F.from_json("row", rows.schema).alias("r")).select("r.*")


def first_seen(rows: DataFrame, key: Column, order: str, at: str, keep: str = "7 days", late: str = "10 minutes") -> DataFrame:
    """The first row of every key, by arrival and within a batch by order; later ones are
    dropped for as long as the key is met within `keep` of the time `at`."""
    return _keyed(rows, key, order, at, True, keep, late)


def last_writer(rows: DataFrame, key: Column, order: str, at: str, keep: str = "7 days", late: str = "10 minutes") -> DataFrame:
    """The rows that change what a key holds: each of a greater order than all before. A late or
    repeated row changes nothing; a row that deletes is one like others, and while its key is
    kept nothing older brings it back."""
    return _keyed(rows, key, order, at, False, keep, late)


def _never_null(key: Column) -> Column:
    """A key as text, which tells null from all else; workers mix up groups beside a null one."""
    return F.to_json(F.struct(key.alias("k")))


def _millis(spark: SparkSession, interval: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{interval.split()[0]}' {interval.split()[1]}) AS ms").first().ms)


def started(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The stream written as Parquet, with its state in RocksDB."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)
