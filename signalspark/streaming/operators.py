"""Stateful stream operators; each has a batch form with the same results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import events as event_ops
from ..operators.drift import Gate, gate_columns
from ..operators.features import event_weight, firings
from .view_table import merge_batch, read_view

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A user's state lives so long without events (fixed value, seconds).
SESSION_TTL = 1800


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# -- popularity ----------------------------------------------------------------------------


def stream_popularity(stream: DataFrame, by: str = "item_id") -> DataFrame:
    """Running weighted popularity (for update or complete mode)."""
    return stream.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(event_weight(F.col("event_type"))).alias("popularity"))


# -- sessions ------------------------------------------------------------------------------

SESSION_STATE = "session_id string, session_no long, started long, last long, total long, own long, items long, categories long, timer long"
SESSION_OUT = "user_id string, event_id long, session_no long, micros long, total_events long, session_events long, unique_items long, unique_categories long"


_session_row = Row(*[f.split()[0] for f in SESSION_OUT.split(", ")])


class _Sessions(StatefulProcessor):
    """A user's state: one row of counters, and the items and categories of the session that
    goes on, each under its own key, so that a batch touches only those it brings.

    Most users bring few rows: they are folded one by one, in microseconds since 1970, and each
    call of the state, which is a message to the executor, is made only where it is needed."""

    def __init__(self, ttl_seconds: int | None):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", SESSION_STATE)
        self.seen = handle.getMapState("seen", "kind string, name string", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # In order of time and id, nulls last.
        batch = sorted((tuple(r[1:6]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0))
        held = self.state.get()
        session_id, number, started, last, total, own, items, categories, timer = held or (None, 0, None, None, 0, 0, 0, 0, 0)
        fresh, old, known, goes_on = {}, set(), held is not None, held is not None

        def new(kind: str, name: str | None) -> bool:
            """Whether a name is new to the session."""
            if name is None or (kind, name) in fresh or (kind, name) in old:
                return False
            if goes_on and self.seen.containsKey((kind, name)):
                old.add((kind, name))
                return False
            fresh[kind, name] = True
            return True

        for at, event_id, visit, item, category in batch:
            # An idle user is forgotten at the same event, wherever a micro-batch ends.
            if not known or (self.ttl and at is not None and last is not None and at - last > self.ttl * 1_000_000):
                number = total = 0
            if not total or visit != session_id:
                session_id, number, started, own, items, categories, goes_on = visit, number + 1, at, 0, 0, 0, False
                fresh.clear()
                old.clear()
            known, last, total, own = True, at if at is not None else last, total + 1, own + 1
            items, categories = items + new("item", item), categories + new("category", category)
            micros = at - started if at is not None and started is not None else None
            yield _session_row(key[0], event_id, number, micros, total, own, items, categories)
        if held is not None and not goes_on:
            self.seen.clear()
        for name in fresh:
            self.seen.updateValue(name, (1,))
        self._keep(session_id, number, started, last, total, own, items, categories, timer)

    def _keep(self, session_id: str | None, number: int, started: int | None, last: int | None, *others: int) -> None:
        *counters, timer = others
        if self.ttl and last is not None:
            at = last // 1000 + self.ttl * 1000 + 1
            if timer and timer != at:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.state.update((session_id, number, started, last, *counters, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_sessions(stream: DataFrame, *, ttl_seconds: int | None = SESSION_TTL, late: str = "1 hour") -> DataFrame:
    """Session features at each event, with one state per user.

    Events of a user must arrive in order of time between micro-batches; within one they
    are sorted.  A user idle for more than `ttl_seconds` is forgotten: the next event is a new
    user's, and the state goes once the watermark, `late` behind the newest event, has passed.
    Without `ttl_seconds` states stay for good.
    """
    use_rocksdb(stream.sparkSession)
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = stream.select("user_id", at, "event_id", "session_id", "item_id", "item_category", *(["ts"] if ttl_seconds else []))
    if ttl_seconds:
        rows = rows.withWatermark("ts", late)
    mode = "EventTime" if ttl_seconds else "None"
    out = rows.groupBy("user_id").transformWithState(_Sessions(ttl_seconds), outputStructType=SESSION_OUT, outputMode="Append", timeMode=mode)
    seconds = F.col("micros") / F.lit(1_000_000)
    out = out.withColumns({"session_seconds": seconds, "events_per_minute": F.col("total_events") / F.greatest(seconds / 60, F.lit(1.0))})
    return out.select("user_id", "event_id", "session_no", "session_seconds", "total_events", "session_events", "unique_items", "unique_categories", "events_per_minute")


# -- debounce ------------------------------------------------------------------------------


class _Debounce(StatefulProcessor):
    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fired timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        last = np.datetime64(pd.Timestamp(self.last.get()[0]).tz_localize(None), "us") if self.last.exists() else None
        fires, last = firings(batch["ts"].to_numpy(), self.seconds, last)
        if last is not None:
            self.last.update((pd.Timestamp(last).to_pydatetime(),))
        yield batch.iloc[fires][["user_id", "ts", "event_id"]]

    def close(self) -> None:
        pass


def stream_debounce(stream: DataFrame, seconds: int = 300, types: tuple[str, ...] = ("view", "click")) -> DataFrame:
    """Views and clicks that fire: the first of a user, then the first `seconds` or more later."""
    use_rocksdb(stream.sparkSession)
    rows = stream.where(F.col("event_type").isin(*types)).select("user_id", "ts", "event_id")
    return rows.groupBy("user_id").transformWithStateInPandas(_Debounce(seconds), outputStructType="user_id string, ts timestamp, event_id long", outputMode="Append", timeMode="None")


# -- alert gate ----------------------------------------------------------------------------

GATE_OUT = "model string, checked_at timestamp, alert boolean, run_length int"


class _Gates(StatefulProcessor):
    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "run int, last timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("checked_at", kind="stable")
        run, last = self.state.get() if self.state.exists() else (0, None)
        gate = Gate(run, np.datetime64(pd.Timestamp(last).tz_localize(None), "us") if last is not None else None, **self.options)
        alerts, runs = gate.fold(*gate_columns(batch))
        self.state.update((gate.run, pd.Timestamp(gate.last).to_pydatetime() if gate.last is not None else None))
        yield pd.DataFrame({"model": key[0], "checked_at": batch["checked_at"].to_numpy(), "alert": alerts, "run_length": runs})

    def close(self) -> None:
        pass


def stream_alert_gate(checks: DataFrame, **options: Any) -> DataFrame:
    """The alert gate over a stream of checks (model, checked_at, drift, psi, confidence)."""
    use_rocksdb(checks.sparkSession)
    rows = checks.select("model", "checked_at", "drift", "psi", "confidence")
    return rows.groupBy("model").transformWithStateInPandas(_Gates(options), outputStructType=GATE_OUT, outputMode="Append", timeMode="None")


# -- sinks ---------------------------------------------------------------------------------


def append_to_table(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Write each micro-batch under its own folder of `path`: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row of each key of an update-mode table written by append_to_table."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("last")).select(*keys, "last.*")


def stream_online_view(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert feature-log rows into a view table; a micro-batch writes the buckets that it
    changes, and repeating one gives the same table."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_online_view(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the view."""
    return read_view(spark, path)


class EventPipeline:
    """Decode, route and validate messages; hand valid events to handlers by type and keep
    the rest as dead letters."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[DataFrame, int], None]]] = {}

    def on(self, event_type: str, handler: Callable[[DataFrame, int], None]) -> EventPipeline:
        """Register a function of (events of the type, batch id); every handler of a type is called."""
        self.handlers.setdefault(event_type, []).append(handler)
        return self

    def process(self, messages: DataFrame, batch_id: int, dead_letter_path: str) -> None:
        valid, invalid = event_ops.validate_events(event_ops.route_event_type(event_ops.decode_events(messages)))
        for event_type, handlers in self.handlers.items():
            own = valid.where(F.col("event.event_type") == event_type).select("topic", "contract", "event.*").drop("_corrupt")
            for handler in handlers:
                handler(own, batch_id)
        event_ops.dead_letters(invalid).write.mode("overwrite").parquet(f"{dead_letter_path}/batch_id={batch_id}")

    def start(self, messages: DataFrame, dead_letter_path: str, checkpoint: str) -> StreamingQuery:
        """Run over what is available; offsets are committed once handlers and dead letters are done."""
        run = lambda batch, batch_id: self.process(batch, batch_id, dead_letter_path)
        return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
