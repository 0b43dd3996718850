"""Ordered features over a stream, with keyed state in the state store: the batch features of operators.features, event by event.

Events are held back in their key's buffer, by minutes of event time, until the watermark has passed the minute; then a timer takes the
minute's events in (ts, event_ord) order.  So the result does not depend on how events are dealt to micro-batches, nothing is gathered
but a key's events of one minute, and what a key has seen stays in map state, entry by entry, not in memory.  Events behind the
watermark are dropped; events without a timestamp have no place in the order and give no row.

The session has to use the RocksDB state store (`use_state_store`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Calls `step(row)` for each event of the key in order, and yields what it returns."""

    #: Columns of an event besides us and event_ord, with their types; columns of a result besides event_ord and the key.
    columns: dict[str, str] = {}
    results: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{c}: {t}" for c, t in {"us": "bigint", "event_ord": "bigint", **self.columns}.items())
        self.waiting = handle.getMapState("waiting", "minute long", f"events array<struct<{fields}>>")
        self.begin()

    def begin(self) -> None:
        """Makes the key's own state."""

    def step(self, row) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            us = frame["us"].to_numpy()
            for minute, own in frame.groupby(us // MINUTE):
                at, held = (int(minute),), []
                if self.waiting.containsKey(at):
                    held = [tuple(e) for e in self.waiting.getValue(at)[0]]
                else:
                    self.handle.registerTimer(int((minute + 1) * MINUTE // 1000))
                held += [tuple(None if pd.isna(v) else v for v in e) for e in own[["us", "event_ord", *self.columns]].itertuples(index=False, name=None)]
                self.waiting.updateValue(at, (held,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A watermark can pass several minutes at once: the first timer takes all of them, in order.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(m for (m,) in self.waiting.keys() if (m + 1) * MINUTE <= until)
        for minute in due:
            events = sorted(self.waiting.getValue((minute,))[0], key=lambda e: (e[0], e[1]))
            self.waiting.removeKey((minute,))
            made = [(int(e[1]), key[0], *self.step(e)) for e in events]
            yield pd.DataFrame(made, columns=["event_ord", "key", *self.results])

    def close(self) -> None:
        pass


class Principal(Ordered):
    """geo switches, bytes spike, new resources and their count in the window.

    State: last geo and time and both exponential means in one value; resources seen as a map; the times of new ones within the window as
    a list, evicted as the window moves."""

    columns = {"geo": "string", "bytes_out": "double", "resource_id": "string"}
    results = {
        "f_geo_switch": "int", "f_fast_geo_switch": "int", "f_bytes_spike_score": "double", "g_is_new_resource_edge": "int", "g_new_resource_count_win": "long",
        "g_new_resource_rate_win": "double",
    }

    def __init__(self, minutes: int = 30, alpha: float = 0.2, geo_minutes: int = 60):
        self.minutes, self.alpha, self.geo_minutes = minutes, alpha, geo_minutes

    def begin(self) -> None:
        self.own = self.handle.getValueState("own", "geo string, us long, mean double, variance double")
        self.seen = self.handle.getMapState("seen", "resource string", "us long")
        self.recent = self.handle.getListState("recent", "us long")

    def step(self, row) -> tuple:
        us, _, geo, nbytes, resource = row
        last_geo, last_us, mean, var = self.own.get() if self.own.exists() else (None, None, None, 0.0)
        moved = last_geo is not None and geo is not None and geo != last_geo
        fast = moved and us - last_us <= self.geo_minutes * MINUTE
        spike = None
        if nbytes is not None:
            mean = nbytes if mean is None else self.alpha * nbytes + (1 - self.alpha) * mean
            away = nbytes - mean
            var = self.alpha * away * away + (1 - self.alpha) * var
            spike = away / (var**0.5 + 1e-6)
        self.own.update((geo, us, mean, var))
        name = (resource if resource is not None else "",)
        new = name[0].lower() not in ("", "nan", "none", "unknown") and not self.seen.containsKey(name)
        if new:
            self.seen.updateValue(name, (us,))
        recent = [t for (t,) in self.recent.get() if us - t <= self.minutes * MINUTE] + [us] * new
        self.recent.put([(t,) for t in recent]) if recent else self.recent.clear()
        return int(moved), int(fast), spike, int(new), len(recent), len(recent) / float(max(1, self.minutes))


class Device(Ordered):
    """Distance of the posture to the device's exponential mean."""

    columns = {"posture_score": "double"}
    results = {"f_posture_drift": "double"}

    def __init__(self, alpha: float = 0.2):
        self.alpha = alpha

    def begin(self) -> None:
        self.mean = self.handle.getValueState("mean", "mean double")

    def step(self, row) -> tuple:
        x = row[2]
        if x is None:
            return (None,)
        mean = self.alpha * x + (1 - self.alpha) * self.mean.get()[0] if self.mean.exists() else x
        self.mean.update((mean,))
        return (abs(x - mean),)


class Session(Ordered):
    """Distinct clouds of the session so far, less one; the clouds are a map."""

    columns = {"cloud_provider": "string"}
    results = {"g_cross_cloud_hops_session": "long"}

    def begin(self) -> None:
        self.clouds = self.handle.getMapState("clouds", "cloud string", "us long")
        self.number = self.handle.getValueState("number", "n long")

    def step(self, row) -> tuple:
        cloud = (row[2] if row[2] is not None else "unknown",)
        n = self.number.get()[0] if self.number.exists() else 0
        if not self.clouds.containsKey(cloud):
            self.clouds.updateValue(cloud, (row[0],))
            n += 1
            self.number.update((n,))
        return (n - 1,)


#: Key column -> how its features are made.
PROCESSORS = {"principal_id": Principal, "device_id": Device, "session_id": Session}


def features_stream(events: DataFrame, key: str = "principal_id", delay: str = "10 minutes", **options) -> DataFrame:
    """event_ord, the key and its features, for a streaming table of events; key: principal_id, device_id or session_id.

    delay: how late events may come.  options: those of the key's processor (minutes, alpha, geo_minutes)."""
    use_state_store(events.sparkSession)
    made = PROCESSORS[key](**options)
    rows = events.filter("ts IS NOT NULL").withWatermark("ts", delay).select("ts", F.coalesce(key, F.lit("unknown")).alias("_key"), F.unix_micros("ts").alias("us"), "event_ord", *made.columns)
    kind = "event_ord long, key string, " + ", ".join(f"{c} {t}" for c, t in made.results.items())
    return rows.groupBy("_key").transformWithStateInPandas(made, kind, "Append", "EventTime").withColumnRenamed("key", key)
