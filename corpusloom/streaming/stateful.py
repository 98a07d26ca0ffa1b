"""Keyed state with a time to live: results kept for repeats, and alerts that are taken back.

Both run on event time.  What an entry's age decides is read from its own time, so an answer does not depend on batches;
timers only remove entries once the watermark has passed their end, which bounds the state.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Workers get the stateful classes by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(df: DataFrame) -> DataFrame:
    """Set the state store that ``transformWithState`` needs."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


class KeptResult(StatefulProcessor):
    """One result per key, computed by the row that found none and given to all rows that come before it is too old.

    A share of the keys has one state, read and written once a batch, so that a batch costs a call for each share and not for each key.
    """

    def __init__(self, key: str, row_id: str, compute: Callable[[pd.DataFrame], pd.Series], kinds: tuple[str, str, str], live_ms: int):
        self.key, self.row_id, self.compute, self.kinds, self.live_ms = key, row_id, compute, kinds, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "keys array<{}>, at_us array<bigint>, source array<{}>, result array<{}>".format(*self.kinds))

    def read(self) -> dict:
        return {k: v for k, *v in zip(*self.kept.get())} if self.kept.exists() else {}

    def write(self, kept: dict) -> None:
        if not kept:
            return self.kept.clear()
        self.kept.update((list(kept), *map(list, zip(*kept.values()))))
        first = min(v[0] for v in kept.values()) // 1000 + self.live_ms + 1
        if first < min(self.handle.listTimers(), default=first + 1):
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        new = new.assign(_key=pd.factorize(new[self.key], use_na_sentinel=False)[0]).sort_values(["_key", "event_us", self.row_id], ignore_index=True)
        keys = [None if k is None or k != k else k for k in new[self.key].tolist()]
        kept, missed, by, last, at = self.read(), [], [], -1, None
        for i, (code, us) in enumerate(zip(new["_key"].tolist(), new["event_us"].tolist())):
            if code != last:
                last, at, own = code, kept[keys[i]][0] if keys[i] in kept else None, -1
            if at is None or us - at >= 1000 * self.live_ms:
                at, own = us, len(missed)
                missed.append(i)
            by.append(own)
        results = [] if not missed else self.compute(new.drop(columns="_key").iloc[missed]).tolist()  # only what no stored result answers
        sources = new[self.row_id].iloc[missed].tolist()
        old = [(None, None, None) if b >= 0 else kept[k] for k, b in zip(keys, by)]
        hit = [True] * len(new)
        for n, i in enumerate(missed):
            hit[i] = False
        yield pd.DataFrame({
            self.row_id: new[self.row_id], self.key: keys, "result": [results[b] if b >= 0 else o[2] for b, o in zip(by, old)],
            "hit": hit, "source": [sources[b] if b >= 0 else o[1] for b, o in zip(by, old)]})
        if missed:
            us = new["event_us"].iloc[missed].tolist()
            self.write(kept | {keys[i]: [us[n], sources[n], results[n]] for n, i in enumerate(missed)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.write({k: v for k, v in self.read().items() if v[0] // 1000 + self.live_ms >= now})
        return iter(())

    def close(self) -> None:
        pass


def result_cache(df: DataFrame, compute: Callable[[pd.DataFrame], pd.Series], kind: str = "double", key: str = "text_hash", row_id: str = "event_id",
                 live_ms: int = 3_600_000, late: str = "1 hour", ts: str = "ts", shares: int = 512) -> DataFrame:
    """Every row of a stream with the result of its key: row_id, key, result, hit (it was stored already) and source (the row it was computed from).

    ``compute`` gets the rows that need a result, as a pandas frame, and returns as many results of SQL type ``kind``.  A result answers the rows of its key
    whose time is less than ``live_ms`` after its own.  Rows later than ``late`` behind the watermark are dropped by the stream.
    Keys are dealt into ``shares``; a task holds the living results of one share at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    timed = with_rocksdb(df).withColumn("event_us", F.unix_micros(ts)).withWatermark(ts, late)
    return timed.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares))).groupBy("_share").transformWithStateInPandas(
        statefulProcessor=KeptResult(key, row_id, compute, (kinds[key], kinds[row_id], kind), live_ms),
        outputStructType=f"{row_id} {kinds[row_id]}, {key} {kinds[key]}, result {kind}, hit boolean, source {kinds[row_id]}", outputMode="Append", timeMode="EventTime")


class OpenAlerts(StatefulProcessor):
    """The open alerts of a share of the samples, given out when raised and taken back when their time is over.

    One timer waits for the earliest of them; when it fires, all that the watermark has passed are taken back and the next one is set.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "session_id bigint, content_id bigint, type string, value double, us bigint")

    def end(self, alert) -> int:
        return alert[4] // 1000 + self.keep_ms

    def told(self, alerts, change):
        return pd.DataFrame([(*a, change) for a in alerts], columns=["session_id", "content_id", "type", "value", "us", "change"])

    def handleInputRows(self, key, rows, timerValues):
        for new in rows:
            raised = list(zip(*[new[c].tolist() for c in ("session_id", "content_id", "type", "value", "event_us")]))
            self.open.appendList(raised)
            first = min(map(self.end, raised))
            if first < min(self.handle.listTimers(), default=first + 1):
                self.handle.registerTimer(first)
            yield self.told(raised, "raised")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        alerts = [tuple(a) for a in self.open.get()]
        left = [a for a in alerts if self.end(a) >= now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(map(self.end, left)))
        else:
            self.open.clear()
        yield self.told([a for a in alerts if self.end(a) < now], "retracted")

    def close(self) -> None:
        pass


def alert_retention(alerts: DataFrame, keep_ms: int = 3_600_000, late: str = "0 seconds", shares: int = 256) -> DataFrame:
    """A stream of alerts (session_id, content_id, ts, type, value) as changes: each is raised at once and retracted ``keep_ms`` after its time.

    The state holds the open alerts only.  Samples are dealt into ``shares``, whatever their sessions, so a batch costs a call for each share.
    """
    share = F.pmod(F.xxhash64("content_id"), F.lit(shares)).alias("share")
    timed = with_rocksdb(alerts).select("session_id", share, "content_id", "type", "value", "ts", F.unix_micros("ts").alias("event_us")).withWatermark("ts", late)
    return timed.groupBy("share").transformWithStateInPandas(
        statefulProcessor=OpenAlerts(keep_ms), outputStructType="session_id bigint, content_id bigint, type string, value double, us bigint, change string",
        outputMode="Append", timeMode="EventTime")
