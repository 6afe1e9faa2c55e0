"""Incremental runs: new sorties as micro-batches, live transitions, and gaps as session windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.names import signal_matches
from ..sources.generations import read_generations, write_generation


def run_incremental(spark: SparkSession, root: str, schema: str, checkpoint: str, out: str, analyse: Callable[[DataFrame], DataFrame]) -> None:
    """Analyse the sorties that files new since the last run touch, and write what takes the place of their results (SNK-6, STR-1).

    A touched sortie is analysed whole, from all its files, so a later file adds to it and takes nothing away. analyse gets
    (df) with the rows of whole sorties and keeps the column sortie. Each micro-batch writes its rows and the list of its
    sorties under its own number; a batch that is repeated overwrites just these. read_incremental takes each sortie's rows
    from the last batch that touched it, so a sortie whose new analysis is empty has none.
    """

    def batch(df: DataFrame, number: int) -> None:
        touched = df.select("sortie").distinct()
        whole = spark.read.schema(schema).parquet(root).join(touched, "sortie", "left_semi")
        write_generation(analyse(whole), touched, out, number, ["sortie"])

    stream = spark.readStream.schema(schema).parquet(root)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_incremental(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows that run_incremental's results now consist of, as schema has them (it includes sortie)."""
    return read_generations(spark, out, schema, ["sortie"])


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of sorties whose last entry in the manifest is not ok, or that have none. Of entries of one run any ok counts."""
    run = F.col("run") if "run" in manifest.columns else F.lit(0)
    last = manifest.groupBy("sortie").agg(F.max(F.struct(run.alias("run"), (F.col("status") == "ok").alias("ok"))).alias("x"))
    return files.join(last.where("x.ok").select("sortie"), "sortie", "left_anti")


class _Changes(StatefulProcessor):
    """The last row of one signal, and the timer that ends its state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, v double, idle_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        us, v, idle = self.last.get() or (None, None, None)
        every = pd.concat(list(rows)).sort_values("ts", kind="stable")
        times, told = every["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), []
        for at, ts, value in zip(times, every["ts"], every["v"].tolist(), strict=True):
            if value is None or not math.isfinite(value) or us is not None and at <= us:
                continue
            if v is not None and value != v:
                told.append((*key, ts, v, value))
            us, v = at, value
        if us is not None:
            until = max(_up_to_ms(us), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
            if idle is not None:
                self.handle.deleteTimer(idle)
            self.handle.registerTimer(until)
            self.last.update((us, v, until))
        if told:
            yield pd.DataFrame(told, columns=["sortie", "signal", "ts", "from_v", "to_v"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.last.clear()
        return iter(())


def live_transitions(samples: DataFrame, delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """Changes of each signal in a stream of (sortie, signal, ts, v) (STR-2).

    Rows behind the watermark or not later than the last one of their signal are passed over, as are values that are null or
    not finite, so a change is told once and in order. A signal's state ends when event time has gone idle_ms beyond its
    last row, whatever late rows still come. Needs the RocksDB state store.
    """
    timed = samples.select("sortie", "signal", "ts", "v").withWatermark("ts", delay)
    return timed.groupBy("sortie", "signal").transformWithStateInPandas(_Changes(idle_ms), "sortie string, signal string, ts timestamp, from_v double, to_v double", "Append", "EventTime")


class _Episodes(StatefulProcessor):
    """The trigger's state of one sortie: rows not final yet, last values by signal, and the episode that is open."""

    def __init__(self, from_v: float, to_v: float, tail_us: int, idle_ms: int):
        self.from_v, self.to_v, self.tail_us, self.idle_ms = from_v, to_v, tail_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, ord long, signal string", "v double")
        self.values = handle.getMapState("values", "signal string", "v double")
        self.state = handle.getValueState("state", "episode int, signal string, start_us long, end_us long")
        self.timers = handle.getValueState("timers", "due_ms long, idle_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        first = last = None
        for pdf in rows:
            us = pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            for u, o, signal, v in zip(us.tolist(), pdf["ord"].tolist(), pdf["signal"], pdf["v"].tolist(), strict=True):
                if v is not None and math.isfinite(v):
                    self.waiting.updateValue((u, o, signal), (v,))
                    first, last = min(u, first or u), max(u, last or u)
        if first is not None:
            due, idle = self.timers.get() or (None, None)
            self._set(_up_to_ms(first) if due is None else min(due, _up_to_ms(first)), max(idle or 0, _up_to_ms(last) + self.idle_ms))
        return iter(())

    def _set(self, due: int | None, idle: int) -> None:
        """One timer for the first row that waits, one for the end of the state."""
        for old, new in zip(self.timers.get() or (None, None), (due, idle), strict=True):
            if old != new:
                if old is not None:
                    self.handle.deleteTimer(old)
                if new is not None:
                    self.handle.registerTimer(new)
        self.timers.update((due, idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        number, signal, start, end = self.state.get() or (0, None, None, None)
        now, told, left = timerValues.getCurrentWatermarkInMs() * 1000, [], None
        waiting = sorted(self.waiting.keys())
        for us, order, name in waiting:
            if us > now:
                left = us
                break
            v = self.waiting.getValue((us, order, name))[0]
            self.waiting.removeKey((us, order, name))
            before = self.values.getValue((name,))
            self.values.updateValue((name,), (v,))
            edge = None if before is None else (before[0], v)
            if start is None and edge == (self.from_v, self.to_v) and (end is None or us - end > self.tail_us):
                number, signal, start = number + 1, name, us
                told.append((number, signal, start, None, "open"))
            elif start is not None and name == signal and edge == (self.to_v, self.from_v):
                told.append((number, signal, start, us, "closed"))
                start, end = None, us
        due, idle = self.timers.get()
        if left is None and expiredTimerInfo.getExpiryTimeInMs() == idle:
            # Nothing came for so long; an episode that is open stays without an end.
            for part in (self.waiting, self.values, self.state, self.timers):
                part.clear()
        else:
            self.state.update((number, signal, start, end))
            self._set(None if left is None else _up_to_ms(left), idle)
        if told:
            stamp = lambda x: pd.to_datetime(pd.Series(x, dtype="Int64"), unit="us")
            n, signals, starts, ends, status = zip(*told, strict=True)
            yield pd.DataFrame({"sortie": key[0], "episode": n, "trigger_signal": signals, "start_ts": stamp(starts), "end_ts": stamp(ends), "status": status})


def _up_to_ms(us: int) -> int:
    """The first millisecond not before a time."""
    return -(-us // 1000)


def live_episodes(samples: DataFrame, signal: str, from_v: float = 1.0, to_v: float = 0.0, tail: float = 3.0, delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """Episodes of a stream of (sortie, signal, ts, v, ord): a row when one opens and one when it closes (STR-2).

    (sortie, episode, trigger_signal, start_ts, end_ts, status). The rules are those of extract_episodes, so what is told
    last of each episode equals its result on the same rows, in whatever order these come within the delay. Rows wait in the
    sortie's state until the watermark has passed them and are then taken in (ts, ord, signal); later ones are dropped by
    Spark. Values that are null or not finite are passed over; of rows with equal ts, ord and signal the last that came
    counts. A sortie's state ends when event time has gone idle_ms beyond its last row, whatever late rows still come; an
    episode that is open then stays without an end, and a sortie that goes on later counts anew.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    mine = samples.where(signal_matches(F.col("signal"), signal)).select("sortie", "signal", "ts", "v", "ord").withWatermark("ts", delay)
    form = "sortie string, episode int, trigger_signal string, start_ts timestamp, end_ts timestamp, status string"
    return mine.groupBy("sortie").transformWithStateInPandas(_Episodes(from_v, to_v, round(tail * 1e6), idle_ms), form, "Append", "EventTime")


def live_sessions(samples: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Stretches of a sortie's stream without a gap (STR-3)."""
    return samples.withWatermark("ts", delay).groupBy("sortie", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
