"""Streams with event time: windows, deduplication, interval joins and state kept by key.

Each function takes a streaming DataFrame (a batch one works too, where Spark has the same operator)
and returns one; the caller picks sink, trigger and checkpoint folder, which must be shared.
Event times without a zone are read as UTC, since watermarks need zoned ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(events: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """events with a zoned event time and a watermark. The session's time zone must be UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(events: DataFrame, width: str, by: list[str], measures: dict[str, Column], at: str = "ts", slide: str | None = None) -> DataFrame:
    """Measures of each window and key; with slide, windows overlap."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    grouped = events.groupBy(window.alias("_window"), *by).agg(*(c.alias(n) for n, c in measures.items()))
    return grouped.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *by, *measures)


def rolled_up(windowed: DataFrame, width: str, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures of wider windows over rows of narrower ones, a second stateful operator on the same stream: a row of
    hourly windows counts for the day that its hour ends in. The rows come from narrow_windows()."""
    window = F.window(F.window_time("window"), width)
    grouped = windowed.groupBy(window.alias("_window"), *by).agg(*(c.alias(n) for n, c in measures.items()))
    return grouped.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *by, *measures)


def narrow_windows(events: DataFrame, width: str, by: list[str], measures: dict[str, Column], at: str = "ts") -> DataFrame:
    """Measures of each window and key, with the window itself, so that rolled_up() can follow."""
    return events.groupBy(F.window(at, width).alias("window"), *by).agg(*(c.alias(n) for n, c in measures.items()))


def sessions(events: DataFrame, gap: str, by: list[str], measures: dict[str, Column], at: str = "ts") -> DataFrame:
    """Measures of each key's sessions: runs of events less than gap apart."""
    grouped = events.groupBy(F.session_window(at, gap).alias("_window"), *by).agg(*(c.alias(n) for n, c in measures.items()))
    return grouped.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *by, *measures)


def first_of_each(events: DataFrame, by: list[str]) -> DataFrame:
    """Events without those whose key came before within the watermark; state is bounded by it."""
    return events.dropDuplicatesWithinWatermark(by)


def within(left: DataFrame, right: DataFrame, on: Column, left_at: str, right_at: str, width: str, how: str = "inner") -> DataFrame:
    """Pairs where the right event is at or after the left one and less than width later. Both sides
    need watermarks, so that state is dropped. how: inner, left_semi (left events that have one, once), or left, right,
    full, where an event without partner comes once the watermark rules one out."""
    later = (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) < F.col(left_at) + F.expr(f"INTERVAL {width}"))
    return left.join(right, on & later, how)


class _Totals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, total = self._state.get() if self._state.exists() else (0, 0.0)
        for batch in rows:
            n += len(batch)
            total += float(batch["value"].sum())
        self._state.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """After each batch, the count and sum so far of every key that came in it. Needs the RocksDB
    state store."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Totals(), outputStructType=f"key {kind}, n long, total double", outputMode="Update", timeMode="None"
    )


class _Sessions(StatefulProcessor):
    """Open sessions of a group of keys, as columns of one value; a timer at the first of their ends closes those that the
    watermark has passed. A call reads and writes the value once, however many keys have events."""

    def __init__(self, gap_ms: int, kind: str) -> None:
        self._gap, self._kind = gap_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", f"key array<{self._kind}>, start_us array<long>, last_us array<long>, n array<long>, most array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = self._due(held)
        for batch in rows:
            events = {"key": batch["key"], "start_us": batch["at_us"], "last_us": batch["at_us"], "n": 1, "most": batch["value"].astype("float64")}
            held = self._joined(pd.concat([held, pd.DataFrame(events)], ignore_index=True) if held is not None else pd.DataFrame(events))
        self._keep(held, due)
        yield from ()

    def _joined(self, pieces: pd.DataFrame) -> pd.DataFrame:
        """Pieces of a key that are less than a gap apart are one."""
        pieces = pieces.assign(code=pd.factorize(pieces["key"])[0]).sort_values(["code", "start_us"])
        code, start = pieces["code"].to_numpy(), pieces["start_us"].to_numpy()
        so_far = pieces.groupby("code")["last_us"].cummax().to_numpy()
        at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] - so_far[:-1] >= self._gap * 1000)])
        # fmax passes over what is no number, as nulls are here.
        found = {"last_us": np.maximum.reduceat(pieces["last_us"].to_numpy(), at), "n": np.add.reduceat(pieces["n"].to_numpy(), at), "most": np.fmax.reduceat(pieces["most"].to_numpy(), at)}
        return pieces.iloc[at][["key", "start_us"]].assign(**found).reset_index(drop=True)

    def _held(self) -> pd.DataFrame | None:
        if not self._open.exists():
            return None
        return pd.DataFrame({n: pd.Series(list(c)) for n, c in zip(("key", "start_us", "last_us", "n", "most"), self._open.get(), strict=True)})

    def _ends(self, held: pd.DataFrame) -> np.ndarray:
        """In milliseconds, rounded up."""
        return -(-held["last_us"].to_numpy() // 1000) + self._gap

    def _due(self, held: pd.DataFrame | None) -> int | None:
        return None if held is None else int(self._ends(held).min())

    def _keep(self, held: pd.DataFrame, timer: int | None) -> None:
        """Stores open sessions with a timer for the first; timer is the one that is set."""
        due = self._due(held) if len(held) else None
        if timer is not None and timer != due:
            self._handle.deleteTimer(timer)
        if due is None:
            self._open.clear()
            return
        keys = [None if pd.isna(k) else k for k in held["key"].tolist()]
        self._open.update((keys, *(held[c].tolist() for c in ("start_us", "last_us", "n", "most"))))
        if timer != due:
            self._handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is None:
            return
        over = self._ends(held) <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if over.any():
            # Spark drops the timer that has expired.
            self._keep(held[~over], None)
            yield held[over].reset_index(drop=True)

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, gap_seconds: int, key: str, value: str, at: str = "ts", groups: int = 256) -> DataFrame:
    """key, start, last, n and most (of value) of each session, when the watermark passes its last event by the gap. Events
    in a batch may come in any order. State holds open sessions only, of each of so many groups of keys as one value with
    one timer of event time, since a call for each key costs milliseconds; groups can't change once a checkpoint
    is there. Events without a time are in no session. Needs the RocksDB state store and a watermark on at."""
    kind = events.schema[key].dataType.simpleString()
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    timed_ = events.filter(F.col(at).isNotNull())
    rows = timed_.select(group.cast("int").alias("group"), F.col(key).alias("key"), F.unix_micros(at).alias("at_us"), F.col(value).cast("double").alias("value"), F.col(at).alias("_at"))
    closed = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_Sessions(gap_seconds * 1000, kind), outputStructType=f"key {kind}, start_us long, last_us long, n long, most double", outputMode="Append", timeMode="EventTime"
    )
    return closed.select("key", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("last_us").alias("last"), "n", "most")
