"""Feeds as streams: latest state, append-only and change-only histories, windows, alerts; all also run on batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def read_feed(spark, path: str, schema: str, **options: str) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def windowed(events: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = (), *aggs: Column) -> DataFrame:
    """Counts (or ``aggs``) by event-time window; rows later than ``late`` are dropped by the watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(*(aggs or (F.count("*").alias("n"),))).select("window.start", "window.end", "*").drop("window")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("window")).agg(F.count("*").alias("n")).select(key, "window.start", "window.end", "n")


def append_once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows with a known time, the first of each key within the watermark."""
    return events.where(F.col(ts).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _plain(fields: Iterable) -> tuple:
    """A row's fields as they can be compared and stored: NULL is None, whatever pandas makes of it."""
    return tuple(None if pd.api.types.is_scalar(x) and pd.isna(x) else x.item() if isinstance(x, np.generic) else x for x in fields)


class ChangeOnly(StatefulProcessor):
    """Passes a key's row on when its fields differ from those of the last row passed on."""

    def __init__(self, fields: list[str], order: str, state_schema: str) -> None:
        self.fields, self.order, self.state_schema = fields, order, state_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last, kept = (_plain(self.last.get()) if self.last.exists() else None), []
        for i, now in enumerate(map(_plain, frame[self.fields].itertuples(index=False, name=None))):
            if now != last:
                kept.append(i)
                last = now
        if last is not None:
            self.last.update(last)
        yield frame.iloc[kept]

    def close(self) -> None:
        pass


def change_only(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The stream's rows whose fields changed, by key, in arrival batches ordered by ``order``."""
    state = ", ".join(f"{f} {events.schema[f].dataType.simpleString()}" for f in fields)
    return events.groupBy(key).transformWithStateInPandas(ChangeOnly(fields, order, state), outputStructType=events.schema, outputMode="Append", timeMode="None")


def freshness(feeds: DataFrame, now: Column, slack: float = 1.5) -> DataFrame:
    """Adds stale: never fetched, or older than ``slack`` times the feed's interval in minutes."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 60.0
    return feeds.withColumn("stale", F.col("fetched_at").isNull() | (age > slack * F.col("interval_minutes")))


def stale_alerts(feeds: DataFrame, now: Column, slack: float = 1.5) -> DataFrame:
    """The stale feeds that there is an alert for: one that was never fetched is not set up yet."""
    return freshness(feeds, now, slack).where(F.col("stale") & F.col("fetched_at").isNotNull())


def alert_dedup(alerts: DataFrame, keys: list[str], ts: str, hours: int = 24) -> DataFrame:
    """Adds sent: no alert of the key was logged within ``hours`` before; every alert is logged, so the quiet slides."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(ts).over(w)
    return alerts.withColumn("sent", before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > hours * 3_600_000_000))


class Quiet(StatefulProcessor):
    """Adds ``sent`` to alerts of a key; what is kept of a key is its last alert, until the quiet period after it is over."""

    def __init__(self, ts: str, hours: int) -> None:
        self.ts, self.millis = ts, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        last, sent = (self.last.get()[0] if self.last.exists() else None), []
        for now in frame[self.ts].astype("datetime64[us]").astype("int64").tolist():
            sent.append(last is None or now - last > self.millis * 1000)
            last = now if last is None else max(last, now)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.millis + 1)
        yield frame.assign(sent=sent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def quiet_alerts(alerts: DataFrame, keys: list[str], ts: str, hours: int = 24, late: str = "0 seconds") -> DataFrame:
    """``alert_dedup`` of a stream whose alerts come in order of ``ts``, or at most ``late``.

    A key's state goes when the watermark has passed the end of its quiet period, so state grows with the keys that have
    lately alerted, not with all there ever were.
    """
    out = T.StructType([*alerts.schema, T.StructField("sent", T.BooleanType())])
    return alerts.withWatermark(ts, late).groupBy(*keys).transformWithStateInPandas(Quiet(ts, hours), outputStructType=out, outputMode="Append", timeMode="EventTime")


def change_stream(branches: dict[str, DataFrame], most: int = 12) -> DataFrame:
    """kind, at and detail of the newest changes of all branches (at, detail); rows without a time come last."""
    out = None
    for kind, df in branches.items():
        one = df.select(F.lit(kind).alias("kind"), F.col("at"), F.col("detail"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("at").desc_nulls_last(), "kind", "detail").limit(most)
