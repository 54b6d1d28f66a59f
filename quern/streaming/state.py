"""Folds over a stream, by key and in event time: rate limits and rolling histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The state store that timers and lists need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(events: DataFrame, key: str, ts: str, tie: str, value: str | None, step, result: str, keep: float, late: str = "10 minutes") -> DataFrame:
    """(key, tie, t, *result): step(history, micros, value) -> (history, results) for each row, in the order of time.

    Rows come in any order. Each waits until the watermark has passed it and a
    timer settles it, so the rows are those of a fold over the sorted table
    whatever the micro-batches were; ties in time go by tie. What is behind the
    watermark on arrival is dropped, what is ahead of it at the end of the
    stream still waits. A history is a list of numbers; it begins empty, again
    so after keep seconds without a row, and a timer drops it then.

    State per key is its history and its rows between watermark and now: those
    of one micro-batch and the time allowed for lateness. Rows without a time
    or tie are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    kinds = dict(events.dtypes)
    schema = T._parse_datatype_string(f"key {kinds[key]}, tie {kinds[tie]}, t double, {result}")
    names = schema.names
    pause = int(keep * 1_000_000)
    tie_kind = kinds[tie]

    class Fold(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", f"t bigint, tie {tie_kind}, v double")
            self.history = handle.getListState("history", "v double")
            self.last = handle.getValueState("last", "t bigint")

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for frame in rows:
                got = [(int(t), i, None if pd.isna(v) else float(v)) for t, i, v in zip(frame["t"].tolist(), frame["tie"].tolist(), frame["v"].tolist())]
                if got:
                    self.waiting.appendList(got)
                    low = min(g[0] for g in got)
                    first = low if first is None else min(first, low)
            if first is not None:
                self.handle.registerTimer(first // 1000 + 1)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs()
            rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
            due = [r for r in rows if r[0] // 1000 < mark]
            history = [r[0] for r in self.history.get()] if self.history.exists() else []
            last = self.last.get()[0] if self.last.exists() else None
            out = []
            for t, tie, v in due:
                if last is not None and t - last > pause:
                    history = []
                history, results = step(history, t, v)
                last = t
                out.append((key[0], tie, t / 1e6, *results))
            rest = rows[len(due):]
            if due:
                self.last.update((last,))
                self.history.put([(float(x),) for x in history]) if history else self.history.clear()
                self.waiting.put(rest) if rest else self.waiting.clear()
                self.handle.registerTimer(rest[0][0] // 1000 + 1 if rest else (last + pause) // 1000 + 1)
            elif not rest and last is not None and (last + pause) // 1000 < mark:
                self.history.clear()
                self.last.clear()
            if out:
                yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*out))})

        def close(self):
            pass

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    when = F.col(ts).cast("timestamp")
    rows = events.withWatermark(ts, late).where(F.col(ts).isNotNull() & F.col(tie).isNotNull())
    rows = rows.select(F.col(ts), F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(when).alias("t"), v.alias("v"))
    return rows.groupBy("key").transformWithStateInPandas(Fold(), schema, "Append", "EventTime")


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, tie, t, passed, n): a row passes if fewer than limit rows of its key passed in the seconds before it."""
    span = int(seconds * 1_000_000)

    def step(history: list, t: int, value) -> tuple:
        history = [x for x in history if x > t - span]
        passed = len(history) < limit
        if passed:
            history.append(t)
        return history, (passed, len(history))

    return in_order(events, key, ts, tie, None, step, "passed boolean, n int", seconds, late)


def rolling_anomalies(events: DataFrame, key: str, ts: str, tie: str, value: str, window: int = 100, z: float = 3.0, least: int = 10, keep: float = 7 * 86400, late: str = "10 minutes") -> DataFrame:
    """(key, tie, t, n, score, severity): each value against the last window values of its key before it.

    score is the distance from their mean in deviations; null under least
    values or without deviation. severity is null up to z, then low, medium
    over 3.5, high over 4, critical over 5. A null value has no score and
    leaves the history alone.
    """
    import math

    def step(history: list, t: int, v) -> tuple:
        n, score, severity = len(history), None, None
        if v is None:
            return history, (n, None, None)
        if n >= least:
            mean = math.fsum(history) / n
            deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in history) / n)
            score = abs(v - mean) / deviation if deviation > 0 else None
        if score is not None and score > z:
            severity = "critical" if score > 5 else "high" if score > 4 else "medium" if score > 3.5 else "low"
        return (history + [v])[-window:], (n, score, severity)

    return in_order(events, key, ts, tie, value, step, "n int, score double, severity string", keep, late)
