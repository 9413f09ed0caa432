"""Sessions with state: they end by command at once, by a timer when they are idle, and open ones can be asked for."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Commands that end a session, and why it ended then.
ENDS = {"end": "ended", "cancel": "cancelled"}
CLOSED = "uid string, started timestamp, last_seen timestamp, n_requests bigint, reason string"
_OPEN = "started bigint, last_seen bigint, n_requests bigint"
#: Keeps the state of streams; needed for timers and for reading the state.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Sessions(StatefulProcessor):
    """One open session a user: its first and last request in microseconds, how many there were, and a timer from the last one on."""

    def __init__(self, gap: int, ends: dict[str, str]) -> None:
        self.gap, self.ends = gap, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _OPEN)

    def _closed(self, key: tuple, open_: tuple, reason: str) -> tuple:
        return (key[0], pd.Timestamp(open_[0], unit="us"), pd.Timestamp(open_[1], unit="us"), open_[2], reason)

    def _timer(self, last: int) -> int:
        """The first millisecond at which a session has been idle for longer than the gap."""
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        before = self.session.get() if self.session.exists() else None
        open_, out = before, []
        for at, command in zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["command"].tolist(), strict=True):
            if open_ and at - open_[1] > self.gap:
                out.append(self._closed(key, open_, "idle"))
                open_ = None
            open_ = (min(open_[0], at), max(open_[1], at), open_[2] + 1) if open_ else (at, at, 1)
            if command in self.ends:
                out.append(self._closed(key, open_, self.ends[command]))
                open_ = None
        if before:
            self.handle.deleteTimer(self._timer(before[1]))
        if open_:
            self.session.update(open_)
            self.handle.registerTimer(self._timer(open_[1]))
        elif before:
            self.session.clear()
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        if self.session.exists():
            open_ = self.session.get()
            if self._timer(open_[1]) <= expiredTimerInfo.getExpiryTimeInMs():
                out.append(self._closed(key, open_, "idle"))
                self.session.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["uid", "started", "last_seen", "n_requests", "reason"]).astype({"started": "datetime64[us]", "last_seen": "datetime64[us]", "n_requests": "int64"})


def closed_sessions(requests: DataFrame, gap_s: int = 1800, late: str = "1 hour", ends: dict[str, str] | None = None) -> DataFrame:
    """A stream of sessions as they end: by one of the commands of `ends` in the batch that brings it, or by being idle for longer than the gap.

    requests is a stream of uid, command, ts. A request that comes after others of its user, but before the watermark, counts to the session that is open
    then; later ones are dropped by the watermark. State is one small row a user with an open session. Set STORE in the session.
    """
    known = requests.select(F.col("uid").cast("string").alias("uid"), "command", "ts").where("uid IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return known.groupBy("uid").transformWithStateInPandas(_Sessions(gap_s * 1_000_000, ends or ENDS), CLOSED, outputMode="Append", timeMode="EventTime")


def open_sessions(spark: SparkSession, checkpoint: str, now: datetime | None = None) -> DataFrame:
    """Uid, started, last_seen, n_requests, idle_s of the sessions that a stream with this checkpoint holds open, as of its last batch.

    Read from the stream's state, while it runs or after; idle seconds are counted up to `now`, or the current time.
    """
    state = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    until = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    rows = state.select(F.col("key.uid").alias("uid"), F.timestamp_micros("value.started").alias("started"), F.timestamp_micros("value.last_seen").alias("last_seen"), "value.n_requests")
    return rows.withColumn("idle_s", F.unix_seconds(until) - F.unix_seconds("last_seen"))


def sessions_of(requests: DataFrame, gap_s: int = 1800, ends: dict[str, str] | None = None, until: datetime | None = None) -> DataFrame:
    """The same sessions of a table: reason is null for those that are open at `until`, or at the last request there is.

    A user's requests are ordered in one task, as a user has a bounded number; nothing else is.
    """
    ends = ends or ENDS
    why = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    known = requests.select(F.col("uid").cast("string").alias("uid"), "command", "ts", "event_id").where("uid IS NOT NULL AND ts IS NOT NULL")
    micros = F.unix_micros("ts")
    new = F.coalesce((micros - F.lag(micros).over(w) > gap_s * 1_000_000) | F.lag("command").over(w).isin(list(ends)), F.lit(True))
    marked = known.withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = marked.groupBy("uid", "k").agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("n_requests"), F.max_by("command", F.struct("ts", "event_id")).alias("last"))
    last = F.lit(until).cast("timestamp") if until else requests.agg(F.max("ts")).scalar()
    idle = F.unix_micros(last) - F.unix_micros("last_seen") > gap_s * 1_000_000
    return each.select("uid", "started", "last_seen", "n_requests", F.coalesce(F.try_element_at(why, F.col("last")), F.when(idle, "idle")).alias("reason"))
