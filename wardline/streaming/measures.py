"""Ledgers, retention and session weight on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from wardline.functions.text import iso_week_id
from wardline.operators.activity import append_ledger, weight_band
from wardline.session import delete_folder, spread

DAY_MS = 24 * 3600 * 1000
COMPACT = 16
#: Before all times, in microseconds.
NEVER = -(1 << 61)
WAITING = "key string, at long, mark boolean, commits long, lines double"
TOTALS = "key string, at long, saved_at long, commits long, lines double"


def ledger_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append ledger rows once per (repo, measurement day, traffic day), also when a batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_ledger(batch, path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Retention(StatefulProcessor):
    """The first and the last week of a key; forgotten after a silence."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weeks = handle.getValueState("weeks", "first string, last string, seen_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.weeks.get() if self.weeks.exists() else None
        first, last, seen = before or (None, None, 0)
        for pdf in rows:
            low, high = pdf["week"].min(), pdf["week"].max()
            first, last = min(first or low, low), max(last or high, high)
            seen = max(seen, int(pdf["ts_ms"].max()))
        if before is None or seen != before[2]:
            self.handle.registerTimer(seen + self.silence_ms)
        self.weeks.update((first, last, seen))
        if before is None or (first, last) != tuple(before[:2]):
            yield pd.DataFrame({"key": [str(key[0])], "first_week": [first], "last_week": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.weeks.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.weeks.get()[2] + self.silence_ms:
            self.weeks.clear()
        yield from ()

    def close(self) -> None:
        pass


def retention_stream(stamps: DataFrame, key: str, lateness: str = "7 days", silence_days: int = 3660) -> DataFrame:
    """Install or retained per key from ``(<key>, ts)``, from the first and the last ISO week seen, in any order of arrival.

    A row is given whenever a key's weeks change; its state goes after ``silence_days`` without a stamp.
    """
    weeks = stamps.select(key, "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), iso_week_id(F.col("ts")).alias("week")).withWatermark("ts", lateness).groupBy(key)
    found = weeks.transformWithStateInPandas(
        Retention(silence_days * DAY_MS), outputStructType="key string, first_week string, last_week string", outputMode="Update", timeMode="EventTime"
    )
    return found.withColumn("kind", F.when(F.col("first_week") == F.col("last_week"), "install").otherwise("retained"))


class SessionWeight(StatefulProcessor):
    """Work since the last save-point of a key; a save-point resets it.

    Activity waits in a list until the watermark says that nothing earlier can come. A key has one timer at a
    time, for the first of what waits; when it falls due, all that the watermark has passed is folded in order of time at once.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "saved_us long, at_us long, commits long, lines double")
        self.waiting = handle.getListState("waiting", "at_us long, mark boolean, commits long, lines double")
        self.timer = handle.getValueState("timer", "at_ms long")

    def _wake(self, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = [r for pdf in rows for r in zip(*(pdf[c].tolist() for c in ("at_us", "is_savepoint", "commits", "lines")), strict=True)]
        self.waiting.appendList(come)
        first = -(-min(r[0] for r in come) // 1000)
        # a later timer that stays behind is told by its time, see below
        if not self.timer.exists() or first < self.timer.get()[0]:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.timer.exists() or expiredTimerInfo.getExpiryTimeInMs() != self.timer.get()[0]:
            return
        now_us = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        saved, last, commits, lines = self.totals.get() if self.totals.exists() else (None, None, 0, 0.0)
        held: dict[int, tuple] = {}
        for at, mark, more_commits, more_lines in self.waiting.get() if self.waiting.exists() else ():
            before = held.get(at, (False, 0, 0.0))
            held[at] = (mark or before[0], more_commits + before[1], more_lines + before[2])
        due = sorted(at for at in held if at <= now_us)
        for at in due:
            mark, more_commits, more_lines = held.pop(at)
            last = at
            if mark:
                saved, commits, lines = at, 0, 0.0
            elif saved is not None:
                commits, lines = commits + more_commits, lines + more_lines
        if due:
            self.totals.update((saved, last, commits, lines))
            if held:
                self.waiting.put([(at, *held[at]) for at in sorted(held)])
            else:
                self.waiting.clear()
        if held:
            self._wake(-(-min(held) // 1000))
        elif due or last is not None and now_us < last + self.silence_ms * 1000:
            self._wake(last // 1000 + 1 + self.silence_ms)
        else:
            self.totals.clear()
            self.timer.clear()
        if due and saved is not None:
            yield pd.DataFrame({"key": [str(key[0])], "at": [last], "saved_at": [saved], "commits": [commits], "lines": [lines]})

    def close(self) -> None:
        pass


def session_weight_stream(activity: DataFrame, key: str, lateness: str = "1 day", silence_days: int = 3660) -> DataFrame:
    """Totals since the last save-point from ``(<key>, ts, commits, lines, is_savepoint)``, in any order of arrival within ``lateness``.

    A row ``key, at, saved_at, commits, lines`` is given whenever activity is folded; the one with the greatest ``at`` is a key's newest.
    Work at the very time of a save-point belongs to it. State goes after ``silence_days`` without activity. Each key takes some calls
    of Python in each batch; where keys are many and no stream operator follows, ``session_weight_batches`` does the same by joins.
    """
    timed = activity.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", lateness)
    folded = timed.groupBy(key).transformWithStateInPandas(
        SessionWeight(silence_days * DAY_MS), outputStructType="key string, at long, saved_at long, commits long, lines double", outputMode="Append", timeMode="EventTime"
    )
    return folded.withColumns({c: F.timestamp_micros(c) for c in ("at", "saved_at")})


class WeightStates:
    """What a stream of activity leaves in a shared folder: rows, totals and the latest time, one folder for each batch.

    A replayed batch overwrites its folders. Every ``COMPACT`` batches the rows that wait and the newest totals are written as one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str, batch: int, kind: str = "batch") -> str:
        return f"{self.folder}/{name}/{kind}={batch}"

    def write(self, name: str, batch: int, rows: DataFrame, kind: str = "batch") -> None:
        rows.write.mode("overwrite").parquet(self.path(name, batch, kind))

    def _since(self, name: str, schema: str, batch: int, base: int) -> DataFrame:
        """The last compaction before this batch and the batches since; this one's too, where it has been written."""
        paths = [self.path(name, base, "all")] if base else [self.path(name, 0)]
        return self.spark.read.schema(schema).parquet(*paths, *(self.path(name, b) for b in range(base + 1, batch)))

    def waiting(self, batch: int, after: int) -> DataFrame:
        """The rows after a time that came up to this batch."""
        return self._since("rows", WAITING, batch + 1, max(batch - 1, 0) // COMPACT * COMPACT).where(F.col("at") > after)

    def totals(self, batch: int, after: int) -> DataFrame:
        """The totals before this batch of the keys that were active after a time."""
        if not batch:
            return self.spark.createDataFrame([], TOTALS)
        return _newest(self._since("totals", TOTALS, batch, (batch - 1) // COMPACT * COMPACT)).where(F.col("at") > after)

    def clock(self, batch: int) -> int | None:
        """The latest time that came up to this batch."""
        return self.spark.read.schema("at long").parquet(self.path("clock", batch)).first()["at"] if batch >= 0 else None

    def compact(self, batch: int, folded: int, active: int) -> None:
        self.write("rows", batch, self.waiting(batch, folded), "all")
        kept = _newest(self._since("totals", TOTALS, batch + 1, batch - COMPACT)).where(F.col("at") > active)
        self.write("totals", batch, kept, "all")
        # a batch that is replayed needs the compaction before it
        for b in range(max(batch - 2 * COMPACT, 0), batch - COMPACT + 1):
            delete_folder(self.spark, self.path("rows", b))
        if batch > 2 * COMPACT:
            delete_folder(self.spark, self.path("rows", batch - 2 * COMPACT, "all"))


def _newest(totals: DataFrame) -> DataFrame:
    values = ["at", "saved_at", "commits", "lines"]
    return totals.groupBy("key").agg(F.max_by(F.struct(*values), "at").alias("t")).select("key", *(f"t.{c}" for c in values))


def session_weight_batches(activity: DataFrame, key: str, folder: str, checkpoint: str, lateness: str = "1 day", silence_days: int = 3660) -> DataStreamWriter:
    """``session_weight_stream`` by joins, micro-batch by micro-batch; ``newest_session_weight`` reads the totals from ``folder``.

    A batch folds what is older by ``lateness`` than the latest time that came, so nothing waits for a batch after the last one. Rows
    older than what was folded before are dropped, and rows without a time; missing numbers count as 0.
    """
    late = F.expr(f"unix_micros(timestamp_micros(0) + interval '{lateness}')")
    silence = silence_days * DAY_MS * 1000

    def step(rows: DataFrame, batch: int) -> None:
        states = WeightStates(rows.sparkSession, folder)
        lag = rows.sparkSession.range(1).select(late).first()[0]
        before = states.clock(batch - 1)
        done = NEVER if before is None else before - lag
        fresh = rows.select(
            F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("is_savepoint", F.lit(False)).alias("mark"),
            F.coalesce(F.col("commits").cast("long"), F.lit(0)).alias("commits"), F.coalesce(F.col("lines").cast("double"), F.lit(0.0)).alias("lines"),
        )
        # a batch may be one file, and so one task
        states.write("rows", batch, spread(fresh.where(F.col("at") > done), "key", "at"))
        came = rows.sparkSession.read.schema(WAITING).parquet(states.path("rows", batch)).agg(F.max("at")).first()[0]
        latest = max((t for t in (before, came) if t is not None), default=None)
        states.write("clock", batch, rows.sparkSession.range(1).select(F.lit(latest).cast("long").alias("at")))
        due = NEVER if latest is None else latest - lag

        held = states.totals(batch, done - silence)
        # totals are a save-point and, at the last time, the work since
        mark = F.struct(F.col("saved_at").alias("at"), F.lit(True).alias("mark"), F.lit(0).cast("long").alias("commits"), F.lit(0.0).alias("lines"))
        work = F.struct(F.col("at"), F.lit(False).alias("mark"), F.col("commits"), F.col("lines"))
        course = states.waiting(batch, done).where(F.col("at") <= due).withColumn("new", F.lit(True))
        course = course.unionByName(held.select("key", F.inline(F.array(mark, work))).withColumn("new", F.lit(False)))
        ends = course.groupBy("key").agg(F.max("at").alias("last"), F.max(F.when(F.col("mark"), F.col("at"))).alias("saved_at"), F.bool_or("new").alias("new"))
        ends = ends.where("new and saved_at is not null").select("key", "last", "saved_at")
        since = course.join(ends, "key").where(F.col("at") > F.col("saved_at")).groupBy("key").agg(F.sum("commits").alias("commits"), F.sum("lines").alias("lines"))
        none = (F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("lines", F.lit(0.0)).alias("lines"))
        states.write("totals", batch, ends.join(since, "key", "left").select("key", F.col("last").alias("at"), "saved_at", *none))
        if batch and batch % COMPACT == 0:
            states.compact(batch, due, due - silence)

    return activity.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def newest_session_weight(spark: SparkSession, folder: str) -> DataFrame:
    """``key, at, saved_at, commits, lines`` of each key's newest totals."""
    newest = _newest(spark.read.schema(TOTALS).parquet(f"{folder}/totals/batch=*"))
    return newest.withColumns({c: F.timestamp_micros(c) for c in ("at", "saved_at")})


def weigh(totals: DataFrame, now) -> DataFrame:
    hours = F.greatest((now.cast("timestamp").cast("double") - F.col("saved_at").cast("double")) / 3600, F.lit(0.0))
    weight = F.col("commits") + F.col("lines") / 60 + hours / 2
    return totals.withColumn("weight", weight).withColumn("band", weight_band(weight))
