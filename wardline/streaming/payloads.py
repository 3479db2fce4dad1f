"""Whole payloads from a stream of chunks that arrive in any order, with a byte cap and two deadlines.

Chunks wait by their number until all before them are there. A payload that overruns is INCOMPLETE and is never scanned. State per
payload is bounded by the byte cap and the chunks that wait, and a timer removes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.functions import fixed_values as V

OUTPUT = "payload_id string, content binary, bytes long, truncated boolean, reason string"


class AssemblePayload(StatefulProcessor):
    def __init__(self, max_bytes: int, idle_ms: int, total_ms: int, first_seq: int):
        self.max_bytes, self.idle_ms, self.total_ms, self.first_seq = max_bytes, idle_ms, total_ms, first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "first_ms long, last_ms long, next_seq long, bytes long, waiting long, done boolean")
        self.waiting = handle.getMapState("waiting", "seq long", "data binary, ts_ms long, is_end boolean")
        self.chunks = handle.getListState("chunks", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, at, size, held, done = self.progress.get() if self.progress.exists() else (None, None, self.first_seq, 0, 0, False)
        for pdf in rows:
            if done:
                break
            for row in pdf.itertuples(index=False):
                now, seq = int(row.ts_ms), int(row.seq)
                if first is None or now < first:
                    first = now
                    self.handle.registerTimer(first + self.total_ms)
                if seq < at or (held and self.waiting.containsKey((seq,))):
                    continue  # a chunk that came before
                data = bytes(row.data) if row.data is not None else b""
                # what cannot fit any more need not be held whole
                self.waiting.updateValue((seq,), (data[: self.max_bytes + 1], now, bool(row.is_end)))
                held += 1
            while not done and held and self.waiting.containsKey((at,)):
                data, now, is_end = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
                held -= 1
                why = "total" if now - first > self.total_ms else "idle" if last is not None and now - last > self.idle_ms else None
                if why is None:
                    if len(data) > self.max_bytes - size:
                        why, data = "max-bytes", data[: self.max_bytes - size]
                    if data:
                        self.chunks.appendValue((bytes(data),))
                        size += len(data)
                at, last = at + 1, now
                if why or is_end:
                    yield self._close(key, size, why)
                    done = True
                else:
                    # a moved idle deadline: the old timer fires and finds later progress
                    self.handle.registerTimer(now + self.idle_ms)
        self.progress.update((first, last, at, size, 0 if done else held, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.progress.exists():
            return
        first, last, at, size, held, done = self.progress.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        overdue = "total" if now >= first + self.total_ms else "idle" if last is not None and now >= last + self.idle_ms else None
        if overdue and not done:
            yield self._close(key, size, overdue)
            self.progress.update((first, last, at, size, 0, True))
        if now >= first + self.total_ms:
            self.progress.clear()

    def _close(self, key, size: int, why: str | None) -> pd.DataFrame:
        content = b"".join(c[0] for c in self.chunks.get()) if self.chunks.exists() else b""
        self.chunks.clear()
        self.waiting.clear()
        return pd.DataFrame({"payload_id": [key[0]], "content": [content], "bytes": [size], "truncated": [why is not None], "reason": [why]})

    def close(self) -> None:
        pass


def assemble_payloads(
    chunks: DataFrame, max_bytes: int = V.GATE_MAX_BYTES, idle_ms: int = V.GATE_IDLE_MS, total_ms: int = V.GATE_TOTAL_MS, lateness: str = "10 seconds", first_seq: int = 0
) -> DataFrame:
    """Payloads of a chunk stream ``(payload_id, seq, data, is_end, ts)`` by event time.

    Chunks are numbered from ``first_seq`` without gaps; one that arrives again is left out. An exact fill is not an overrun, a clean
    end wins, and a payload left open past a deadline, or with a chunk that never came, is reported once as truncated with its reason.
    """
    return (
        chunks.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp"))).withWatermark("ts", lateness)
        .groupBy("payload_id")
        .transformWithStateInPandas(AssemblePayload(max_bytes, idle_ms, total_ms, first_seq), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    )


def complete_payloads(payloads: DataFrame) -> DataFrame:
    """Only whole payloads, as text ready for the gate; truncated ones must never be scanned as if whole."""
    return payloads.where("not truncated").withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
