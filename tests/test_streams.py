"""Streams over the given tables in the forms that they come in."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd

from wardline.plans.registry import Tables
from wardline.plans.streams import finish, stream_of
from wardline.streaming import measures
from wardline.streaming.measures import SessionWeight

SMALL = "/root/testdata/sf0.001"


class Held:
    """A value or a list of state."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):
        return Held()

    getListState = getValueState

    def registerTimer(self, at_ms):
        self.timers.append(at_ms)


def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for k, folder in enumerate((SMALL, str(tmp_path))):
        seen = []
        finish(
            stream_of(Tables(spark, folder), "documents").writeStream.foreachBatch(lambda rows, _, seen=seen: seen.append(rows.count()))
            .option("checkpointLocation", str(tmp_path / f"check-{k}"))
        )
        assert sum(seen) == docs.count()


def test_waiting_activity_is_folded_once_for_all_that_is_due():
    session = SessionWeight(10**9)
    session.init(Handle())
    rows = pd.DataFrame({"at_us": [5000, 1000, 3000, 9000, 3000], "is_savepoint": [False, True, False, False, False], "commits": [1, 0, 2, 8, 4], "lines": [0.5, 0.0, 1.0, 2.0, 1.0]})
    list(session.handleInputRows((7,), iter([rows]), None))
    assert session.handle.timers == [1]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 6)
    due = lambda ms: list(session.handleExpiredTimer((7,), now, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))
    (out,) = due(1)
    assert out.iloc[0].to_dict() == {"key": "7", "at": 5000, "saved_at": 1000, "commits": 7, "lines": 2.5}
    assert session.handle.timers == [1, 9] and due(1) == []


def test_session_weight_by_joins_equals_the_walk(spark, tmp_path, monkeypatch):
    """Rows up to a batch late, two at a time, some without values; a row that comes too late does not count; no state operator."""
    monkeypatch.setattr(measures, "COMPACT", 2)
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    schema = "user long, ts timestamp, commits long, lines double, is_savepoint boolean"
    moment = lambda s: start + dt.timedelta(seconds=s)
    parts, walked = [[] for _ in range(6)], {}
    for _ in range(300):
        user, second = rng.randrange(9), rng.randrange(250) * 2
        mark = user > 0 and rng.random() < 0.1
        row = (user, moment(second), rng.choice([0, 1, 2, None]), rng.choice([0.0, 1.5, None]), mark)
        parts[min(second // 100 + rng.randrange(2), 5)].append(row)
        walked.setdefault(user, []).append(row)
    parts[0].append((None, None, 5, 5.0, False))
    # far behind the watermark by then
    parts[4].append((3, moment(1), 0, 0.0, True))
    parts.append([(-1, moment(10**8), 0, 0.0, False)])
    want = {}
    for user, rows in walked.items():
        saved = max((r[1] for r in rows if r[4]), default=None)
        if saved is not None:
            since = [r for r in rows if r[1] > saved]
            want[str(user)] = (max(r[1] for r in rows), saved, sum(r[2] or 0 for r in since), sum(r[3] or 0.0 for r in since))
    folder = str(tmp_path / "state")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = measures.session_weight_batches(stream, "user", folder, str(tmp_path / "check"), "200 seconds").trigger(availableNow=True).start()
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
    got = {r.key: (r.at, r.saved_at, r.commits, r.lines) for r in measures.newest_session_weight(spark, folder).collect()}
    assert got == want and len(want) > 5
    # folded before the compaction, so their rows are gone
    assert not (tmp_path / "state" / "rows" / "batch=0").exists() and (tmp_path / "state" / "rows" / "all=6").exists()
