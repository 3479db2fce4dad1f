"""The given tables read as streams to their end; results must equal the batch answers."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import activity as A
from wardline.plans.activity import _ledger_rows, _LEDGER_SQL, _RETENTION_SQL
from wardline.plans.detection import _pii_cte
from wardline.plans.registry import query
from wardline.session import shared_folder, ship_package
from wardline.streaming.gates import gate_stream
from wardline.streaming.measures import ledger_stream, newest_session_weight, retention_stream, session_weight_batches, weigh
from wardline.streaming.payloads import assemble_payloads

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark) -> str:
    """A new folder in the place that driver and executors share."""
    ship_package(spark)
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(t, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; a stream takes a file only by a pattern."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parque[t]")


def finish(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into Parquet and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    finish(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.schema(stream.schema.add("batch", T.IntegerType())).parquet(f"{folder}/out")


def arriving(rows: DataFrame, part: Column, parts: int, folder: str) -> DataFrame:
    """The rows as a stream of one file, and so one micro-batch, for each value of ``part`` from 0 on."""
    spark = rows.sparkSession
    rows.withColumn("_part", part.cast("int")).repartition(parts, "_part").write.partitionBy("_part").parquet(f"{folder}/dealt")
    for k in range(parts):
        spark.read.schema(rows.schema).parquet(f"{folder}/dealt/_part={k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def shuffled(*keys: str) -> Column:
    """A number from 0 to 99 that looks like chance."""
    return F.pmod(F.xxhash64(*keys), F.lit(100))


@query(
    "stream_gate", "ST1",
    "with " + _pii_cte("documents") + " select doc_id, case when doc_id in (select doc_id from pii) then 'REDACT' else 'PASS' end as action, length(text) as source_chars, doc_id in (select doc_id from pii) as changed from documents",
)
def stream_gate(t):
    folder = scratch(t.spark)
    finish(gate_stream(stream_of(t, "documents"), "text", ["doc_id"], folder, f"{folder}/checkpoint"))
    passed = t.spark.read.parquet(f"{folder}/passed").select("doc_id", "action", F.col("text").alias("out"))
    return passed.join(t.documents, "doc_id").select("doc_id", "action", F.length("text").alias("source_chars"), (F.col("out") != F.col("text")).alias("changed"))


@query(
    "stream_payloads", "ST2",
    """with m as (select conv_id, max(turn) as last from conversations group by conv_id), c as (select conv_id, turn, text, strlen(text) as n, turn = last and conv_id % 4 <> 0 as is_end from conversations join m using (conv_id)),
    s as (select *, sum(n) over (partition by conv_id order by turn) as total from c),
    g as (select conv_id, min(turn) filter (turn > 0 and turn % 5 = 4 and conv_id % 3 = 0) as idle_turn, min(turn) filter (total > 2000) as cap_turn from s group by conv_id),
    w as (select conv_id, case when idle_turn is not null and (cap_turn is null or idle_turn <= cap_turn) then 'idle' when cap_turn is not null then 'max-bytes' end as reason, idle_turn from g where conv_id % 4 <> 0 or cap_turn is not null or idle_turn is not null),
    t as (select conv_id, reason, string_agg(text, '' order by turn) as body from w join c using (conv_id) where reason is null or reason = 'max-bytes' or turn < idle_turn group by conv_id, reason)
    select cast(w.conv_id as varchar) as payload_id, w.reason as reason, w.reason is not null as truncated, cast(case when w.reason = 'max-bytes' then 2000 else strlen(coalesce(body, '')) end as bigint) as bytes,
      case when w.reason = 'max-bytes' then left(hex(encode(body)), 4000) else hex(encode(coalesce(body, ''))) end as content from w left join t using (conv_id)""",
)
def stream_payloads(t):
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    # turns follow each other by one second; in every third conversation turn 4 comes after a long silence
    pause = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") >= 4), 40).otherwise(0)
    shaped = t.conversations.join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("payload_id"), F.col("turn").alias("seq"), F.encode("text", "UTF-8").alias("data"),
        ((F.col("turn") == F.col("last")) & (F.col("conv_id") % 4 != 0)).alias("is_end"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") + pause).alias("ts"),
    )
    folder = scratch(t.spark)
    # chunks come in any order over six micro-batches, and some of them twice
    twice = shaped.unionByName(shaped.where(shuffled("payload_id", "seq") < 10))
    chunks = arriving(twice, F.floor(F.rand(5) * 6), 6, folder)
    out = drain(assemble_payloads(chunks, max_bytes=2000, lateness="1 hour"), folder)
    return out.select("payload_id", "reason", "truncated", "bytes", F.hex("content").alias("content"))


@query("stream_ledger", "ST3", f"with {_LEDGER_SQL} select repo, day, views, 1 as copies from totals")
def stream_ledger(t):
    folder = scratch(t.spark)
    rows = _ledger_rows(t)
    rows.write.parquet(f"{folder}/in")
    for attempt in ("a", "b"):  # the second run of the same day must add nothing
        source = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        finish(ledger_stream(source, f"{folder}/ledger", f"{folder}/checkpoint-{attempt}"))
    return t.spark.read.parquet(f"{folder}/ledger").groupBy("repo", "day", "views").agg(F.count("*").cast("int").alias("copies"))


@query("stream_retention", "ST5", f"with {_RETENTION_SQL} select user_id, kind from kinds where kind <> 'unknown-shape'")
def stream_retention(t):
    folder = scratch(t.spark)
    stamps = t.events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = arriving(stamps, F.floor(shuffled("event_id") * 6 / 100), 6, folder)
    out = drain(retention_stream(stream, "user_id", "1000 days"), folder, "update")
    # the newest update of a key is its answer
    return out.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.max_by("kind", "batch").alias("kind"))


@query(
    "stream_session_weight", "ST6",
    """with last as (select user_id, max(ts) as saved_at from events where event_type = 'purchase' group by user_id), now as (select max(ts) as n from events),
    since as (select e.user_id, count(*) filter (event_type = 'view') as commits, coalesce(sum(value) filter (event_type = 'click'), 0) as lines from events e join last l on e.user_id = l.user_id and e.ts > l.saved_at group by e.user_id)
    select cast(l.user_id as varchar) as key, coalesce(commits, 0) as commits, round(coalesce(lines, 0), 2) as lines,
    case when coalesce(commits, 0) + coalesce(lines, 0) / 60 + (epoch_us(n) - epoch_us(saved_at)) / 1e6 / 3600 / 2 < 4 then 'Fresh' when coalesce(commits, 0) + coalesce(lines, 0) / 60 + (epoch_us(n) - epoch_us(saved_at)) / 1e6 / 3600 / 2 < 12 then 'Getting heavy' else 'Time to reset' end as band
    from last l left join since s using (user_id), now""",
)
def stream_session_weight(t):
    activity = t.events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").cast("bigint").alias("commits"),
        F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("lines"), (F.col("event_type") == "purchase").alias("is_savepoint"),
    )
    now, first = t.events.agg(F.max("ts").cast("timestamp"), F.min("ts").cast("timestamp")).first()
    # seven micro-batches by time; a third of the rows comes one or two batches late
    span = (now - first).total_seconds() / 7
    late = F.when(shuffled("event_id") < 33, shuffled("event_id", "user_id") % 2 + 1).otherwise(0)
    part = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / 1e6 / span)
    folder = scratch(t.spark)
    # one row long after all others lets the last ones fall due
    closing = t.spark.createDataFrame([(-1, -1, now + dt.timedelta(days=4000), 0, 0.0, False)], activity.schema)
    rows = activity.withColumn("_p", F.least(part + late, F.lit(6))).unionByName(closing.withColumn("_p", F.lit(7).cast("bigint")))
    rows.write.partitionBy("_p").parquet(f"{folder}/dealt")
    dealt = t.spark.read.schema(rows.schema).parquet(f"{folder}/dealt")
    for k in range(8):  # the stream is stopped after each micro-batch and begins again where it was
        dealt.where(F.col("_p") == k).drop("_p").write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(activity.schema).parquet(f"{folder}/in")
        finish(session_weight_batches(stream, "user_id", f"{folder}/state", f"{folder}/checkpoint", f"{int(span * 4)} seconds"))
    newest = newest_session_weight(t.spark, f"{folder}/state")
    return weigh(newest, F.lit(now)).select("key", "commits", F.round("lines", 2).alias("lines"), "band")
