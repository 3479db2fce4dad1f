"""Retention, arrival and session measurements, with ledgers that can be appended to again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import fixed_values as V
from wardline.functions.text import iso_week_id, traffic_day, tsv_field, utc_day
from wardline.operators.running import chunk_of, running
from wardline.session import broadcast_if_small

# --- receipts and retention ------------------------------------------------------------------


def decode_body(body: Column) -> Column:
    """A contents document (JSON with base64 content) decoded to its text; other bodies as they are."""
    content = F.get_json_object(body, "$.content")
    encoding = F.coalesce(F.get_json_object(body, "$.encoding"), F.lit("base64"))
    decoded = F.make_valid_utf8(
        F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64")).cast("string")
    )
    return F.when(
        F.ltrim(body).startswith("{"), F.when(content.isNotNull(), F.when(encoding == "base64", decoded).otherwise(content))
    ).otherwise(body)


def receipt_stamps(body: Column, header: str | None = None) -> Column:
    """Timestamps of a receipt: its ``- at:`` lines, or any ISO-8601 stamp when it has none."""
    at_lines = F.regexp_extract_all(body, F.lit(V.AT_LINE), F.lit(1))
    stamps = F.when(F.size(at_lines) > 0, at_lines).otherwise(F.regexp_extract_all(body, F.lit(V.ISO_STAMP), F.lit(0)))
    none = F.array().cast("array<string>")
    stamps = F.coalesce(stamps, none)
    return stamps if header is None else F.when(F.contains(body, F.lit(header)), stamps).otherwise(none)


def receipt_timestamps(receipts: DataFrame, keys: list[str], body: str = "body", header: str | None = None) -> DataFrame:
    """One row per readable timestamp of each receipt."""
    decoded = receipts.select(*keys, decode_body(F.col(body)).alias("_body"))
    stamps = decoded.select(*keys, F.explode(receipt_stamps(F.col("_body"), header)).alias("stamp"))
    return stamps.select(*keys, "stamp", F.try_to_timestamp("stamp").alias("ts")).where("ts is not null")


def retention(stamps: DataFrame, key: str, everyone: DataFrame | None = None) -> DataFrame:
    """Distinct ISO weeks per key: one week is an install, two or more are retained, none is unknown.

    Distinct (key, week) pairs are combined before the shuffle, so a key with a third of all
    events contributes a handful of rows.
    """
    weeks = stamps.select(key, iso_week_id(F.col("ts")).alias("week")).distinct()
    per_key = weeks.groupBy(key).agg(F.count("*").alias("week_count"), F.array_sort(F.collect_list("week")).alias("weeks"))
    if everyone is not None:
        per_key = everyone.select(key).distinct().join(per_key, key, "left")
    count = F.coalesce("week_count", F.lit(0)).cast("bigint")
    return per_key.select(
        key,
        F.when(count >= 2, "retained").when(count == 1, "install").otherwise("unknown-shape").alias("kind"),
        count.alias("week_count"),
        F.coalesce("weeks", F.array().cast("array<string>")).alias("weeks"),
    )


def north_star(classified: DataFrame, excluded: DataFrame) -> DataFrame:
    """The counts of a retention report in one row; zero is a result like any other."""
    return classified.agg(
        F.count_if(F.col("kind") == "retained").alias("retained"),
        F.count_if(F.col("kind") == "install").alias("installs"),
        F.count_if(F.col("kind") == "unknown-shape").alias("unknown_shape"),
    ).withColumn("excluded", excluded.agg(F.count("*")).scalar())


def exclude_self(repos: DataFrame, self_owner: str) -> DataFrame:
    """Add ``exclude``, ``reason`` and ``needs_parent``: own repos, and forks whose parent or source is own.

    ``repos`` is ``(repo, owner, fork, parent_owner, parent_name)``; an unknown parent of a fork must be looked up.
    """
    me = self_owner.lower()
    own = F.lower(F.coalesce("owner", F.substring_index("repo", "/", 1))) == me
    fork_of_own = F.col("fork") & (F.lower("parent_owner") == me)
    parent = F.coalesce("parent_name", F.lit("…"))
    label = F.when(F.contains(parent, F.lit("/")), parent).otherwise(F.concat(F.lit(f"{self_owner}/"), parent))
    return repos.select(
        "*",
        F.coalesce(own | fork_of_own, F.lit(False)).alias("exclude"),
        F.when(own, f"owner is selfOwner ({self_owner})").when(fork_of_own, F.concat(F.lit("fork of "), label)).alias("reason"),
        (~own & F.col("fork") & F.col("parent_owner").isNull()).alias("needs_parent"),
    )


def resolve_parents(repos: DataFrame, lookup: DataFrame, self_owner: str) -> DataFrame:
    """Decide the forks of unknown parent with a lookup table of ``(repo, parent_owner, parent_name)``."""
    known = lookup.select("repo", F.col("parent_owner").alias("_po"), F.col("parent_name").alias("_pn"))
    filled = repos.join(broadcast_if_small(known), "repo", "left").select(
        "repo", "owner", "fork", F.coalesce("parent_owner", "_po").alias("parent_owner"), F.coalesce("parent_name", "_pn").alias("parent_name")
    )
    return exclude_self(filled, self_owner)


def first_per_name(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order; a partial aggregate instead of a ranked sort."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def guarded_observation(production: DataFrame, control: DataFrame, metric: str, min_control: int = V.CONTROL_MIN_COUNT) -> DataFrame:
    """A metric is reported only when the control produced something and nothing is incomplete or failed.

    ``control`` is ``(n, failed)`` rows, ``production`` ``(<metric>, incomplete, failed)``; otherwise UNKNOWN and NULL, never 0.
    """
    seen = control.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    broken = control.agg(F.coalesce(F.bool_or("failed"), F.lit(False))).scalar()
    healthy = (F.col("_seen") >= min_control) & ~F.col("_broken") & ~F.col("incomplete") & ~F.col("failed")
    rest = [c for c in production.columns if c not in (metric, "incomplete", "failed")]
    return production.withColumn("_seen", seen).withColumn("_broken", broken).select(
        *rest,
        F.when(healthy, "ok").otherwise("UNKNOWN").alias("status"),
        F.when(healthy, F.col(metric)).alias(metric),
    )


# --- arrival ------------------------------------------------------------------------------------------

_DAILY = "array<struct<timestamp:string,count:bigint,uniques:bigint>>"


def _daily(payloads: DataFrame, endpoint: str, keys: list[str]) -> DataFrame:
    rows = F.from_json(F.get_json_object("body", f"$.{endpoint}"), _DAILY)
    return (
        payloads.where(F.col("endpoint") == endpoint)
        .select(*keys, F.inline(rows))
        .select(*keys, traffic_day(F.col("timestamp")).alias("day"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("uniques", F.lit(0)).alias("uniques"))
        .where("day is not null")
    )


def traffic_days(views: DataFrame, clones: DataFrame, keys: list[str]) -> DataFrame:
    """Views and clones side by side per day; a day on one side only has zeros on the other."""
    on = [*keys, "day"]
    v = views.select(*on, F.col("count").alias("views"), F.col("uniques").alias("unique_views"))
    c = clones.select(*on, F.col("count").alias("clones"), F.col("uniques").alias("unique_clones"))
    zero = F.lit(0).cast("bigint")
    return v.join(c, on, "full_outer").select(*on, *[F.coalesce(n, zero).alias(n) for n in ("views", "unique_views", "clones", "unique_clones")])


def parse_traffic_payload(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Per-day rows of JSON views and clones payloads, with the window totals on every row.

    A total is the payload's own when it has one, else the sum over days.
    """
    days = traffic_days(_daily(payloads, "views", keys), _daily(payloads, "clones", keys), keys)

    def own(endpoint: str, field: str) -> Column:
        return F.max(F.when(F.col("endpoint") == endpoint, F.get_json_object("body", f"$.{field}").try_cast("bigint")))

    given = payloads.groupBy(*keys).agg(
        own("views", "count").alias("_v"), own("views", "uniques").alias("_vu"), own("clones", "count").alias("_c"), own("clones", "uniques").alias("_cu")
    )
    sums = days.groupBy(*keys).agg(
        F.sum("views").alias("_sv"), F.sum("unique_views").alias("_svu"), F.sum("clones").alias("_sc"), F.sum("unique_clones").alias("_scu")
    )
    totals = given.join(sums, keys, "left").select(
        *keys,
        F.coalesce("_v", "_sv").alias("views_total"),
        F.coalesce("_vu", "_svu").alias("views_uniques"),
        F.coalesce("_c", "_sc").alias("clones_total"),
        F.coalesce("_cu", "_scu").alias("clones_uniques"),
    )
    return days.join(totals, keys, "left")


def clone_spikes(days: DataFrame) -> DataFrame:
    """Days whose clones do not look like visitors: at least five, and no views or twice the views."""
    spike = (F.col("clones") >= V.CLONE_SPIKE_MIN) & ((F.col("views") == 0) | (F.col("clones") >= 2 * F.col("views")))
    clones, views = F.col("clones").cast("string"), F.col("views").cast("string")
    reason = F.when(F.col("views") == 0, F.concat(F.lit("clones="), clones, F.lit(" with zero views (CI/self likely)"))).otherwise(
        F.concat(F.lit("clones="), clones, F.lit(" >= 2× views="), views)
    )
    return days.where(spike).withColumn("reason", reason)


def lost_days(ledger: DataFrame, api: DataFrame, key: str = "repo") -> DataFrame:
    """Recorded days that fell off the live window: before its first day and not in it. No window, no losses."""
    start = api.groupBy(key).agg(F.min("day").alias("_start"))
    known = ledger.select(key, "day").distinct()
    return (
        known.join(broadcast_if_small(start), key)
        .where(F.col("day") < F.col("_start"))
        .drop("_start")
        .join(api.select(key, "day"), [key, "day"], "left_anti")
    )


# --- ledgers ---------------------------------------------------------------------------------------------


def ledger_rows(days: DataFrame, measured_at: Column, top_referrer: Column | None = None) -> DataFrame:
    """Ledger rows of an observation: one per day, window totals and the top referrer repeated."""
    ref = F.lit(None) if top_referrer is None else top_referrer
    ref = ref.cast("struct<referrer:string,count:bigint,uniques:bigint>")
    zero = F.lit(0).cast("bigint")
    return days.select(
        "repo",
        measured_at.alias("measured_at_utc"),
        F.lit(V.LEDGER_SOURCE).alias("source"),
        "day",
        F.col("views"),
        F.col("unique_views"),
        F.col("clones_total").alias("clones_14d_total"),
        F.col("clones_uniques").alias("clones_14d_uniques"),
        F.coalesce(ref["referrer"], F.lit("")).alias("top_referrer"),
        F.coalesce(ref["count"], zero).alias("referrer_count"),
        F.coalesce(ref["uniques"], zero).alias("referrer_uniques"),
    )


def recorded_days(ledger: DataFrame) -> DataFrame:
    """What a ledger already holds: traffic days per measurement day."""
    return ledger.select("repo", utc_day(F.col("measured_at_utc")).alias("measured_day"), "day").where("day is not null").distinct()


def new_ledger_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first row of each (repo, measurement day, traffic day) that is not recorded yet; the same observation again adds nothing."""
    rest = [c for c in rows.columns if c != "measured_at_utc"]
    first = F.min(F.struct("measured_at_utc", *rest)).alias("first")
    dated = rows.groupBy("repo", utc_day(F.col("measured_at_utc")).alias("measured_day"), "day").agg(first)
    return dated.join(recorded_days(ledger), ["repo", "measured_day", "day"], "left_anti").select(*[F.col(f"first.{c}") for c in rows.columns])


def append_ledger(rows: DataFrame, path: str, complete: bool = True) -> None:
    """Append what is new to a Parquet ledger, which has a folder per measurement day; only the days of ``rows`` are read.

    Nothing is appended unless the whole observation succeeded.
    """
    if not complete:
        return
    spark = rows.sparkSession
    day = utc_day(F.col("measured_at_utc")).alias("measured_on")
    bounds = rows.select(day).agg(F.min("measured_on"), F.max("measured_on")).first()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and bounds[0] is not None:
        written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("measured_on", T.StringType())])).parquet(path)
        existing = written.where(F.col("measured_on").between(*bounds)).drop("measured_on")
    else:
        existing = rows.limit(0)
    new_ledger_rows(rows, existing).withColumn("measured_on", utc_day(F.col("measured_at_utc"))).write.mode("append").partitionBy("measured_on").parquet(path)


def ledger_lines(rows: DataFrame) -> DataFrame:
    """TSV lines whose values cannot forge rows or columns."""
    return rows.select(F.concat_ws("\t", *[tsv_field(F.col(c)) for c in V.LEDGER_COLUMNS]).alias("value"))


def parse_ledger(lines: DataFrame, line: str = "value") -> DataFrame:
    """Ledger lines as rows with an ``ok`` flag; a torn line is kept with its text and never hides later ones."""
    cols = F.split(F.regexp_replace(F.col(line), "\r$", ""), "\t", -1)
    number = lambda i: F.coalesce(F.floor(F.get(F.col("_c"), F.lit(i)).try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))
    text = lambda i: F.get(F.col("_c"), F.lit(i))
    kept = lines.where((F.col(line) != "") & ~F.startswith(F.col(line), F.lit("measured_at_utc\t"))).withColumn("_c", cols)
    values = [text(0), text(1), text(2), number(3), number(4), number(5), number(6), text(7), number(8), number(9)]
    ok = F.size("_c") >= 10
    return kept.select(
        *[c for c in lines.columns if c != line],
        ok.alias("ok"),
        *[F.when(ok, v).alias(n) for v, n in zip(values, V.LEDGER_COLUMNS, strict=True)],
        F.when(~ok, F.col(line)).alias("bad_line"),
    )


def upsert_savepoints(entries: DataFrame, key: str = "repo", order: str = "seq", sha: str = "sha") -> DataFrame:
    """Save-points where a re-run at the same commit replaces the entry just before it.

    The last row of each run of equal short ids is kept; rows are compared with the next one
    chunk by chunk, so one long history is not sorted in a single task.
    """
    short = F.left(F.col(sha), F.lit(10))
    marked = entries.withColumn("_short", short).withColumn("_back", -F.col(order)).withColumn("_chunk", -chunk_of(F.col(order)))
    following = running(marked, [key], ["_back"], "_chunk", {"_next": ("lag", "_short")})
    kept = following.where(F.col("_next").isNull() | (F.col("_next") != F.col("_short")))
    return kept.drop("_short", "_back", "_chunk", "_next")


def last_savepoints(saved: DataFrame, key: str = "repo", order: str = "seq", n: int = 15) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(F.desc(order))
    return saved.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") <= n).drop("_rn")


# --- session weight ---------------------------------------------------------------------------------------


def weight_band(weight: Column) -> Column:
    return F.when(weight < 4, "Fresh").when(weight < 12, "Getting heavy").otherwise("Time to reset")


def session_weight(activity: DataFrame, savepoints: DataFrame, key: str = "repo", now: DataFrame | None = None) -> DataFrame:
    """Commits + lines/60 + hours/2 since the last save-point of each key.

    ``activity`` is ``(<key>, ts, commits, lines)``, ``savepoints`` ``(<key>, ts)``; a key without one has
    no weight. ``now`` is a one-row frame with the time to measure at, else the current time.
    """
    last = savepoints.groupBy(key).agg(F.max("ts").alias("saved_at"))
    at = F.current_timestamp() if now is None else now.scalar()
    clock = last.withColumn("_now", at.cast("timestamp")).withColumn("_saved", F.col("saved_at").cast("timestamp"))
    since = (
        activity.join(broadcast_if_small(last), key)
        .where(F.col("ts") > F.col("saved_at"))
        .groupBy(key)
        .agg(F.sum("commits").alias("commits"), F.sum("lines").alias("lines"))
    )
    hours = F.greatest((F.col("_now").cast("double") - F.col("_saved").cast("double")) / 3600, F.lit(0.0))
    weight = F.coalesce("commits", F.lit(0)) + F.coalesce("lines", F.lit(0)) / 60 + hours / 2
    return clock.join(since, key, "left").select(
        key,
        F.coalesce("commits", F.lit(0)).cast("bigint").alias("commits"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        weight.alias("weight"),
        weight_band(weight).alias("band"),
    )
