"""Retention, arrival, ledgers and session weight over events (a user is a repo, a view a visit, a click a clone)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.text import churn_lines, iso_week_id, traffic_day, utc_day
from wardline.operators import activity as A
from wardline.plans.registry import query

_WEEK = "cast(isoyear(ts) as varchar) || '-W' || lpad(cast(weekofyear(ts) as varchar), 2, '0')"


@query("iso_weeks", "FN1 FN2", f"select event_id, {_WEEK} as week, strftime(ts, '%Y-%m-%d') as day, case when event_id % 4 <> 0 then strftime(ts, '%Y-%m-%d') end as traffic_day from events")
def iso_weeks(t):
    stamp = F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("20240101 x")
    return t.events.select("event_id", iso_week_id(F.col("ts")).alias("week"), utc_day(F.col("ts")).alias("day"), traffic_day(stamp).alias("traffic_day"))


_STAMPS_SQL = "stamps as (select user_id, ts from events where event_type = 'purchase')"
_RETENTION_SQL = f"""{_STAMPS_SQL}, weeks as (select distinct user_id, {_WEEK} as week from stamps),
per as (select user_id, count(*) as week_count, string_agg(week, ',' order by week) as weeks from weeks group by user_id),
kinds as (select u.user_id, case when coalesce(week_count,0) >= 2 then 'retained' when week_count = 1 then 'install' else 'unknown-shape' end as kind, coalesce(week_count,0) as week_count, coalesce(weeks,'') as weeks
  from (select distinct user_id from events) u left join per using (user_id))"""


def _stamps(t):
    return t.events.where("event_type = 'purchase'").select("user_id", "ts")


@query("retention", "AGG8 ST5", f"with {_RETENTION_SQL} select * from kinds")
def retention(t):
    return A.retention(_stamps(t), "user_id", t.events).withColumn("weeks", F.array_join("weeks", ","))


@query(
    "north_star", "AGG9",
    f"with {_RETENTION_SQL} select count(*) filter (kind = 'retained' and user_id % 10 <> 0) as retained, count(*) filter (kind = 'install' and user_id % 10 <> 0) as installs, "
    "count(*) filter (kind = 'unknown-shape' and user_id % 10 <> 0) as unknown_shape, count(*) filter (user_id % 10 = 0) as excluded from kinds",
)
def north_star(t):
    kinds = A.retention(_stamps(t), "user_id", t.events)
    return A.north_star(kinds.where("user_id % 10 <> 0"), kinds.where("user_id % 10 = 0"))


@query(
    "receipt_timestamps", "SRC12",
    f"select user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, case when event_id % 4 = 2 then 1 else 2 end as stamps from events where event_id % 4 <> 3",
)
def receipt_timestamps(t):
    i = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = F.concat(F.lit("# run receipt\n- phase: x\n- at: "), stamp, F.lit("\n - AT: "), stamp, F.lit("\nother 2020-01-01T00:00:00Z\n"))
    loose = F.concat(F.lit("# run receipt\nseen "), stamp, F.lit(" end"))
    packed = F.concat(F.lit('{"encoding":"base64","content":"'), F.base64(F.encode(lines, "UTF-8")), F.lit('"}'))
    body = F.when(i % 4 == 0, lines).when(i % 4 == 1, packed).when(i % 4 == 2, loose).otherwise("# other file 2024-01-01T00:00:00Z")
    receipts = t.events.select("user_id", "event_id", body.alias("body"))
    rows = A.receipt_timestamps(receipts, ["user_id", "event_id"], header="run receipt")
    return rows.groupBy("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at")).agg(F.count("*").cast("int").alias("stamps"))


# --- arrival ------------------------------------------------------------------------------------------------

_DAYS_SQL = """v as (select user_id, strftime(ts,'%Y-%m-%d') as day, count(*) as views, count(distinct cast(value as int)) as unique_views from events where event_type = 'view' group by all),
c as (select user_id, strftime(ts,'%Y-%m-%d') as day, count(*) as clones, count(distinct cast(value as int)) as unique_clones from events where event_type = 'click' group by all),
days as (select coalesce(v.user_id, c.user_id) as user_id, coalesce(v.day, c.day) as day, coalesce(views, 0) as views, coalesce(unique_views, 0) as unique_views, coalesce(clones, 0) as clones, coalesce(unique_clones, 0) as unique_clones
  from v full outer join c on v.user_id = c.user_id and v.day = c.day)"""


def _side(t, kind):
    # distinct values per (user, day) are reduced before they are counted
    whole = F.expr("cast(round(value) as int)")
    seen = t.events.where(F.col("event_type") == kind).groupBy("user_id", utc_day(F.col("ts")).alias("day"), whole.alias("w")).agg(F.count("*").alias("n"))
    return seen.groupBy("user_id", "day").agg(F.sum("n").alias("count"), F.count("*").alias("uniques"))


def _days(t):
    return A.traffic_days(_side(t, "view"), _side(t, "click"), ["user_id"])


_SQL_ROUND = _DAYS_SQL.replace("cast(value as int)", "cast(round(value) as int)")


@query("traffic_days", "JN8", f"with {_SQL_ROUND} select * from days")
def traffic_days(t):
    return _days(t)


@query(
    "clone_spikes", "AGG10",
    """with w as (select user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as day, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'click') as clones from events group by all)
    select user_id, day, views, clones, case when views = 0 then 'clones=' || clones || ' with zero views (CI/self likely)' else 'clones=' || clones || ' >= 2× views=' || views end as reason
    from w where clones >= 5 and (views = 0 or clones >= 2 * views)""",
)
def clone_spikes(t):
    weeks = t.events.groupBy("user_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clones")
    )
    return A.clone_spikes(weeks)


_PAYLOAD_TOTALS = "case when user_id % 3 = 0 then 777 else cast(sum(views) over (partition by user_id) as bigint) end"


@query(
    "traffic_payload", "SRC6",
    f"with {_SQL_ROUND} select user_id, day, views, unique_views, clones, unique_clones, {_PAYLOAD_TOTALS} as views_total, cast(sum(unique_views) over (partition by user_id) as bigint) as views_uniques, "
    "cast(sum(clones) over (partition by user_id) as bigint) as clones_total, cast(sum(unique_clones) over (partition by user_id) as bigint) as clones_uniques from days",
)
def traffic_payload(t):
    # the daily rows are packed into the JSON an endpoint would send, then parsed back
    def pack(kind, name):
        daily = F.struct(F.concat("day", F.lit("T00:00:00Z")).alias("timestamp"), "count", "uniques")
        body = _side(t, kind).groupBy("user_id").agg(F.collect_list(daily).alias(name))
        total = F.when((F.col("user_id") % 3 == 0) & F.lit(name == "views"), 777).alias("count")
        return body.select("user_id", F.lit(name).alias("endpoint"), F.to_json(F.struct(total, name)).alias("body"))

    return A.parse_traffic_payload(pack("view", "views").unionByName(pack("click", "clones")), ["user_id"])


@query(
    "lost_days", "JN9",
    """with d as (select distinct user_id as repo, strftime(ts,'%Y-%m-%d') as day from events where event_type = 'view'), api as (select * from d where day >= '2024-01-15'), s as (select repo, min(day) as start from api group by repo)
    select d.repo, d.day from d join s using (repo) where d.day < s.start""",
)
def lost_days(t):
    ledger = t.events.where("event_type = 'view'").select(F.col("user_id").alias("repo"), utc_day(F.col("ts")).alias("day"))
    return A.lost_days(ledger, ledger.where("day >= '2024-01-15'").distinct())


@query(
    "guarded_observation", "AGG11",
    """with c as (select count(*) as n from benchmark), p as (select lang, count(*) as docs, bool_or(doc_id % 50 = 49 and lang = 'de') as incomplete, lang = 'es' as failed from documents group by lang)
    select lang, case when n >= 1 and not incomplete and not failed then 'ok' else 'UNKNOWN' end as status, case when n >= 1 and not incomplete and not failed then docs end as docs from p, c""",
)
def guarded_observation(t):
    control = t.benchmark.agg(F.count("*").alias("n")).withColumn("failed", F.lit(False))
    production = t.documents.groupBy("lang").agg(
        F.count("*").alias("docs"), F.bool_or((F.col("doc_id") % 50 == 49) & (F.col("lang") == "de")).alias("incomplete")
    ).withColumn("failed", F.col("lang") == "es")
    return A.guarded_observation(production, control, "docs")


@query(
    "guarded_unknown", "AGG11",
    "select lang, 'UNKNOWN' as status, cast(null as bigint) as docs from documents group by lang",
)
def guarded_unknown(t):
    control = t.benchmark.where("text = 'no such text'").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False))
    production = t.documents.groupBy("lang").agg(F.count("*").alias("docs")).withColumn("incomplete", F.lit(False)).withColumn("failed", F.lit(False))
    return A.guarded_observation(production, control, "docs")


_REPOS_SQL = """repos as (select c_custkey, ['Me','other','ME','x'][c_custkey % 4 + 1] || '/r' || c_custkey as repo, ['Me','other','ME','x'][c_custkey % 4 + 1] as owner, c_custkey % 3 = 0 as fork,
  case when c_custkey % 9 = 0 then 'me' when c_custkey % 9 = 3 then 'them' end as parent_owner from customer)"""


def _repos(t):
    i = F.col("c_custkey")
    owner = F.get(F.array(*[F.lit(o) for o in ("Me", "other", "ME", "x")]), (i % 4).cast("int"))
    return t.customer.select(
        F.concat(owner, F.lit("/r"), i.cast("string")).alias("repo"),
        owner.alias("owner"),
        (i % 3 == 0).alias("fork"),
        F.when(i % 9 == 0, "me").when(i % 9 == 3, "them").alias("parent_owner"),
        F.when(i % 9 == 0, "base").alias("parent_name"),
    )


@query(
    "exclude_self", "JN10",
    f"""with {_REPOS_SQL} select repo, lower(owner) = 'me' or (fork and coalesce(parent_owner = 'me', false)) as exclude,
    case when lower(owner) = 'me' then 'owner is selfOwner (me)' when fork and parent_owner = 'me' then 'fork of me/base' end as reason,
    lower(owner) <> 'me' and fork and parent_owner is null as needs_parent from repos""",
)
def exclude_self(t):
    return A.exclude_self(_repos(t), "me").select("repo", "exclude", "reason", "needs_parent")


@query(
    "resolve_parents", "JN10",
    f"""with {_REPOS_SQL}, full_repos as (select repo, owner, fork, coalesce(parent_owner, case when c_custkey % 2 = 0 then 'Me' end) as po from repos)
    select repo, lower(owner) = 'me' or (fork and coalesce(lower(po) = 'me', false)) as exclude from full_repos""",
)
def resolve_parents(t):
    lookup = t.customer.where("c_custkey % 2 = 0").select(
        F.concat(F.get(F.array(*[F.lit(o) for o in ("Me", "other", "ME", "x")]), (F.col("c_custkey") % 4).cast("int")), F.lit("/r"), F.col("c_custkey").cast("string")).alias("repo"),
        F.lit("Me").alias("parent_owner"), F.lit("me/base").alias("parent_name"),
    )
    return A.resolve_parents(_repos(t), lookup, "me").select("repo", "exclude")


@query("first_per_name", "SET5", "select c_mktsegment || c_nationkey as name, min(c_custkey) as c_custkey, arg_min(c_name, c_custkey) as c_name from customer group by 1")
def first_per_name(t):
    named = t.customer.select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), "c_custkey", "c_name")
    return A.first_per_name(named, "name", "c_custkey").select("name", "c_custkey", "c_name")


@query("union_distinct", "SET1", "select o_custkey as k from orders union select c_custkey from customer")
def union_distinct(t):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()


# --- ledger --------------------------------------------------------------------------------------------------------

_LEDGER_SQL = f"""{_SQL_ROUND}, totals as (select user_id as repo, '2024-02-01T06:00:00Z' as measured_at_utc, day, views, unique_views, cast(sum(clones) over (partition by user_id) as bigint) as ct, cast(sum(unique_clones) over (partition by user_id) as bigint) as cu from days)"""


def _ledger_rows(t):
    days = _days(t).withColumnRenamed("user_id", "repo")
    sums = days.groupBy("repo").agg(F.sum("clones").alias("clones_total"), F.sum("unique_clones").alias("clones_uniques"))
    ref = F.struct(F.concat(F.lit("a\tb\n"), F.col("repo").cast("string")).alias("referrer"), F.lit(3).cast("bigint").alias("count"), F.lit(2).cast("bigint").alias("uniques"))
    return A.ledger_rows(days.join(sums, "repo"), F.lit("2024-02-01T06:00:00Z").cast("timestamp"), ref)


@query(
    "new_ledger_rows", "SNK1 SET3",
    f"with {_LEDGER_SQL} select repo, day, views, ct as clones_14d_total from totals where not (repo % 2 = 0 and day < '2024-01-10')",
)
def new_ledger_rows(t):
    rows = _ledger_rows(t)
    # half of the repos already have their first days recorded on the same measurement day
    recorded = rows.where("repo % 2 = 0 and day < '2024-01-10'").withColumn("measured_at_utc", F.expr("measured_at_utc + interval 2 hours"))
    earlier = rows.withColumn("measured_at_utc", F.expr("measured_at_utc - interval 1 day"))
    return A.new_ledger_rows(rows, recorded.unionByName(earlier)).select("repo", "day", "views", "clones_14d_total")


@query(
    "recorded_days", "SET3",
    "select distinct user_id as repo, strftime(ts, '%Y-%m-%d') as measured_day, event_type as day from events",
)
def recorded_days(t):
    return A.recorded_days(t.events.select(F.col("user_id").alias("repo"), F.col("ts").alias("measured_at_utc"), F.col("event_type").alias("day")))


@query(
    "ledger_lines", "SNK2",
    f"with {_LEDGER_SQL} select '2024-02-01 06:00:00' || chr(9) || 'github-traffic-api' || chr(9) || day || chr(9) || views || chr(9) || unique_views || chr(9) || ct || chr(9) || cu || chr(9) || 'a\\tb\\n' || repo || chr(9) || '3' || chr(9) || '2' as value from totals",
)
def ledger_lines(t):
    return A.ledger_lines(_ledger_rows(t))


@query(
    "ledger_round_trip", "SRC5 SNK2",
    f"with {_LEDGER_SQL} select ok, count(*) as lines, cast(sum(views) as bigint) as views from (select true as ok, views from totals union all select false, null from totals where repo % 7 = 0) group by ok",
)
def ledger_round_trip(t):
    lines = A.ledger_lines(_ledger_rows(t))
    torn = _ledger_rows(t).where("repo % 7 = 0").select(F.concat(F.lit("2024-01-01T00:00:00Z\tx\t"), "day").alias("value"))
    parsed = A.parse_ledger(lines.unionByName(torn))
    return parsed.groupBy("ok").agg(F.count("*").alias("lines"), F.sum("views").alias("views"))


_SAVED_SQL = "saved as (select *, lead(sha) over (partition by repo order by seq) as nxt from (select o_orderpriority as repo, o_orderkey as seq, cast(o_custkey % 3 as varchar) || '-short-id-tail' as sha from orders))"


def _entries(t):
    return t.orders.select(
        F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("seq"), F.concat((F.col("o_custkey") % 3).cast("string"), F.lit("-short-id-tail")).alias("sha")
    )


@query("upsert_savepoints", "SNK3 W10", f"with {_SAVED_SQL} select repo, seq, sha from saved where nxt is null or nxt <> sha")
def upsert_savepoints(t):
    return A.upsert_savepoints(_entries(t))


@query(
    "last_savepoints", "SNK3 SRT3",
    f"with {_SAVED_SQL}, k as (select *, row_number() over (partition by repo order by seq desc) as rn from saved where nxt is null or nxt <> sha) select repo, seq, sha from k where rn <= 15",
)
def last_savepoints(t):
    return A.last_savepoints(A.upsert_savepoints(_entries(t)))


@query(
    "churn_lines", "FN4",
    "select event_id, case event_id % 4 when 0 then event_id + user_id when 1 then event_id when 2 then user_id else 0 end as lines from events",
)
def churn_lines_query(t):
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" 3 files changed, "), e, F.lit(" insertions(+), "), u, F.lit(" deletions(-)")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" 1 file changed, "), e, F.lit(" insertion(+)")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(" 1 file changed, "), u, F.lit(" deletions(-)")))
    )
    return t.events.select("event_id", churn_lines(text).alias("lines"))


@query(
    "session_weight", "AGG16 ST6",
    """with last as (select user_id, max(ts) as saved_at from events where event_type = 'purchase' group by user_id), now as (select max(ts) as n from events),
    since as (select e.user_id, count(*) filter (event_type = 'view') as commits, coalesce(sum(value) filter (event_type = 'click'), 0) as lines from events e join last l on e.user_id = l.user_id and e.ts > l.saved_at group by e.user_id),
    w as (select l.user_id, coalesce(commits, 0) as commits, round(coalesce(lines, 0), 2) as lines, coalesce(commits, 0) + coalesce(lines, 0) / 60 + (epoch_us(n) - epoch_us(saved_at)) / 1e6 / 3600 / 2 as weight from last l left join since s using (user_id), now)
    select user_id, commits, lines, round(weight, 6) as weight, case when weight < 4 then 'Fresh' when weight < 12 then 'Getting heavy' else 'Time to reset' end as band from w""",
)
def session_weight(t):
    activity = t.events.select(
        "user_id", "ts", (F.col("event_type") == "view").cast("bigint").alias("commits"),
        F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("lines"),
    )
    saves = t.events.where("event_type = 'purchase'").select("user_id", "ts")
    now = t.events.agg(F.max("ts").alias("now"))
    weighed = A.session_weight(activity, saves, "user_id", now)
    return weighed.select("user_id", "commits", F.round("lines", 2).alias("lines"), F.round("weight", 6).alias("weight"), "band")
