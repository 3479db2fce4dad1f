"""Access-policy events and state. Each customer is a migration file of its nation's repo; its id picks one of five shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import access as X
from wardline.plans.registry import query
from wardline.session import cut_lineage

_CREATE = "-- drop table tID;\nCREATE TABLE tID (id int, note text default 'DROP TABLE x;');\n"
_ON = "ALTER TABLE public.tID ENABLE ROW LEVEL SECURITY;\n"
_OWN = 'CREATE POLICY "Own" ON tID FOR ALL TO authenticated USING (auth.uid() = user_id);\n'
SHAPES = [
    _CREATE + _ON + _OWN,
    _CREATE,
    _CREATE + _ON + "CREATE POLICY p ON tID FOR UPDATE USING ((true));\n",
    _CREATE + _ON + _OWN + "DO $$ BEGIN\n EXECUTE 'alter table x disable row level security';\nEND $$;\n",
    _CREATE + _ON + _OWN + "ALTER TABLE tID RENAME TO rID;\n",
]


def _events(t):
    key = F.col("c_custkey").cast("string")
    sql = F.replace(F.get(F.array(*[F.lit(s) for s in SHAPES]), (F.col("c_custkey") % 5).cast("int")), F.lit("ID"), key)
    files = t.customer.select(
        F.col("c_nationkey").alias("repo"), F.concat(F.lit("supabase/migrations/"), F.lpad(key, 12, "0"), F.lit(".sql")).alias("path"), sql.alias("sql")
    )
    return X.sequence_events(X.ddl_events(files))


_EV = """ev as (select c_nationkey as repo, c_custkey as k, unnest(case c_custkey % 5 when 1 then [{'n':1,'kind':'create_table','line':2}]
  when 3 then [{'n':1,'kind':'create_table','line':2},{'n':2,'kind':'rls','line':3},{'n':3,'kind':'create_policy','line':4},{'n':4,'kind':'not_checkable','line':5}]
  when 4 then [{'n':1,'kind':'create_table','line':2},{'n':2,'kind':'rls','line':3},{'n':3,'kind':'create_policy','line':4},{'n':4,'kind':'rename_table','line':5}]
  else [{'n':1,'kind':'create_table','line':2},{'n':2,'kind':'rls','line':3},{'n':3,'kind':'create_policy','line':4}] end) as e from customer)"""


@query(
    "ddl_events", "FN17 FN18 W4",
    f"with {_EV} select repo, row_number() over (partition by repo order by k, e.n) as seq, e.kind as kind, e.line as line, case when e.kind <> 'not_checkable' then 'public.t' || k end as table_name, case when e.kind = 'rename_table' then 'public.r' || k end as to_table from ev",
)
def ddl_events(t):
    return _events(t).select("repo", "seq", "kind", "line", F.col("table").alias("table_name"), "to_table")


_STATE = f"""{_EV}, s as (select repo, k, e.kind as kind, row_number() over (partition by repo order by k, e.n) as seq from ev),
gaps as (select repo, max(seq) as last_gap from s where kind = 'not_checkable' group by repo),
tables as (select c.c_nationkey as repo, c.c_custkey as k, 'public.' || case when c.c_custkey % 5 = 4 then 'r' else 't' end || c.c_custkey as table_name, c.c_custkey % 5 <> 1 as rls, case when c.c_custkey % 5 not in (1, 2) then s.seq end as secure_seq
  from customer c left join s on s.repo = c.c_nationkey and s.k = c.c_custkey and s.kind = 'create_policy'),
state as (select t.*, coalesce(secure_seq < last_gap, false) as gap from tables t left join gaps using (repo))"""


@query("policy_state", "W3", f"with {_STATE} select repo, table_name, rls, secure_seq, gap from state")
def policy_state(t):
    tables, _ = X.policy_state(_events(t))
    return tables.select("repo", F.col("table").alias("table_name"), "rls", "secure_seq", F.col("gap").isNotNull().alias("gap"))


@query(
    "policy_findings", "FN19",
    f"with {_STATE} select repo, table_name, case when k % 5 = 1 then 'rls-disabled' when k % 5 = 2 then 'permissive-write-policy' else 'lineage-not-checkable' end as rule, 'fail' as severity from state where gap or k % 5 in (1, 2)",
)
def policy_findings(t):
    found = X.policy_findings(*X.policy_state(_events(t)))
    return found.select("repo", F.col("table").alias("table_name"), "rule", "severity")


@query("stream_policy_state", "ST4", f"with {_STATE} select cast(repo as varchar) as repo, table_name, rls, secure_seq is not null as secured, gap from state")
def stream_policy_state(t):
    from wardline.plans.streams import finish, scratch
    from wardline.streaming.policies import newest_policy_state, policy_state_stream

    folder = scratch(t.spark)
    events = cut_lineage(_events(t).withColumn("repo", F.col("repo").cast("string")))
    # five files of a range of seq each are five micro-batches
    last = events.agg(F.max("seq").alias("n")).first()["n"]
    events = events.withColumn("slice", F.floor((F.col("seq") - 1) * 5 / last).cast("int"))
    for k in range(5):
        events.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = t.spark.readStream.schema(events.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    finish(policy_state_stream(source, f"{folder}/state", f"{folder}/checkpoint"))
    return newest_policy_state(t.spark, f"{folder}/state").select("repo", F.col("table").alias("table_name"), "rls", "secured", "gap")
