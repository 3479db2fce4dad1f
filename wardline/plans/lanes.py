"""Lanes of work over line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import lanes as L
from wardline.plans.registry import query

# A lane is a supplier group, a repo a return flag and ship month, a file a part.
_TOUCH_SQL = "touched as (select distinct l_returnflag || strftime(l_shipdate, '%Y-%m') as repo, l_suppkey % 8 as lane, 'part' || l_partkey as file from lineitem where l_partkey % 50 <> 0), hot as (select repo, file, count(*) as lanes, min(lane) as first_lane, max(lane) as last_lane from touched group by all having count(*) > 1)"


def _lane_files(t):
    name = F.when(F.col("l_partkey") % 50 == 0, "AGENTS.md").otherwise(F.concat(F.lit("part"), F.col("l_partkey").cast("string")))
    return t.lineitem.select(F.concat("l_returnflag", F.date_format("l_shipdate", "yyyy-MM")).alias("repo"), (F.col("l_suppkey") % 8).alias("lane"), name.alias("file"))


@query("collision_map", "AGG12", f"with {_TOUCH_SQL} select * from hot")
def collision_map(t):
    return L.collision_map(_lane_files(t))


@query(
    "colliding_lanes", "AGG12",
    f"with {_TOUCH_SQL} select t.repo, lane, count(*) as files, bool_or(h.file is not null) as colliding from touched t left join hot h on t.repo = h.repo and t.file = h.file group by all",
)
def colliding_lanes(t):
    return L.colliding_lanes(_lane_files(t))


_TRAIN_SQL = """lanes as (select o_custkey as repo, o_orderkey as lane, 'c' || o_orderkey as commit, o_orderstatus = 'P' and o_orderkey % 3 = 0 as conflict, o_orderpriority <> '1-URGENT' as gate_ok from orders),
h as (select *, coalesce(bool_or(conflict) over (partition by repo order by lane rows between unbounded preceding and 1 preceding), false) as halted from lanes),
o as (select *, case when halted then 'skipped' when conflict then 'conflict' when not gate_ok then 'quarantined' else 'landed' end as outcome from h)"""


def _train(t):
    return t.orders.select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("lane"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("commit"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0)).alias("conflict"), (F.col("o_orderpriority") != "1-URGENT").alias("gate_ok"),
    )


@query(
    "sequential_admission", "W5",
    f"with {_TRAIN_SQL} select repo, lane, outcome, last_value(case when outcome = 'landed' then commit end ignore nulls) over (partition by repo order by lane rows between unbounded preceding and 1 preceding) as last_good from o",
)
def sequential_admission(t):
    return L.sequential_admission(_train(t)).select("repo", "lane", "outcome", "last_good")


@query(
    "lane_status", "AGG24",
    "select o_orderkey, case o_orderstatus when 'F' then 'landed' when 'O' then 'skipped' else 'conflict' end as status from orders",
)
def lane_status(t):
    outcome = F.when(F.col("o_orderstatus") == "F", "landed").when(F.col("o_orderstatus") == "O", "rebased").otherwise("conflict")
    return t.orders.select("o_orderkey", L.lane_status(outcome).alias("status"))
