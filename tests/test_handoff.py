"""Repos whose newest commit is a hand-off."""

import datetime as dt

import duckdb
from oracle import rows

from wardline.plans.registry import Tables, load_all


def test_a_repo_without_changes_since_its_handoff_is_left_out(spark, tmp_path):
    day = lambda n: dt.datetime(2001, 7, n)
    orders = [(97, "1-URGENT", day(9)), (5, "1-URGENT", day(8)), (6, "1-URGENT", day(9)), (194, "2-HIGH", day(3)), (7, "2-HIGH", day(4)), (485, "5-LOW", day(1))]
    items = [(k, part, flag) for k, _, _ in orders for part, flag in ((1, "A"), (2, "N"))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    query = load_all()["since_last_handoff"]
    found = query.run(Tables(spark, str(tmp_path)))
    want = con.execute(query.sql)
    got, want = rows(found.columns, [tuple(r) for r in found.collect()]), rows([d[0] for d in want.description], want.fetchall())
    assert got == want and len(want) == 2
