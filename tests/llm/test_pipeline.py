"""The pipeline's stages, each on its own input, and the registered queries."""

import __spark_entry__
import cases
import corpus_pipeline
import oracle
import pytest

from wardline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    bench = cases.passage(70, 40)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = (300, f"{cases.passage(72, 60)} {bench}", "en", "s0", 0)
    docs = cases.with_clashes(cases.table(spark, [*cases.rows(), leak]))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert {1, 2, 3, 4, 10, 11, 13, 14, 300} <= kept[0] and not kept[0] & {5, 6, 7, 8, 9, 12, 15}
    assert kept[0] - kept[1] == {2, 3} and kept[2] == kept[1] and kept[3] == kept[2] - {300} and kept[4] == kept[3]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cases.table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_and_registration(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id"} <= set(out.columns) and out.count() > 0
    registered = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = oracle.connect(SF)
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert oracle.rows(df.columns, [tuple(r) for r in df.collect()]) == oracle.rows(columns, cur.fetchall())
