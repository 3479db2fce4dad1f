"""Nothing hides behind a length, a count or a depth."""

import datetime as dt
import os

from pyspark.sql import functions as F

from wardline.operators import scope as S
from wardline.operators.access import ddl_events
from wardline.operators.activity import append_ledger
from wardline.operators.gate import gate
from wardline.operators.maps import express_routes, is_client_file, python_routes, ungated_mutations
from wardline.sources.files import decode_content

KEY = "sk_live_" + "9" * 10 + "a" * 16


def test_a_key_in_the_middle_of_a_long_file(spark):
    data = b"x " * 1_250_000 + KEY.encode() + b" y" * 1_250_000
    df = decode_content(spark.createDataFrame([(bytearray(data),), (bytearray(b"\x00" * 10 + data),)], "content binary"))
    assert [r.action for r in gate(df, "text").select("action").collect()] == ["BLOCK", "BLOCK"]


def test_large_contents_have_their_own_digests(spark):
    files = spark.createDataFrame([("a", "p", "x" * 4_100_000), ("b", "p", "x" * 4_099_999 + "y")], "repo string, path string, content string")
    assert len({r.digest for r in S.dataset_digest(files, "content").collect()}) == 2


def test_literal_true_at_any_depth(spark):
    rows = [(f"r{n}", "(" * n + " true " + ")" * n) for n in (1, 4, 5, 7, 60)] + [("and", "((true) and owner)"), ("or", "(true and (true))")]
    sql = [(r, "supabase/migrations/1.sql", f"create policy p on public.t for insert to public with check {c} ;") for r, c in rows]
    got = {r.repo: r.check_true for r in ddl_events(spark.createDataFrame(sql, "repo string, path string, sql string")).select("repo", "check_true").collect()}
    assert got == {r: r.startswith("r") for r, _ in rows}


def test_gates_far_into_a_statement(spark):
    pad = "a" * 2000
    js = f"app.post('/far', log('{pad}'), requireAuth, save)\napp.post('/open', save)\n"
    py = "\n".join(["@app.post('/deep')", *["@tag(1)"] * 12, "@login_required", "def f(", *[f"    a{i}," for i in range(20)], "):", "    pass"])
    files = spark.createDataFrame([("r", "a.js", js), ("r", "b.py", py)], "repo string, path string, text string")
    assert {r.url: r.session_gated for r in express_routes(files).collect()} == {"/far": True, "/open": False}
    assert {r.url: r.session_gated for r in python_routes(files).collect()} == {"/deep": True}
    client = spark.createDataFrame([("/* " + pad + " */\n// x\n'use client'",), ("const a = 1; 'use client'",)], "t string")
    assert [r[0] for r in client.select(is_client_file(F.col("t"))).collect()] == [True, False]


def test_edge_writes_far_from_their_table(spark):
    far = "const q = db.from('items')" + " " * 500 + ".insert({});"
    files = spark.createDataFrame([("r", f"supabase/functions/{n}/index.ts", t) for n, t in [("a", far), ("b", "requireAuth(r); " + far), ("c", "/* one\n two */\n// three\ndb.from(name).delete();"), ("d", "db.from('x').select('*');")]] + [("r", "src/a.ts", far)], "repo string, path string, text string")
    found = {r.path.split("/")[2]: (r.status, r.methods, r.line, r.rule_id) for r in ungated_mutations(files).collect()}
    assert found == {"a": ("warn", "insert", 1, "edge/ungated-write"), "c": ("incomplete", None, 4, "edge/not-judged")}


def test_two_measurements_of_a_day_are_one_row(spark, tmp_path):
    at = lambda h, d=1: dt.datetime(2024, 5, d, h)
    rows = spark.createDataFrame([("r", at(8), "s", "2024-04-30", 9), ("r", at(6), "s", "2024-04-30", 7), ("r", at(6, 2), "s", "2024-04-30", 8)], "repo string, measured_at_utc timestamp, source string, day string, views long")
    for _ in range(2):
        append_ledger(rows, f"{tmp_path}/ledger")
    got = sorted((r.measured_at_utc, r.views) for r in spark.read.parquet(f"{tmp_path}/ledger").collect())
    assert got == [(at(6), 7), (at(6, 2), 8)]


def test_the_entry_works_without_the_corpus_operators(tmp_path):
    """A copy of the repository without the folders of the corpus operators imports and lists its own queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("wardline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'gate' in q and s.keys() <= q.keys() and not any(n == 'pipeline' or n[:2] == 'op' and n[2].isdigit() for n in q)"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=environment)
