"""Operators on small fixture tables: policies, files, running values, sinks and the acceptance cases."""

import datetime
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardline.functions.paths import glob_literal, glob_match
from wardline.functions.text import normalized_lines
from wardline.operators import activity as A
from wardline.operators import duplication as D
from wardline.operators import maps as M
from wardline.operators import report as R
from wardline.operators import scope as S
from wardline.operators.detect import detect
from wardline.operators.findings import findings_by_file
from wardline.operators.policy import allow_decision, load_policy
from wardline.operators.running import chunk_of, running
from wardline.sources import files as files_source
from wardline.sources.sinks import assert_no_raw, write_proofs
from wardline.operators.gate import gate, proof_record

KEY = "sk_live_" + "9" * 26


def test_running_values_equal_a_plain_window(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("o"), (F.hash("id") % 50).alias("v"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("n")
    ).withColumn("chunk", chunk_of(F.col("o"), 64))
    specs = {"mx": ("max", "v"), "sm": ("sum", "v"), "ls": ("last", "n"), "lg": ("lag", "n"), "no": ("number", "")}
    got = running(df, ["k"], ["o"], "chunk", specs)
    df.createOrReplaceTempView("rows_in")
    want = spark.sql(
        """select k, o, v, n, chunk, max(v) over b mx, coalesce(sum(v) over b, 0) sm, last(n, true) over b ls, lag(n) over (partition by k order by o) lg, row_number() over (partition by k order by o) no
        from rows_in window b as (partition by k order by o rows between unbounded preceding and 1 preceding)"""
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_policy_trust_order_and_warnings(spark):
    rules = json.dumps({"version": 1, "secrets": {"ignore": {"hashes": ["sha256:" + "A" * 64, "sk_l…9999 (34 chars)"], "paths": ["docs/"], "patterns": ["jwt"]}}})
    rows = [
        ("ok", "cur", 0, True, "﻿" + rules, rules), ("ok", "old", 1, True, "{}", None),
        ("loose", "cur", 0, False, None, rules), ("loose", "old", 1, True, rules, None),
        ("broken", "cur", 0, True, rules + "}", None), ("list", "cur", 0, True, "[1]", None), ("v2", "cur", 0, True, '{"version": 2}', None), ("flat", "cur", 0, True, '{"ignore":{"values":["x",""]}}', None),
    ]
    df = spark.createDataFrame(rows, "repo string, source string, marker_rank int, in_index boolean, index_text string, worktree_text string")
    out = {r.repo: r for r in load_policy(df).collect()}
    assert out["ok"].trusted and out["ok"].hashes == ["a" * 64] and out["ok"].paths == ["docs/"] and out["ok"].pattern_ids == ["jwt"]
    assert len(out["ok"].warnings) == 2 and "left out 1 hash entries" in out["ok"].warnings[1]
    for name in ("loose", "broken", "list", "v2"):
        assert not out[name].trusted and len(out[name].warnings) == 1 and not out[name].hashes, name
    assert out["flat"].trusted and out["flat"]["values"] == ["x"]


def test_untrusted_policy_and_incomplete_keys_authorise_nothing(spark):
    text = f"-----BEGIN EC PRIVATE KEY----- {KEY}"
    hits = detect(spark.createDataFrame([("r", "docs/a.md", text), ("s", "docs/a.md", text)], "repo string, path string, text string"), "text", ["repo", "path"])
    policy = spark.createDataFrame(
        [("r", True, [], ["-----BEGIN EC PRIVATE KEY-----", KEY], [], []), ("s", False, [], [KEY], [], ["docs/"])],
        "repo string, trusted boolean, pattern_ids array<string>, values array<string>, hashes array<string>, paths array<string>",
    )
    out = {(r.repo, r.pattern_id): r.reason for r in allow_decision(hits, policy).collect()}
    assert out == {("r", "stripe-live"): "policy: value", ("r", "private-key-incomplete"): None, ("s", "stripe-live"): None, ("s", "private-key-incomplete"): None}


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("docs/", "docs/a/b.md", True), ("docs/", "docs", True), ("docs/", "docs2/a", False), ("docs/**/*.md", "docs/a.md", True), ("docs/**/*.md", "docs/x/y/a.md", True),
        ("*.md", "a/b.md", False), ("**", "any/thing", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("./a.b", "a.b", True), ("a.b", "aXb", False), ("src/*/**", "src/x/y", False),
        ("a+(b)/*", "a+(b)/c", True), ("x\\y", "x/y", True), ("", "a", False),
    ],
)
def test_globs_agree_in_both_forms(spark, pattern, path, expected):
    row = spark.createDataFrame([(path, pattern)], "path string, g string").select(
        glob_match(F.col("path"), pattern).alias("a"), glob_match(F.col("path"), F.col("g")).alias("b")
    ).first()
    assert (row.a, row.b) == (expected, expected), glob_literal(pattern)


def test_files_are_read_decoded_and_bounded(spark):
    root = tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")
    os.makedirs(f"{root}/sub")
    contents = {"a.txt": "plain é".encode(), "sub/le.txt": b"\xff\xfe" + f"key {KEY}".encode("utf-16-le"), "be.txt": b"\xfe\xff" + "hé".encode("utf-16-be"), "bin.dat": b"PK\x00\x01", "bad.txt": b"ok \xff\xfe\xfa end"}
    for name, data in contents.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    out = {r.path: r for r in files_source.decode_content(files_source.read_text_files(spark, root, "r")).collect()}
    assert out["a.txt"].text == "plain é" and out["sub/le.txt"].text == f"key {KEY}" and out["be.txt"].text == "hé"
    assert out["bin.dat"].is_binary and out["bin.dat"].text == "PK\x00\x01" and out["bad.txt"].text.startswith("ok �")
    big = spark.createDataFrame([(bytearray(b"h" * 30 + b"m" * 100 + b"t" * 30),)], "content binary")
    row = files_source.decode_content(big, max_bytes=100, chunk=30).first()
    assert row.is_partial and row.text == "h" * 30 + "\n" + "t" * 30


def test_block_comments_keep_line_numbers(spark):
    text = "code one();\n/* open\n import x\n still */ after();\n/* same line */ dropped();\n# note\n  spaced    out();\n}\n"
    df = spark.createDataFrame([(text,)], "t string")
    lines = [(x.norm, x.line) for x in df.select(normalized_lines(F.col("t")).alias("l")).first().l]
    assert lines == [("code one();", 1), ("after();", 4), ("spaced out();", 7)]


def test_duplicate_blocks_against_brute_force(spark):
    block = [f"call_{i}(x);" for i in range(20)]
    docs = [(1, "\n".join(["start();", *block, "end_a();"])), (2, "\n".join([*block, "other();"])), (3, "\n".join(["first();", "second();", *block])), (4, "alone();")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    blocks = {r.doc_id: (r.line_from, r.line_to) for r in D.merge_blocks(D.hot_members(D.line_windows(df, "text", ["doc_id"])), ["doc_id"]).collect()}
    assert blocks == {1: (2, 21), 2: (1, 20), 3: (3, 22)}


def test_torn_ledger_lines_do_not_hide_later_rows(spark):
    good = "2024-01-01T00:00:00Z\tsrc\t2024-01-01\t5\tx\t1\t1\tref\t1\t1"
    df = spark.createDataFrame([("measured_at_utc\tsource",), (good,), ("2024-01-01T00:0",), (good.replace("-01\t5", "-02\t6") + "\r",), ("",)], "value string")
    out = A.parse_ledger(df).collect()
    assert [(r.ok, r.views, r.unique_views) for r in out] == [(True, 5, 0), (False, None, None), (True, 6, 0)]
    assert out[1].bad_line == "2024-01-01T00:0"


def test_ledger_append_is_idempotent_and_all_or_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-ledger-", dir="/tmp") + "/ledger"
    at = datetime.datetime(2024, 2, 1, 6)
    rows = spark.createDataFrame([("r", at, "s", f"2024-01-0{d}", d) for d in range(1, 5)], "repo string, measured_at_utc timestamp, source string, day string, views long")
    A.append_ledger(rows, folder, complete=False)
    assert not os.path.exists(folder)
    A.append_ledger(rows.where("views < 3"), folder)
    A.append_ledger(rows, folder)
    A.append_ledger(rows, folder)
    A.append_ledger(rows.withColumn("measured_at_utc", F.expr("measured_at_utc + interval 1 day")), folder)
    assert spark.read.parquet(folder).count() == 8


def test_no_raw_value_reaches_a_sink(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b")], "id int, text string")
    with pytest.raises(ValueError):
        assert_no_raw(detect(df, "text", ["id"]))
    with pytest.raises(ValueError):
        assert_no_raw(df.select(F.array(F.struct(F.col("text").alias("raw"))).alias("hits")))
    folder = tempfile.mkdtemp(prefix="spark-proofs-", dir="/tmp") + "/proofs"
    write_proofs(proof_record(gate(df, "text", redact=True), ["id"]), folder)
    stored = spark.read.parquet(folder)
    assert stored.count() == 1 and KEY not in str(stored.collect())


def test_summary_is_bounded_and_leaks_nothing(spark):
    checks = spark.createDataFrame([("run", i, i, "fail" if i % 2 else "warn", f"Check | {i}", f"detail {KEY}", 30) for i in range(40)], "run_id string, check int, pos int, status string, label string, detail string, findings int")
    findings = spark.createDataFrame(
        [("run", i, n, f"{KEY}.ts" if n == 0 else f"src/{n}.ts", n, "fp", "m @user <b>x</b>", "a" * 64, ["fix it", f"remove {KEY}"]) for i in range(40) for n in range(30)],
        "run_id string, check int, finding long, file string, start_line int, fp string, message string, auth_id string, remediation array<string>",
    )
    body = R.summary_markdown(checks, findings, R.verdict(checks)).first().body
    assert len(body) <= 12000 and KEY not in body and "(a path that looks like" in body and "@user" not in body and "<b>" not in body
    assert sum(line.startswith("| FAIL |") for line in body.split("\n")) == 20 + 3 and "Checks not listed here: 37" in body


def test_sarif_refuses_key_material(spark):
    checks = spark.createDataFrame([("run", 1, 1, "fail", "Secret scan", "d")], "run_id string, check int, pos int, status string, label string, detail string")
    cols = "run_id string, check int, finding long, rule string, pattern_id string, label string, file string, fp string, auth_id string, start_line int, start_column int, end_column int, message string"
    good = spark.createDataFrame([("run", 1, 1, None, "aws", "AWS", "a b/é#.ts", "fp", "id", 3, 2, None, f"found {KEY}")], cols)
    doc = json.loads(R.to_sarif(R.sarif_results(checks, good), R.verdict(checks)).first().sarif)
    result = doc["runs"][0]["results"][0]
    location = result["locations"][0]["physicalLocation"]
    assert location["artifactLocation"]["uri"] == "a%20b/%C3%A9%23.ts" and location["region"] == {"startLine": 3, "startColumn": 2}
    assert KEY not in json.dumps(doc) and doc["runs"][0]["invocations"][0]["exitCode"] == 1
    assert doc["runs"][0]["tool"]["driver"]["rules"][0]["properties"]["security-severity"] == "8.0"


def test_freeze_refusals(spark):
    rows = [
        ("ok", 1, "c1", ["p"], True, True, None, "p"), ("late", 1, "c1", ["p"], True, True, None, "p"), ("late", 2, "c2", ["c1"], True, True, None, "x"),
        ("merge", 1, "c1", ["p", "q"], True, True, None, "p"), ("mixed", 1, "c1", ["p"], True, False, None, "p"), ("gone", 1, "c1", ["p"], False, True, None, "p"),
        ("wrong", 1, "c1", ["p"], True, True, None, "z"), ("root", 1, "c1", [], True, True, None, "p"),
    ]
    df = spark.createDataFrame(rows, "repo string, seq long, commit string, parents array<string>, present boolean, dedicated boolean, contract_error string, baseline string")
    out = {r.repo: r for r in S.original_freeze(df).collect()}
    assert out["ok"].freeze_commit == "c1" and not out["ok"].later_change and out["late"].later_change and out["late"].freeze_commit == "c1"
    assert all(out[n].error and out[n].freeze_commit is None for n in ("merge", "mixed", "gone", "wrong", "root"))


def test_acceptance_cases(spark):
    """The judges of the scoreboard, each on a small repo."""
    files = spark.createDataFrame(
        [
            ("leak", "src/config.js", f'export const stripe = "{KEY}";', True), ("build-leak", "dist/bundle.js.map", f'{{"sourcesContent":["const k=\'{KEY}\';"]}}', True),
            ("env", ".env", "A=1", True), ("clean", "src/app.js", "export const x = 1;", True),
        ],
        "repo string, path string, text string, tracked boolean",
    )
    blocked = detect(files, "text", ["repo", "path"]).withColumn("allowed", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    found = findings_by_file(blocked)
    env = S.tracked_env_status(files.withColumn("ignored", F.lit(False))).select("repo", "status")
    dirty = S.dirty_status(spark.createDataFrame([("dirty", "src/app.js", " M")], "repo string, path string, code string")).select("repo", "status")
    checks = found.select("repo", F.lit("fail").alias("status")).unionByName(env).unionByName(dirty).withColumnRenamed("repo", "run_id")
    observed = R.verdict(checks).select(F.col("run_id").alias("id"), F.col("verdict").alias("observed"))
    expected = spark.createDataFrame([("leak", "NO-GO"), ("build-leak", "NO-GO"), ("env", "NO-GO"), ("clean", "GO"), ("dirty", "NO-GO")], "id string, expected string")
    board = {r.id: r.state for r in R.scoreboard(expected, observed).collect()}
    assert board == dict.fromkeys(board, "GREEN") and len(board) == 5
    assert KEY not in str(found.collect()) and found.where("path like '%bundle.js.map'").count() == 1


def test_server_map_names_both_routes(spark):
    text = "const app = require('express')();\napp.get('/items', (req, res) => res.json([]));\napp.post('/items', (req, res) => res.status(201).end());\n"
    df = spark.createDataFrame([("api", "server.js", text)], "repo string, path string, text string")
    routes = {(r.url, tuple(r.methods)): r for r in M.express_routes(df).collect()}
    assert set(routes) == {("/items", ("GET",)), ("/items", ("POST",))}
    post = M.express_routes(df).where(M.is_dangerous()).collect()
    assert [tuple(r.methods) for r in post] == [("POST",)]


def test_contract_key_order_and_first_error(spark):
    sha = "a" * 40
    cases = {
        "{": "json:broken", '{"schemaVersion":1.5}': "schemaVersion:not-an-integer", '{"schemaVersion":1,"goal":"g","allow":["a"],"deny":"x"}': "deny:not-an-array",
        '{"schemaVersion":1,"goal":"g","allow":["/abs"]}': "allow:unsafe-glob", '{"schemaVersion":1,"goal":"g","allow":["a",1]}': "allow:empty-glob",
        '{"schemaVersion":1,"goal":"g","allow":["a"],"baselineRef":"main"}': "baselineRef", '{"schemaVersion":1,"goal":"g","allow":["a"],"baselineCommit":"abc"}': "baselineCommit:malformed",
        f'{{"schemaVersion":1,"goal":"g","allow":["a"],"baselineCommit":"{sha}","exec":1}}': 'executable-field:exec',
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("want", S.contract_valid(F.col("text")).alias("v")).collect():
        assert r.want in (r.v.error or ""), r


def test_findings_are_shuffled_narrow_and_numbered_by_their_checks(spark):
    checks = spark.createDataFrame(
        [(1, 7, 3, "fail", "B", "own"), (1, 8, 1, "warn", "A", "none"), (1, 9, 2, "pass", "C", "left out"), (2, 5, 1, "fail", "A", "own")],
        "run_id int, check int, pos int, status string, label string, detail string",
    )
    narrow = spark.createDataFrame([(7, 11), (7, 10), (9, 1), (5, 4), (5, 6), (5, 5)], "check int, finding long")

    def described(rows):
        none = {c: F.lit(None).cast("string") for c in ("f_rule", "f_label", "pattern_id", "fp", "auth_id")} | {c: F.lit(None).cast("int") for c in ("start_line", "start_column", "end_column")}
        name = F.concat(F.lit("f"), F.col("finding").cast("string"))
        return rows.withColumns(none | {"file": name, "message": name})

    findings = R.Findings(narrow, ("check",), described)
    results = R.sarif_results(R.numbered_checks(checks, findings), findings)
    assert sorted((r.run_id, r.number, r.message) for r in results.collect()) == [(1, 1, "A: none"), (1, 2, "f10"), (1, 3, "f11"), (2, 1, "f4"), (2, 2, "f5"), (2, 3, "f6")]
    parts = {(r.run_id, r.part): json.loads(r.sarif)["runs"][0] for r in R.to_sarif(results, R.verdict(checks), part_rows=2).collect()}
    assert {k: [x["message"]["text"] for x in v["results"]] for k, v in parts.items()} == {(1, 0): ["A: none", "f10"], (1, 1): ["f11"], (2, 0): ["f4", "f5"], (2, 1): ["f6"]}
    assert [x["id"] for x in parts[1, 0]["tool"]["driver"]["rules"]] == ["check/a", "check/b"]
    dealt = R.to_sarif(R.sarif_results(R.numbered_checks(checks, findings), findings, part_rows=2), R.verdict(checks), part_rows=2)
    assert {(r.run_id, r.part): json.loads(r.sarif)["runs"][0] for r in dealt.collect()} == parts
