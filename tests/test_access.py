"""Policy state: the joined result against an event-by-event fold on random histories."""

import random

from wardline.operators.access import ddl_events, policy_findings, policy_state, sequence_events
from wardline.operators.lineage import lifetimes
from wardline.streaming import policies as streamed
from wardline.streaming.policies import fold_table, new_table, newest_policy_state, policy_state_stream

SCHEMA = (
    "repo string, path string, index long, line int, kind string, table string, to_table string, enabled boolean, policy string, rename_to string, for_cmd string,"
    " roles array<string>, using_true boolean, check_true boolean, has_using boolean, has_check boolean, using_ok boolean, check_ok boolean, schema string, to_schema string, seq long"
)
FIELDS = [f.strip().split()[0] for f in SCHEMA.split(",")]


def walk(events: list[dict]) -> dict:
    """The tables of a repo by name after its events, one event after the other."""
    tables: dict = {}

    def rename(old, new):
        if old != new and old in tables:
            tables[new] = tables.pop(old)

    for ev in events:
        kind, name = ev["kind"], ev["table"]
        if kind == "drop_table":
            tables.pop(name, None)
        elif kind in ("rename_table", "set_schema"):
            rename(name, ev["to_table"])
        elif kind in ("drop_schema", "rename_schema"):
            for full in [n for n in tables if n.startswith(ev["schema"] + ".")]:
                if kind == "drop_schema":
                    del tables[full]
                else:
                    rename(full, ev["to_schema"] + full[len(ev["schema"]) :])
        elif name is not None and (kind != "drop_policy" or name in tables):
            fold_table(tables.setdefault(name, new_table(kind)), ev["seq"], ev)
    for name, table in tables.items():
        # a statement without a table counts for the tables that are public at the end
        late = [ev["seq"] for ev in events if ev["kind"] == "not_checkable" and ev["table"] is None]
        table["gap"] |= name.startswith("public.") and table["secure_seq"] is not None and any(s >= table["secure_seq"] for s in late)
    return tables


def history(seed: int, size: int) -> list[dict]:
    rng = random.Random(seed)
    tables = ["public.a", "public.b", "app.a", "app.c"]
    kinds = ["create_table"] * 3 + ["rls"] * 4 + ["create_policy"] * 4 + ["alter_policy"] * 2 + ["drop_policy", "drop_table", "rename_table", "set_schema", "drop_schema", "rename_schema", "not_checkable", "rename_policy"]
    out = []
    for seq in range(1, size + 1):
        kind = rng.choice(kinds)
        ev = dict.fromkeys(FIELDS)
        ev.update(repo=f"r{seed}", path="m.sql", index=seq, line=seq, seq=seq, kind="alter_policy" if kind == "rename_policy" else kind, table=rng.choice(tables))
        if kind == "rls":
            ev["enabled"] = rng.random() < 0.7
        elif kind in ("create_policy", "alter_policy", "drop_policy", "rename_policy"):
            ev["policy"] = rng.choice(["P", "q", "r"])
            if kind == "rename_policy":
                ev["rename_to"] = rng.choice(["P", "q", "r"])
            elif kind != "drop_policy":
                ev.update(
                    for_cmd=rng.choice(["ALL", "SELECT", "INSERT", "UPDATE", "DELETE"]), roles=rng.choice([["public"], ["service_role"], ["anon", "postgres"]]),
                    has_using=rng.random() < 0.7, has_check=rng.random() < 0.5, using_ok=rng.random() < 0.9, check_ok=rng.random() < 0.9,
                )
                ev["using_true"], ev["check_true"] = ev["has_using"] and rng.random() < 0.5, ev["has_check"] and rng.random() < 0.5
                if kind == "alter_policy" and rng.random() < 0.5:
                    ev["roles"] = None
        elif kind == "rename_table":
            ev["to_table"] = ev["table"].split(".")[0] + "." + rng.choice("abc")
        elif kind == "set_schema":
            ev["to_table"] = rng.choice(["public", "app"]) + "." + ev["table"].split(".")[1]
        elif kind in ("drop_schema", "rename_schema"):
            ev.update(table=None, schema=rng.choice(["public", "app"]))
            if kind == "rename_schema":
                ev["to_schema"] = "app" if ev["schema"] == "public" else "public"
            elif rng.random() < 0.6:
                ev.update(kind="create_table", table="public.a", schema=None)
        elif kind == "not_checkable" and rng.random() < 0.6:
            ev["table"] = None
        out.append(ev)
    return out


def test_joined_state_equals_the_fold(spark):
    histories = [history(seed, 30) for seed in range(40)]
    rows = [tuple(ev[f] for f in FIELDS) for h in histories for ev in h]
    tables, policies = policy_state(spark.createDataFrame(rows, SCHEMA))
    got = {(r.repo, r.table): (r.rls, r.secure_seq) for r in tables.collect()}
    gaps = {(r.repo, r.table): r.gap is not None for r in tables.collect()}
    held = {}
    for r in policies.collect():
        held.setdefault((r.repo, r.table), {})[r.policy.lower()] = (r.for_cmd, sorted(r.roles), r.using_true, r.check_true, r.has_check)
    want, want_gaps, want_held = {}, {}, {}
    for h in histories:
        for name, t in walk(h).items():
            key = (h[0]["repo"], name)
            want[key], want_gaps[key] = (t["rls"], t["secure_seq"]), t["gap"]
            if t["policies"]:
                want_held[key] = {k: (p["for_cmd"], sorted(p["roles"]), p["using_true"], p["check_true"], p["has_check"]) for k, p in t["policies"].items()}
    assert got == want
    assert held == want_held
    assert gaps == want_gaps
    assert len(want) > 40 and len(want_held) > 10 and 3 < sum(want_gaps.values()) < len(want_gaps) - 3


def test_lifetimes_over_many_chunks(spark):
    """Random moves, each name's lifetime found in chunks of three operations, continued in two runs, against a walk."""
    rng, rows, want_alive, want_touch = random.Random(8), [], {}, {}
    for g in range(25):
        state: dict = {}
        for seq in range(60):
            op = rng.choice(["ensure"] * 5 + ["use", "end", "move", "move", "end_all", "move_all"])
            name, to = (f"{rng.choice('ab')}.{rng.choice('xyz')}" for _ in range(2))
            if op in ("end_all", "move_all"):
                name, to = rng.choice([("a", "b"), ("b", "a"), ("a", "a")])
            to = to if op in ("move", "move_all") else None
            rows.append((g, seq, op, name, to))
            pairs = [(n, to + n[1:]) for n in ("a.x", "a.y", "a.z", "b.x", "b.y", "b.z") if n[0] == name] if op == "move_all" else [(name, to)] if op == "move" else []
            for old, new in pairs:
                if old != new and old in state:
                    state[new] = state.pop(old)
            if op == "ensure":
                state.setdefault(name, (g, seq))
            if op in ("ensure", "use") and name in state:
                want_touch[g, seq] = state[name]
            if op == "end":
                state.pop(name, None)
            if op == "end_all":
                state = {n: v for n, v in state.items() if n[0] != name}
        want_alive.update({(g, n): v for n, v in state.items()})
    ops = spark.createDataFrame(rows, "g long, seq long, op string, name string, to string")

    def check(found, alive):
        entities = {}
        for r in sorted(found, key=lambda r: r.seq):
            if r.role in ("ensure", "use") and (r.g, r.seq) in want_touch:
                assert entities.setdefault((r.g, r.entity), want_touch[r.g, r.seq]) == want_touch[r.g, r.seq]
        seen = {(r.g, r.seq) for r in found if r.role == "ensure"}
        assert seen == {(g, seq) for g, seq, op, *_ in rows if op == "ensure"}
        assert {(r.g, r.name): entities[r.g, r.entity] for r in alive} == want_alive

    found, alive = lifetimes(ops, ["g"], by_schema=True, chunk=3)
    check(found.collect(), alive.collect())
    first, held = lifetimes(ops.where("seq < 31"), ["g"], by_schema=True, chunk=4, label="/1")
    second, last = lifetimes(ops.where("seq >= 31"), ["g"], by_schema=True, chunk=4, start=held, label="/2")
    check(first.collect() + second.collect(), last.collect())


def test_the_stream_equals_the_walk_after_any_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "COMPACT", 3)
    histories = [history(seed, 40) for seed in range(12)]
    # one repo has a third of all events
    histories[0] = history(0, 220)
    row = lambda ev: tuple(ev[f] for f in FIELDS)
    for k in range(7):
        part = [row(ev) for h in histories for ev in h[len(h) * k // 7 : len(h) * (k + 1) // 7]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        policy_state_stream(stream, str(tmp_path / "state"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        if k in (0, 4, 6):
            want = {}
            for h in histories:
                for name, t in walk(h[: len(h) * (k + 1) // 7]).items():
                    want[h[0]["repo"], name] = (t["rls"], len(t["policies"]), t["secure_seq"] is not None, t["gap"])
            assert {(r.repo, r.table): (r.rls, r.policies, r.secured, r.gap) for r in newest_policy_state(spark, str(tmp_path / "state")).collect()} == want, k


def test_a_batch_of_the_stream_takes_few_jobs(spark, tmp_path):
    """Each job has its cost, however few the events are."""
    row = lambda ev: tuple(ev[f] for f in FIELDS)
    for k in range(2):
        spark.createDataFrame([row(ev) for s in range(12) for ev in history(s, 40)[20 * k : 20 * k + 20]], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = policy_state_stream(stream, str(tmp_path / "state"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 1
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) < 2 * 60


SQL = """-- CREATE TABLE ghost (x);
CREATE TABLE IF NOT EXISTS Public.Items (id int, t text default 'DROP TABLE items;');
ALTER TABLE items ENABLE ROW LEVEL SECURITY;
CREATE POLICY own ON items FOR UPDATE TO authenticated USING ((auth.uid() = user_id));
CREATE TABLE open_one (id int);
CREATE TABLE writable (id int); ALTER TABLE writable ENABLE ROW LEVEL SECURITY;
CREATE POLICY "any" ON writable FOR ALL USING ((true));
DROP TABLE IF EXISTS old_a, "Old".b CASCADE;
"""
LATER = """/* comment ; with semicolon */
DO $$ BEGIN
  EXECUTE 'alter table items disable row level security';
END $$;
CREATE POLICY torn ON fresh FOR INSERT WITH CHECK (true;
"""


def test_findings_of_migration_files(spark):
    files = spark.createDataFrame(
        [("r", "supabase/migrations/001.sql", SQL), ("r", "supabase/migrations/002.sql", LATER), ("r", "tests/supabase/migrations/9.sql", SQL), ("s", "docs/x.sql", SQL)],
        "repo string, path string, sql string",
    )
    events = sequence_events(ddl_events(files)).cache()
    kinds = [r.kind for r in events.orderBy("seq").collect()]
    assert kinds == ["create_table", "rls", "create_policy", "create_table", "create_table", "rls", "create_policy", "drop_table", "drop_table", "not_checkable", "create_policy"]
    found = {(r.table, r.rule): (r.severity, r.path[-7:], r.line) for r in policy_findings(*policy_state(events)).collect()}
    assert found == {
        ("public.items", "lineage-not-checkable"): ("fail", "002.sql", 2),
        ("public.open_one", "rls-disabled"): ("fail", "001.sql", 5),
        ("public.writable", "permissive-write-policy"): ("fail", "001.sql", 7),
        ("public.fresh", "policy-not-checkable"): ("warn", "002.sql", 5),
    }


def test_files_are_dealt_before_they_are_parsed_and_parsed_once(spark):
    files = spark.createDataFrame([("r", "supabase/migrations/1.sql", "create table a (id int);")], "repo string, path string, sql string")
    plan = ddl_events(files)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    parsed = [i for i, line in enumerate(plan) if "regexp_extract_all" in line]
    assert parsed and max(parsed) < dealt
    assert not any("regexp_extract" in line.split("Filter", 1)[1] for line in plan if "Filter (" in line)
