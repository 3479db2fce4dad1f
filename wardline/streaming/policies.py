"""Access-policy state on a stream of events, micro-batch by micro-batch.

Tables are told by their names, keyed by (repo, name), so that a repo's tables are spread over all tasks. In a batch the events of a
name that nothing renames are folded in one pass. Names that move, alone or with their schema, are first turned into lifetimes by the
maps of ``operators/lineage.py``, then the events of each lifetime are folded and its state is put under the name that it ends with.
What exists is kept as tables of changes in a shared folder, one folder per batch, which a replayed batch overwrites; every
``COMPACT`` batches all changes are written as one. Each batch is a few dozen stages, whatever the events are.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardline.functions import fixed_values as V
from wardline.operators.access import table_ops
from wardline.operators.lineage import WIDE, moved_lifetimes, schema_of
from wardline.session import spread

COMPACT = 16
#: State tables: their keys and values. A NULL value takes the row away.
STATES = {
    "named": ("repo string, name string", "state string"),
    "loose": ("repo string", "last_seq long"),
}
VIEW = "rls boolean, policies int, secured boolean, gap boolean"
#: Of an event, where it stands and what it names; the fold needs the rest.
PLACE = ("repo", "seq", "path", "index", "line", "table", "to_table", "schema", "to_schema")


def open_to_clients(policy: dict) -> bool:
    """Whether a client role may write any row: literal true where the policy's command looks."""
    looks = {"INSERT": policy["check_true"] or (policy["using_true"] and not policy["has_check"]), "DELETE": policy["using_true"]}
    either = policy["using_true"] or policy["check_true"]
    found = looks.get(policy["for_cmd"], either if policy["for_cmd"] in ("UPDATE", "ALL") else False)
    return bool(found) and any(r.lower() not in V.SERVER_ROLES for r in policy["roles"])


def new_table(kind: str) -> dict:
    return {"rls": False if kind == "create_table" else None, "policies": {}, "secure_seq": None, "gap": False}


def _policy_after(held: dict | None, ev: dict) -> dict:
    """A policy after a create or an alter statement; an alter only sets what it names."""
    created = ev["kind"] == "create_policy"
    policy = dict(held) if held and not created else {"for_cmd": "ALL", "roles": ["public"], "using_true": False, "check_true": False, "has_check": False}
    if created:
        policy["for_cmd"] = ev["for_cmd"]
    if ev.get("roles") is not None:
        policy["roles"] = list(ev["roles"])
    if created or ev.get("has_using"):
        policy["using_true"] = bool(ev.get("using_true") and ev.get("using_ok"))
    if created or ev.get("has_check"):
        policy["check_true"], policy["has_check"] = (bool(ev.get(f) and ev.get("check_ok")) for f in ("check_true", "has_check"))
    return policy


def fold_table(table: dict, seq: int, ev: dict) -> None:
    """One event on the state of a table's lifetime, changed in place."""
    kind, policies = ev["kind"], table["policies"]
    name = (ev.get("policy") or "").lower()
    unreadable = kind == "not_checkable"
    if kind == "rls":
        table["rls"] = bool(ev["enabled"])
    elif kind == "drop_policy":
        policies.pop(name, None)
    elif kind == "alter_policy" and ev.get("rename_to"):
        if name in policies:
            policies[ev["rename_to"].lower()] = policies.pop(name)
    elif kind in ("create_policy", "alter_policy"):
        policies[name] = _policy_after(policies.get(name), ev)
        unreadable = kind == "alter_policy" and not (ev.get("using_ok") and ev.get("check_ok"))
    if unreadable and table["secure_seq"] is not None:
        table["gap"] = True
    if table["secure_seq"] is None and table["rls"] and not all(open_to_clients(p) for p in policies.values()):
        table["secure_seq"] = seq


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _after(table: dict | None, seq: int, event: str) -> dict | None:
    ev = json.loads(event)
    if table is None and ev["kind"] == "drop_policy":
        return None  # nothing to drop it from
    table = table or new_table(ev["kind"])
    fold_table(table, seq, ev)
    return table


def _batches(rows, schema: str):
    import pyarrow as pa

    fields = [f.split() for f in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    while part := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*part, strict=True), fields, strict=True)], names=[n for n, _ in fields])


FOLDED = "repo string, name string, state string"


def _fold(batches):
    """(repo, entity, rank, seq, state, event, name) in order: a lifetime's state, its events, the name that it has at the end, if any.

    Gives the states of the names.
    """

    def folded():
        for (repo, _), rows in itertools.groupby(_rows(batches), lambda r: r[:2]):
            table = None
            for _, _, rank, seq, state, event, name in rows:
                if rank == 0:
                    table = json.loads(state)
                elif rank == 1:
                    table = _after(table, seq, event)
                elif table is not None:
                    yield repo, name, json.dumps(table, sort_keys=True)

    return _batches(folded(), FOLDED)


SETTLED = "repo string, name string, seq long, op string, was string, state string, event string"


def _settle(batches):
    """(repo, name, rank, seq, op, wide, was, event) in order: whether the name moves (rank 0), its state (rank 1), its events.

    A name that stays is folded: one ``settled`` row with the state before and after, NULL where it does not exist. The rows of a name
    that moves are given on.
    """

    def settled():
        for (repo, name), rows in itertools.groupby(_rows(batches), lambda r: r[:2]):
            first = next(rows)
            moves = first[2] == 0 or first[5]
            was = state = table = None
            changed = False
            for _, _, rank, seq, op, _, held, event in itertools.chain([first], rows):
                if rank == 0:
                    continue
                if moves:
                    yield repo, name, seq, op, held, None, event
                elif rank == 1:
                    was = state = held
                else:
                    if not changed and was is not None:
                        table = json.loads(was)
                    changed, table = True, None if op == "end" else _after(table, seq, event)
            if changed:
                state = None if table is None else json.dumps(table, sort_keys=True)
            if not moves and (was is not None or state is not None):
                yield repo, name, None, "settled", was, state, None

    return _batches(settled(), SETTLED)


class PolicyStates:
    """State tables of a stream in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str, batch: int, kind: str) -> str:
        return f"{self.folder}/{name}/{kind}={batch}"

    def read(self, name: str, batch: int, base: int | None = None) -> DataFrame:
        """What exists before this batch: the newest change of each key since ``base``, the last compaction."""
        keys, value = STATES[name]
        schema = f"{keys}, {value}, at long"
        base = max(batch - 1, 0) // COMPACT * COMPACT if base is None else base
        paths = [self._path(name, base, "all")] if base else [self._path(name, 0, "batch")] if batch else []
        paths += [self._path(name, b, "batch") for b in range(base + 1, batch)]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("at")
        column = value.split()[0]
        key = [k.split()[0] for k in keys.split(", ")]
        newest = self.spark.read.schema(schema).parquet(*paths).groupBy(*key).agg(F.max_by(F.struct(column), "at").alias("v"))
        return newest.select(*key, f"v.{column}").where(F.col(column).isNotNull())

    def write(self, name: str, batch: int, changes: DataFrame) -> None:
        changes.withColumn("at", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._path(name, batch, "batch"))
        if batch and batch % COMPACT == 0:
            self.read(name, batch + 1, batch - COMPACT).withColumn("at", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._path(name, batch, "all"))


def _view(state: str, name: str, last_seq: str) -> Column:
    """What a table's state shows, NULL without one; a statement without a table leaves a gap in all public tables secured before it."""
    s = F.from_json(state, "rls boolean, secure_seq long, gap boolean, policies map<string,string>")
    missed = (schema_of(F.col(name)) == "public") & (F.col(last_seq) >= s["secure_seq"])
    shown = F.struct(
        s["rls"].alias("rls"), F.size(s["policies"]).alias("policies"), s["secure_seq"].isNotNull().alias("secured"), (s["gap"] | F.coalesce(missed, F.lit(False))).alias("gap")
    )
    return F.when(F.col(state).isNotNull(), shown)


def _moved(settled: DataFrame, moves: DataFrame) -> DataFrame:
    """``repo, name, was, state`` of the names that move: the lifetimes' events are folded, then put under the names at the end."""
    none = F.lit(None).cast("string")
    # an end that no lifetime that is born has
    begun = settled.where("op = 'held'").select("repo", "name", F.concat("name", F.lit("@")).alias("entity"), "was")
    # a lifetime's events come back with it
    ops = settled.where("event is not null").select("repo", "seq", "op", "name", F.col("event").alias("to")).unionByName(moves)
    found, _ = moved_lifetimes(ops, begun.drop("was"), ["repo"], by_schema=True, with_names=True)
    zero, named = F.lit(0).cast("long"), F.col("role") == "name"
    course = begun.select("repo", "entity", F.lit(0).alias("rank"), zero.alias("seq"), F.col("was").alias("state"), none.alias("event"), none.alias("name"))
    found = found.where("role in ('ensure', 'use', 'name')").select(
        "repo", "entity", F.when(named, 2).otherwise(1).alias("rank"), F.coalesce("seq", zero).alias("seq"), none.alias("state"),
        F.when(~named, F.col("body")).alias("event"), F.when(named, F.col("body")).alias("name"),
    )
    course = course.unionByName(found)
    after = course.repartition("repo", "entity").sortWithinPartitions("repo", "entity", "rank", "seq").mapInArrow(_fold, FOLDED)
    both = begun.select("repo", "name", "was", none.alias("state")).unionByName(after.select("repo", "name", none.alias("was"), "state"))
    return both.groupBy("repo", "name").agg(F.max("was").alias("was"), F.max("state").alias("state"))


def policy_state_stream(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Keep the policy state of each repo up to date from a stream of sequenced events.

    After each micro-batch the state equals that of ``policy_state`` over all events so far. Events of a repo must arrive in the order of
    seq from batch to batch; inside a batch any order will do. Changes are written to ``folder/changes``, a dropped table as NULLs.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        states = PolicyStates(spark, folder)
        rows = rows.withColumn("repo", F.col("repo").cast("string"))
        body = F.to_json(F.struct(*[c for c in rows.columns if c not in PLACE]))
        # a batch may be one file, and so one task
        rows = spread(rows, "repo", "seq").select("repo", "seq", "kind", "table", "to_table", "schema", "to_schema", body.alias("event")).persist()
        kept = [rows]
        try:
            ops = table_ops(rows, "event")
            wide, moves = F.col("op").isin(*WIDE), F.col("op") == "move"
            loose = F.max(F.when(F.expr("kind = 'not_checkable' and table is null"), F.col("seq")))
            repos = rows.groupBy("repo").agg(loose.alias("loose")).join(states.read("loose", batch).withColumnRenamed("last_seq", "last_was"), "repo", "left")
            repos = repos.select("repo", "loose", "last_was", F.coalesce("loose", "last_was").alias("last_now")).persist()
            kept.append(repos)
            repos.count()  # its true size tells whether it is broadcast
            has_wide, has_moves = ops.agg(F.bool_or(wide), F.bool_or(moves)).first()
            none = F.lit(None).cast("string")
            names = F.when(moves, F.array_compact(F.array("name", "to"))).otherwise(F.array("name"))
            entries = ops.where(~wide).select("repo", F.explode(names).alias("name"), F.when(moves, 0).otherwise(2).alias("rank"), "seq", "op", none.alias("was"), "event").where("name is not null")
            held = states.read("named", batch).join(repos, "repo", "left_semi")
            entries = entries.unionByName(held.select("repo", "name", F.lit(1).alias("rank"), F.lit(-1).cast("long").alias("seq"), F.lit("held").alias("op"), F.col("state").alias("was"), none.alias("event")))
            if has_wide:
                schemas = ops.where(wide).select("repo", F.explode(F.array_compact(F.array("name", "to"))).alias("_s"), F.lit(True).alias("wide")).distinct()
                entries = entries.withColumn("_s", schema_of(F.col("name"))).join(schemas, ["repo", "_s"], "left")
            else:
                entries = entries.withColumn("wide", F.lit(False))
            entries = entries.repartition("repo", "name").sortWithinPartitions("repo", "name", "rank", "seq")
            settled = entries.select("repo", "name", "rank", "seq", "op", "wide", "was", "event").mapInArrow(_settle, SETTLED)
            after = settled
            if has_wide or has_moves:
                settled = settled.persist()
                kept.append(settled)
                after = settled.where("op = 'settled'").select("repo", "name", "was", "state").unionByName(_moved(settled, ops.where(wide | moves).drop("event")))
            after = after.select("repo", "name", "was", "state").join(repos, "repo").persist()
            kept.append(after)
            other = ~F.col("was").eqNullSafe(F.col("state"))
            states.write("named", batch, after.where(other).select("repo", "name", "state"))
            states.write("loose", batch, repos.where("loose is not null").select("repo", F.col("loose").alias("last_seq")))
            shown = after.where(other | ~F.col("last_was").eqNullSafe(F.col("last_now")))
            shown = shown.select("repo", F.col("name").alias("table"), _view("was", "name", "last_was").alias("_old"), _view("state", "name", "last_now").alias("v"))
            changed = shown.where(~F.col("_old").eqNullSafe(F.col("v"))).select("repo", "table", "v.*", F.lit(batch).cast("long").alias("batch"))
            changed.write.mode("overwrite").parquet(f"{folder}/changes/part={batch}")
        finally:
            for frame in kept:
                frame.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def newest_policy_state(spark: SparkSession, folder: str) -> DataFrame:
    """``repo, table, rls, policies, secured, gap`` of the tables that exist after the batches so far."""
    changes = spark.read.schema(f"repo string, table string, {VIEW}, batch long").parquet(f"{folder}/changes")
    columns = [f.split()[0] for f in VIEW.split(", ")]
    newest = changes.groupBy("repo", "table").agg(F.max_by(F.struct(*columns), "batch").alias("v"))
    return newest.select("repo", "table", "v.*").where("policies is not null")
