"""Lifetimes of names that are created, dropped and moved, each alone or with all others of its schema.

What a stretch of operations does to the names of a group is a map: to each name the names that it may have had before, in order of
preference, and at last a birth. Such maps compose, so they are summaries that merge: one map per chunk of operations, made in
parallel; one pass over the maps that carries which lifetime stands behind each name; and the chunks again, in parallel, with what
was carried to their start. The number of stages does not depend on the operations. Names that never move do not take part: their
lifetimes are numbered by their drops.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.running import running

#: Operations of a group that one map sums up.
CHUNK = 1 << 14

WIDE = ("end_all", "move_all")
ROLES = ("ensure", "use", "end", "in")


class Names:
    """The names of a group while operations run over them.

    A value is a list of candidates, the first existing one counts: ``["s", name]`` is what stood behind the name at the start,
    ``["b", lifetime]`` begins here and always exists. With ``start`` the values at the start are known and lists have at most one entry.
    """

    def __init__(self, by_schema: bool, start: dict[str, str] | None = None, label: str = ""):
        self.by_schema, self.start, self.label = by_schema, start, label
        self.names: dict[str, dict[str, list]] = {}
        self.schemas: dict[str, list[str]] = {}
        self.reads: set[str] = set()

    def split(self, name: str) -> tuple[str, str]:
        if not self.by_schema:
            return "", name
        schema, _, rest = name.partition(".")
        return schema, rest

    def full(self, schema: str, rest: str) -> str:
        return f"{schema}.{rest}" if self.by_schema else rest

    def look(self, name: str) -> list:
        schema, rest = self.split(name)
        held = self.names.setdefault(schema, {})
        if rest not in held:
            sources = [self.full(s, rest) for s in self.schemas.get(schema, [schema])]
            if self.start is None:
                self.reads.update(sources)
                held[rest] = [["s", s] for s in sources]
            else:
                held[rest] = next(([["b", self.start[s]]] for s in sources if s in self.start), [])
        return held[rest]

    def put(self, name: str, value: list) -> None:
        schema, rest = self.split(name)
        self.names.setdefault(schema, {})[rest] = value

    def ensure(self, name: str, seq: int) -> list:
        value = self.look(name)
        if not value or value[-1][0] != "b":
            self.put(name, [*value, ["b", f"{name}@{seq}{self.label}"]])
        return self.look(name)

    def move(self, old: str, new: str) -> tuple[list, list]:
        """What arrives under the new name, and what it replaces there."""
        coming, there = self.look(old), self.look(new)
        if old == new:
            return [], []
        joined: list = []
        for item in [*coming, *there]:
            if item not in joined:
                joined.append(item)
            if item[0] == "b":
                break
        self.put(new, joined)
        self.put(old, [])
        return coming, there if coming else []

    def apply(self, op: str, name: str, to: str | None, seq: int) -> Iterator[tuple[str, list]]:
        """Run one operation; with a known start, gives (role, value) of every lifetime that it touches."""
        if op in ("ensure", "use", "end"):
            value = self.ensure(name, seq) if op == "ensure" else self.look(name)
            if op == "end":
                self.put(name, [])
            yield op, value
        elif op == "move":
            coming, replaced = self.move(name, to)
            yield "in", coming
            yield "end", replaced
        elif op == "end_all":
            for rest, value in self.names.get(name, {}).items():
                self.names[name][rest] = []
                yield "end", value
            self.schemas[name] = []
        elif op == "move_all" and name != to:
            for rest in {**self.names.get(name, {}), **self.names.get(to, {})}:
                yield from self.apply("move", self.full(name, rest), self.full(to, rest), seq)
            mine, others = self.schemas.get(name, [name]), self.schemas.get(to, [to])
            self.schemas[to] = [*mine, *(s for s in others if s not in mine)]
            self.schemas[name] = []


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: str) -> Iterator:
    import pyarrow as pa

    fields = [f.split() for f in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    while part := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*part, strict=True), fields, strict=True)], names=[n for n, _ in fields])


SUMMARY = "g string, chunk long, kind string, name string, value string"
STARTS = "g string, chunk long, name string, entity string"
FOUND = "g string, seq long, role string, entity string, body string"


def _summaries(by_schema: bool, label: str):
    def work(batches):
        def rows():
            for (g, chunk), ops in itertools.groupby(_rows(batches), lambda r: r[:2]):
                names = Names(by_schema, None, label)
                for _, _, seq, op, name, to in ops:
                    for _ in names.apply(op, name, to, seq):
                        pass
                for name in names.reads:
                    yield g, chunk, "read", name, None
                for schema, sources in names.schemas.items():
                    yield g, chunk, "schema", schema, json.dumps(sources)
                for schema, held in names.names.items():
                    for rest, value in held.items():
                        yield g, chunk, "name", names.full(schema, rest), json.dumps(value)

        return _batches(rows(), SUMMARY)

    return work


def _carry(by_schema: bool):
    """One pass over the maps of a group, in order; holds the names that exist, gives what each chunk reads and what stays at the end."""
    split = Names(by_schema).split
    full = Names(by_schema).full

    def work(batches):
        def rows():
            for g, of_group in itertools.groupby(_rows(batches), lambda r: r[0]):
                state: dict[str, dict[str, str]] = {}

                def at(name, state=state):
                    schema, rest = split(name)
                    return state.get(schema, {}).get(rest)

                for chunk, entries in itertools.groupby(of_group, lambda r: r[1]):
                    schemas, names = {}, {}
                    for _, _, kind, name, value in entries:
                        if kind == "held":
                            schema, rest = split(name)
                            state.setdefault(schema, {})[rest] = value
                        elif kind == "read":
                            if at(name) is not None:
                                yield g, chunk, name, at(name)
                        elif kind == "schema":
                            merged: dict[str, str] = {}
                            for source in reversed(json.loads(value)):
                                merged.update(state.get(source, {}))
                            schemas[name] = merged
                        else:
                            found = (v if tag == "b" else at(v) for tag, v in json.loads(value))
                            names[name] = next((v for v in found if v is not None), None)
                    state.update(schemas)
                    for name, entity in names.items():
                        schema, rest = split(name)
                        if entity is None:
                            state.get(schema, {}).pop(rest, None)
                        else:
                            state.setdefault(schema, {})[rest] = entity
                for schema, held in state.items():
                    for rest, entity in held.items():
                        yield g, -1, full(schema, rest), entity

        return _batches(rows(), STARTS)

    return work


def _resolve(by_schema: bool, label: str):
    def work(batches):
        def rows():
            for (g, chunk), of_chunk in itertools.groupby(_rows(batches), lambda r: r[:2]):
                start, names = {}, None
                for _, _, seq, op, name, to in of_chunk:
                    if chunk < 0:
                        yield g, None, "name", to, name
                    elif op == "start":
                        start[name] = to
                        continue
                    names = names or Names(by_schema, start, label)
                    for role, value in names.apply(op, name, to, seq):
                        if value:
                            yield g, seq, role, value[0][1], to if op in ("ensure", "use") else None

        return _batches(rows(), FOUND)

    return work


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def schema_of(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def lifetimes(
    ops: DataFrame, group: list[str], by_schema: bool = False, chunk: int = CHUNK, start: DataFrame | None = None, label: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Which lifetime does each operation touch, and which names exist at the end?

    ``ops`` is ``(*group, seq, op, name, to)``. ``ensure`` makes a name exist, ``use`` does not, ``end`` drops it, ``move`` renames it to
    ``to`` where it exists, in place of what was there; ``end_all`` and ``move_all`` do so with all names of the schema ``name``. ``seq``
    orders the operations of a group; at most one operation has a seq. ``start`` is ``(*group, name, entity)`` of the names that exist
    before the first operation; ``label`` keeps the lifetimes of several runs apart.

    Returns ``(*group, seq, role, entity)``, one row per lifetime that an operation touches: roles ``ensure`` and ``use``, ``end`` for a
    lifetime that is dropped or replaced, ``in`` for one that arrives under a new name; and ``(*group, name, entity)`` of the names that
    exist at the end, those of ``start`` that nothing touched included.
    """
    if start is None:
        start = ops.where(F.lit(False)).select(*group, "name", F.lit("").alias("entity"))
    wide = F.col("op").isin(*WIDE)
    named = ops.where(~wide).select(*group, F.explode(F.array_compact(F.array("name", "to"))).alias("name"), (F.col("op") == "move").alias("moves"))
    named = named.unionByName(start.select(*group, "name", F.lit(False).alias("moves")))
    tracked = named.groupBy(*group, "name").agg(F.max("moves").alias("moves"))
    if by_schema:
        schemas = ops.where(wide).select(*group, F.explode(F.array_compact(F.array("name", "to"))).alias("_s"), F.lit(True).alias("_wide")).distinct()
        tracked = tracked.withColumn("_s", schema_of(F.col("name"))).join(schemas, [*group, "_s"], "left")
        tracked = tracked.where(F.col("moves") | F.col("_wide"))
    else:
        tracked = tracked.where("moves")
    tracked = tracked.select(*group, "name", F.lit(True).alias("_t"))
    marked, begun = ops.join(tracked, [*group, "name"], "left"), start.join(tracked, [*group, "name"], "left")
    resting = begun.where("_t is null").select(*group, "name", F.col("entity").alias("_held"))
    plain = marked.where(F.col("_t").isNull() & ~wide).select(*group, "seq", "op", "name", (F.col("op") == "end").alias("_end"), F.floor(F.col("seq") / chunk).alias("_chunk"))
    placed = running(plain, [*group, "name"], ["seq"], "_chunk", {"_ends": ("count_if", "_end")}).join(resting, [*group, "name"], "left")
    own = F.coalesce(F.when(F.col("_ends") == 0, F.col("_held")), F.concat(F.col("name"), F.lit("#"), F.col("_ends").cast("string"), F.lit(label)))
    found = placed.select(*group, "seq", F.col("op").alias("role"), own.alias("entity"))
    made, gone = F.max(F.when(F.col("op") == "ensure", F.col("seq"))), F.max(F.when(F.col("op") == "end", F.col("seq")))
    last = plain.groupBy(*group, "name").agg(made.alias("made"), gone.alias("gone"), F.sum(F.col("_end").cast("long")).alias("_ends"))
    last = last.join(resting, [*group, "name"], "full").withColumn("_ends", F.coalesce("_ends", F.lit(0)))
    alive = last.where((F.col("made") > F.coalesce("gone", F.lit(-1))) | (F.col("gone").isNull() & F.col("_held").isNotNull())).select(*group, "name", own.alias("entity"))

    found_moving, left = moved_lifetimes(
        marked.where(F.col("_t") | wide).select(*group, "seq", "op", "name", "to"), begun.where("_t").select(*group, "name", "entity"), group, by_schema, chunk, label
    )
    return found.unionByName(found_moving.drop("body")), alive.unionByName(left)


def moved_lifetimes(
    moving: DataFrame, begun: DataFrame, group: list[str], by_schema: bool = False, chunk: int = CHUNK, label: str = "", with_names: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``lifetimes`` of the names that move or whose schema does, from all operations on them; ``begun`` is what they are at the start.

    What ``to`` holds in an ``ensure`` or a ``use`` is given back beside the lifetime, as ``body``. ``with_names`` puts the names at the
    end into the first frame too, as ``body`` of the role ``name``: who needs both then has the passes made once.
    """
    types = {f.name: f.dataType for f in moving.schema.fields}
    # the group as one string, so that the passes need not know its columns
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    moving = moving.select(key.alias("g"), F.floor(F.col("seq") / chunk).cast("long").alias("chunk"), "seq", "op", "name", "to")
    summaries = _sorted(moving, ["g", "chunk"], ["seq"]).mapInArrow(_summaries(by_schema, label), SUMMARY)
    held = begun.select(key.alias("g"), F.lit(-1).cast("long").alias("chunk"), F.lit("held").alias("kind"), "name", F.col("entity").alias("value"))
    carried = _sorted(summaries.unionByName(held), ["g"], ["chunk", "kind"]).mapInArrow(_carry(by_schema), STARTS)
    starts = (carried if with_names else carried.where("chunk >= 0")).select("g", "chunk", F.lit(-1).cast("long").alias("seq"), F.lit("start").alias("op"), "name", F.col("entity").alias("to"))
    resolved = _sorted(starts.unionByName(moving), ["g", "chunk"], ["seq"]).mapInArrow(_resolve(by_schema, label), FOUND)
    back = F.from_json("g", ", ".join(f"{c} {types[c].simpleString()}" for c in group))
    parts = [back[c].alias(c) for c in group]
    return resolved.select(*parts, "seq", "role", "entity", "body"), carried.where("chunk < 0").select(*parts, "name", "entity")
