"""Access-policy events in migration files, the state they add up to, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.paths import is_fixture_path, is_migration_sql
from wardline.functions.text import let, prefix_sums, table_name
from wardline.operators.lineage import lifetimes, schema_of
from wardline.operators.running import chunk_of, running
from wardline.session import bind, cut_lineage, spread

# --- events -------------------------------------------------------------------------------------

_TOKENS = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|'(?:[^']|'')*+'?|\"[^\"]*\"?|(\$[A-Za-z0-9_]*\$)[\s\S]*?(?:\1|\z)"
_ID = r"(?:\"[^\"]+\"|[A-Za-z0-9_]+)"
_TABLE = rf"({_ID}(?:\s*\.\s*{_ID})?)"
_NAME = r"(?:\"([^\"]+)\"|'([^']+)'|([^\s(;]+))"
_W = V.WORD_START
_DO_DDL = r"(?i)" + _W + r"(?:CREATE|ALTER|DROP|EXECUTE|GRANT|REVOKE)" + V.WORD_END


def _spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def mask_literals(sql: Column) -> Column:
    """struct<text, do_at>: comments and literal interiors blanked in place, and where DO blocks with DDL begin."""

    def masked(m: Column) -> Column:
        dollar = F.regexp_extract(m, r"^\$[A-Za-z0-9_]*\$", 0)
        inner = F.substring(m, F.lit(2), F.length(m) - 2)
        body = F.substring(m, F.length(dollar) + 1, F.length(m) - 2 * F.length(dollar))
        return (
            F.when(m.startswith('"'), m)
            .when(m.startswith("'") & (F.length(m) > 1) & m.endswith("'"), F.concat(F.lit("'"), _spaces(inner), F.lit("'")))
            .when((dollar != "") & (F.length(m) >= 2 * F.length(dollar)), F.concat(dollar, _spaces(body), dollar))
            .otherwise(_spaces(m))
        )

    def build(p: Column) -> Column:
        text = F.array_join(F.zip_with(p["gaps"], F.transform(p["found"], masked), lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")
        steps = F.transform(p["found"], lambda m, i: (F.length(F.get(p["gaps"], i)) + F.when(i > 0, F.length(F.get(p["found"], i - 1))).otherwise(0)).cast("long"))
        blocks = let(
            F.when(F.size(steps) > 0, prefix_sums(steps)),
            lambda starts: F.filter(
                F.transform(
                    p["found"],
                    lambda m, i: F.when(
                        m.startswith("$") & F.get(p["gaps"], i).rlike(r"(?i)" + _W + r"DO\s+(?:LANGUAGE\s+\w+\s+)?\z") & m.rlike(_DO_DDL), F.get(starts, i)
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
        )
        return F.struct(text.alias("text"), F.coalesce(blocks, F.array().cast("array<bigint>")).alias("do_at"))

    parts = F.struct(F.regexp_extract_all(sql, F.lit(_TOKENS), F.lit(0)).alias("found"), F.split(sql, _TOKENS, -1).alias("gaps"))
    return let(parts, build)


def _literal_true(statement: Column, clause: str) -> Column:
    """The clause is nothing but ``true`` in parentheses, however deep: all that open before it close right after it."""
    pattern = r"(?i)" + _W + clause + r"\s*+(\([\s(]*+)true(?:::bool(?:ean)?)?([\s)]*+)"
    opened, closed = (F.length(F.regexp_replace(F.regexp_extract(statement, pattern, g), r"\s", "")) for g in (1, 2))
    return (opened > 0) & (closed >= opened)


def _balanced(statement: Column, clause: str) -> Column:
    """True when the clause's parenthesis closes, or the clause is absent."""
    rest = F.regexp_extract(statement, r"(?is)" + _W + clause + r"\s*(\(.*)\z", 1)
    closed = F.aggregate(
        F.regexp_extract_all(rest, F.lit(r"[()]"), F.lit(0)),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done")),
        lambda a, c: let(
            F.when(c == "(", a["depth"] + 1).otherwise(a["depth"] - 1), lambda d: F.struct(d.alias("depth"), (a["done"] | (d == 0)).alias("done"))
        ),
    )["done"]
    return (rest == "") | closed


def _roles(statement: Column) -> Column:
    listed = F.regexp_extract(statement, r"(?i)" + _W + r"TO\s+([^;(]+?)(?=\s+(?:USING|WITH\s+CHECK|AS\s+|FOR\s+)|\s*\z)", 1)
    return F.when(
        listed != "",
        F.filter(F.transform(F.split(listed, ","), lambda r: F.lower(F.regexp_replace(F.trim(r), r"^[\"']|[\"']$", ""))), lambda r: r != ""),
    )


EVENT = (
    "struct<kind:string,table:string,to_table:string,enabled:boolean,policy:string,rename_to:string,for_cmd:string,roles:array<string>,"
    "using_true:boolean,check_true:boolean,has_using:boolean,has_check:boolean,using_ok:boolean,check_ok:boolean,schema:string,to_schema:string,at:bigint>"
)


def ddl_events(files: DataFrame) -> DataFrame:
    """Policy-relevant statements of migration files as event rows ``(repo, path, index, line, kind, …)``.

    Literals and comments are blanked in place, the text is cut at semicolons, and each statement is
    matched against literal patterns: one row per file in, narrow, no Python. A DO block that contains
    DDL becomes a ``not_checkable`` event instead of being interpreted.
    """
    dealt = spread(files.select("repo", "path", "sql"), "repo", "path")
    wanted = bind(dealt, "_wanted", is_migration_sql(F.col("path")) & ~is_fixture_path(F.col("path"))).where("_wanted")
    # each step is bound: the optimizer filters what is exploded by its size, by a second evaluation and before the rows are dealt
    masked = bind(wanted.select("repo", "path", "sql"), "m", mask_literals(F.col("sql")))
    pieces = F.split(F.col("m.text"), ";", -1)
    starts = let(pieces, lambda p: let(prefix_sums(F.transform(p, lambda s: (F.length(s) + 1).cast("long"))), lambda e: F.transform(p, lambda s, i: F.get(e, i) - F.length(s) - 1)))
    lines = let(
        pieces,
        lambda p: let(
            prefix_sums(F.transform(p, lambda s: (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).cast("long"))),
            lambda e: F.transform(p, lambda s, i: F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint"))),
        ),
    )
    statements = (
        bind(masked, "z", F.arrays_zip(pieces.alias("s"), starts.alias("start"), lines.alias("line")))
        .select("repo", "path", F.col("m.do_at").alias("do_at"), F.explode("z").alias("z"))
        .select("repo", "path", "do_at", F.col("z.s").alias("s"), F.col("z.start").alias("start"), F.col("z.line").alias("line0"))
    )
    s = F.col("s")

    def ex(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, r"(?i)" + pattern, group)

    def named(pattern: str, first: int) -> Column:
        return F.coalesce(*[F.nullif(ex(pattern, first + k), F.lit("")) for k in range(3)])

    def event(kind: str, when: Column, at: Column, **fields: Column) -> Column:
        types = dict(f.split(":", 1) for f in _split_fields(EVENT))
        values = {"kind": F.lit(kind), "at": at, **fields}
        row = F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])
        return F.when(when, F.array(row))

    def where(pattern: str) -> Column:
        return (F.length(F.regexp_extract(s, r"(?is)^(.*?)" + pattern, 1))).cast("bigint")

    create = _W + rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_TABLE}"
    rls = _W + rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_TABLE}\s+(ENABLE|DISABLE)\s+ROW\s+LEVEL\s+SECURITY"
    new_policy = _W + rf"CREATE\s+POLICY\s+{_NAME}\s+ON\s+{_TABLE}"
    old_policy = _W + rf"DROP\s+POLICY\s+(?:IF\s+EXISTS\s+)?{_NAME}\s+ON\s+{_TABLE}"
    alter = _W + rf"ALTER\s+POLICY\s+{_NAME}\s+ON\s+{_TABLE}"
    rename = _W + rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_TABLE}\s+RENAME\s+TO\s+({_ID})"
    move = _W + rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_TABLE}\s+SET\s+SCHEMA\s+({_ID})"
    new_schema = _W + rf"ALTER\s+SCHEMA\s+({_ID})\s+RENAME\s+TO\s+({_ID})"
    drops = _W + r"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?"
    drop_schemas = _W + r"DROP\s+SCHEMA\s+(?:IF\s+EXISTS\s+)?"
    ident = lambda raw: F.substring_index(table_name(F.concat(F.lit("x."), raw)), ".", -1)
    schema_of = lambda raw: F.substring_index(table_name(raw), ".", 1)
    base_of = lambda raw: F.substring_index(table_name(raw), ".", -1)

    def listed(prefix: str) -> Column:
        body = F.regexp_replace(F.regexp_extract(s, r"(?is)" + prefix + r"(.*)\z", 1), r"(?i)\s+(?:CASCADE|RESTRICT)\s*\z", "")
        return F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x.rlike(rf"^{_ID}(?:\s*\.\s*{_ID})?\z"))

    def each(kind: str, prefix: str, build) -> Column:
        row = lambda x, i: F.get(event(kind, F.lit(True), where(prefix) + i, **build(x)), F.lit(0))
        return F.when(s.rlike(r"(?i)" + prefix), F.transform(listed(prefix), row))

    is_rename = ex(_W + rf"RENAME\s+TO\s+{_NAME}", 0) != ""
    command = F.coalesce(F.nullif(F.upper(ex(_W + r"FOR\s+(ALL|SELECT|INSERT|UPDATE|DELETE)" + V.WORD_END, 1)), F.lit("")), F.lit("ALL"))
    predicates = dict(
        using_true=_literal_true(s, "USING"), check_true=_literal_true(s, r"WITH\s+CHECK"),
        has_using=s.rlike(r"(?i)" + _W + r"USING\s*\("), has_check=s.rlike(r"(?i)" + _W + r"WITH\s+CHECK\s*\("),
        using_ok=_balanced(s, "USING"), check_ok=_balanced(s, r"WITH\s+CHECK"),
    )
    hit = lambda p: s.rlike(r"(?i)" + p)
    in_block = F.filter("do_at", lambda d: (d >= F.col("start")) & (d <= F.col("start") + F.length("s")))
    none = F.array().cast(f"array<{EVENT}>")
    events = F.concat(
        *[
            F.coalesce(e, none)
            for e in (
                F.transform(in_block, lambda d: F.get(event("not_checkable", F.lit(True), d - F.col("start")), F.lit(0))),
                event("create_table", hit(create), where(create), table=table_name(ex(create, 1))),
                each("drop_table", drops, lambda x: {"table": table_name(x)}),
                event("rls", hit(rls), where(rls), table=table_name(ex(rls, 1)), enabled=F.upper(ex(rls, 2)) == "ENABLE"),
                event(
                    "create_policy", hit(new_policy), where(new_policy), table=table_name(ex(new_policy, 4)), policy=named(new_policy, 1), for_cmd=command,
                    roles=F.coalesce(_roles(s), F.array(F.lit("public"))), **predicates,
                ),
                event("drop_policy", hit(old_policy), where(old_policy), table=table_name(ex(old_policy, 4)), policy=named(old_policy, 1)),
                event(
                    "alter_policy", hit(alter) & is_rename, where(alter), table=table_name(ex(alter, 4)), policy=named(alter, 1),
                    rename_to=named(_W + rf"RENAME\s+TO\s+{_NAME}", 1),
                ),
                event("alter_policy", hit(alter) & ~is_rename, where(alter), table=table_name(ex(alter, 4)), policy=named(alter, 1), roles=_roles(s), **predicates),
                event("rename_table", hit(rename), where(rename), table=table_name(ex(rename, 1)), to_table=F.concat(schema_of(ex(rename, 1)), F.lit("."), ident(ex(rename, 2)))),
                event("set_schema", hit(move), where(move), table=table_name(ex(move, 1)), to_table=F.concat(ident(ex(move, 2)), F.lit("."), base_of(ex(move, 1)))),
                event("rename_schema", hit(new_schema), where(new_schema), schema=ident(ex(new_schema, 1)), to_schema=ident(ex(new_schema, 2))),
                F.when(hit(_W + r"CASCADE" + V.WORD_END), each("drop_schema", drop_schemas, lambda x: {"schema": ident(x)})),
            )
        ]
    )
    rows = bind(statements, "_events", events).select("repo", "path", "start", "line0", "s", F.explode("_events").alias("e"))
    head = F.left("s", F.col("e.at").cast("int"))
    newlines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return rows.select("repo", "path", (F.col("start") + F.col("e.at")).alias("index"), (F.col("line0") + newlines + 1).cast("int").alias("line"), "e.*").drop("at")


def _split_fields(ddl: str) -> list[str]:
    inner, depth, out, current = ddl[ddl.index("<") + 1 : -1], 0, [], ""
    for ch in inner:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def sequence_events(events: DataFrame) -> DataFrame:
    """Number a repo's events by path, position and line. Paths are the chunks, so a repo is never sorted in one task."""
    # numbering reads its rows twice, and parsing them takes long
    return running(cut_lineage(events), ["repo"], ["path", "index", "line"], "path", {"seq": ("number", "")})


# --- state ------------------------------------------------------------------------------------------------------


def client_roles(roles: Column) -> Column:
    return F.filter(roles, lambda r: ~F.lower(r).isin(V.SERVER_ROLES))


def open_write(p: Column) -> Column:
    """A policy that lets a client role write any row: literal true where its command looks."""
    cmd, using, check = p["for_cmd"], p["using_true"], p["check_true"]
    opened = (
        F.when(cmd == "INSERT", check | (using & ~p["has_check"])).when(cmd == "DELETE", using).when(cmd.isin("UPDATE", "ALL"), using | check).otherwise(False)
    )
    return opened & (F.size(client_roles(p["roles"])) > 0)


def table_ops(events: DataFrame, *more: str) -> DataFrame:
    """What each event does to the names of a repo's tables, and ``more`` of its columns."""
    kind = F.col("kind")
    op = (
        F.when(kind == "drop_table", "end").when(kind == "drop_policy", "use").when(kind.isin("rename_table", "set_schema"), "move")
        .when(kind == "drop_schema", "end_all").when(kind == "rename_schema", "move_all").when(F.col("table").isNotNull(), "ensure")
    )
    return events.select("repo", "seq", op.alias("op"), F.coalesce("table", "schema").alias("name"), F.coalesce("to_table", "to_schema").alias("to"), *more).where("op is not null")


def _policy_ops(placed: DataFrame) -> DataFrame:
    """What each event does to the names of a table's policies."""
    e = F.col("e")
    rows = placed.where(e["kind"].isin("create_policy", "drop_policy", "alter_policy") & e["policy"].isNotNull())
    op = F.when(e["kind"] == "drop_policy", "end").when(e["rename_to"].isNotNull(), "move").otherwise("ensure")
    return rows.select("repo", "table_entity", "seq", op.alias("op"), F.lower(e["policy"]).alias("name"), F.lower(e["rename_to"]).alias("to"))


def policy_state(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The final state of access policies from sequenced events, as (tables, policies).

    ``tables``: one row per existing table with ``rls`` (NULL means never touched), where it was set or created,
    the first seq at which it was secured, and later statements that could not be checked. ``policies``: one row
    per existing policy of an existing table.
    """
    e = F.col("e")
    # parsed once; four steps are written, whatever the events are
    events = cut_lineage(events)
    found, alive = lifetimes(table_ops(events), ["repo"], by_schema=True)
    bodies = events.select("repo", "seq", F.struct(*[c for c in events.columns if c not in ("repo", "seq")]).alias("e"))
    touched = found.where("role in ('ensure', 'use')").join(bodies, ["repo", "seq"]).select("repo", F.col("entity").alias("table_entity"), "seq", "role", "e")
    level = cut_lineage(touched.unionByName(alive.select("repo", F.col("entity").alias("table_entity"), "name"), allowMissingColumns=True))
    placed, alive = level.where("role is not null").drop("name"), level.where("role is null").select("repo", "table_entity", "name")

    # second level: policies inside a table's lifetime
    within, kept = lifetimes(_policy_ops(placed), ["repo", "table_entity"])
    second = within.join(bodies, ["repo", "seq"]).withColumn("_chunk", chunk_of(F.col("seq")))
    group = ["repo", "table_entity", "entity"]
    created, altered = e["kind"] == "create_policy", (e["kind"] == "alter_policy") & e["rename_to"].isNull()
    sets_using, sets_check = created | (altered & e["has_using"]), created | (altered & e["has_check"])
    values = {
        "for_cmd": F.when(created, e["for_cmd"]), "roles": F.when(created | altered, e["roles"]),
        "using_true": F.when(sets_using, e["using_true"] & e["using_ok"]), "check_true": F.when(sets_check, e["check_true"] & e["check_ok"]),
        "has_check": F.when(sets_check, e["has_check"] & e["check_ok"]), "using_ok": F.when(sets_using, e["using_ok"]), "check_ok": F.when(sets_check, e["check_ok"]),
        "policy": F.when(created, e["policy"]).when(F.col("role") == "in", e["rename_to"]), "path": e["path"], "line": e["line"],
    }
    own = second.where("role in ('ensure', 'in')").select(*group, "seq", "_chunk", *[v.alias(n) for n, v in values.items()])
    defaults = {"for_cmd": F.lit("ALL"), "roles": F.array(F.lit("public")), "using_true": F.lit(False), "check_true": F.lit(False), "has_check": F.lit(False), "using_ok": F.lit(True), "check_ok": F.lit(True)}
    before = running(own, group, ["seq"], "_chunk", {f"b_{n}": ("last", n) for n in defaults})
    after = F.struct(*[F.coalesce(n, f"b_{n}", d).alias(n) for n, d in defaults.items()])
    course = before.withColumn("after", after).withColumn("solid", (~open_write(F.col("after"))).cast("int"))
    closed = within.where("role = 'end'").select(*group, F.col("seq").alias("end_seq"))
    level = cut_lineage(course.unionByName(closed, allowMissingColumns=True).unionByName(kept.select(*group, "name"), allowMissingColumns=True))
    timeline = level.where("seq is not null").drop("end_seq", "name")
    closed, kept = level.where("end_seq is not null").select(*group, "end_seq"), level.where("name is not null").select(*group, "name")
    previous = running(timeline, group, ["seq"], "_chunk", {"_was": ("lag", "solid")})
    changes = previous.select("repo", "table_entity", "seq", (F.col("solid") - F.coalesce("_was", F.lit(0))).alias("delta"))
    # a lifetime that ends, by a drop or by being overwritten, takes its policy away
    ends = closed.join(timeline.groupBy(*group).agg(F.max_by("solid", "seq").alias("solid")), group).select(
        "repo", "table_entity", F.col("end_seq").alias("seq"), (-F.col("solid")).alias("delta")
    )

    # when was a table first on, with a policy that is not open?
    switches = placed.where(e["kind"] == "rls").select("repo", "table_entity", "seq", F.lit(0).alias("delta"), e["enabled"].alias("rls"))
    steps = changes.unionByName(ends).withColumn("rls", F.lit(None).cast("boolean")).unionByName(switches).groupBy("repo", "table_entity", "seq").agg(
        F.sum("delta").alias("delta"), F.max("rls").alias("rls")
    )
    steps = steps.withColumn("_chunk", chunk_of(F.col("seq")))
    course = running(steps, ["repo", "table_entity"], ["seq"], "_chunk", {"_sum": ("sum", "delta"), "_rls": ("last", "rls")})
    secure = (F.col("_sum") + F.col("delta") > 0) & F.coalesce("rls", "_rls", F.lit(False))
    secured = course.where(secure).groupBy("repo", "table_entity").agg(F.min("seq").alias("secure_seq"))

    unchecked = (e["kind"] == "not_checkable") | (altered & (~F.coalesce(e["using_ok"], F.lit(True)) | ~F.coalesce(e["check_ok"], F.lit(True))))
    place = F.struct("seq", e["path"].alias("path"), e["line"].alias("line"))
    ensured = F.col("role") == "ensure"
    located = F.struct(e["path"].alias("path"), e["line"].alias("line"))
    facts = (
        placed.join(secured, ["repo", "table_entity"], "left")
        .groupBy("repo", "table_entity", "secure_seq")
        .agg(
            F.min_by(e["kind"], F.when(ensured, F.col("seq"))).alias("first_kind"),
            F.max_by(e["enabled"], F.when(e["kind"] == "rls", F.col("seq"))).alias("rls_set"),
            F.max_by(located, F.when(e["kind"] == "rls", F.col("seq"))).alias("rls_at"),
            F.max_by(located, F.when(e["kind"] == "create_table", F.col("seq"))).alias("created_at"),
            F.min(F.when(unchecked & (F.col("seq") >= F.col("secure_seq")), place)).alias("own_gap"),
            F.min(F.when((e["kind"] == "not_checkable") & (F.col("secure_seq").isNull() | (F.col("seq") < F.col("secure_seq"))), place)).alias("early_gap"),
        )
    )
    tables = alive.join(facts, ["repo", "table_entity"])
    rls = F.coalesce("rls_set", F.when(F.col("first_kind") == "create_table", F.lit(False)))
    tables = tables.select(
        "repo", F.col("name").alias("table"), "table_entity", rls.alias("rls"), F.coalesce("rls_at", "created_at").alias("rls_location"),
        F.col("rls_at").isNotNull().alias("rls_explicit"), "secure_seq", "own_gap", "early_gap",
    )
    tables = cut_lineage(_ambient(tables, events))
    final = timeline.groupBy(*group).agg(
        F.max_by("after", "seq").alias("a"), F.max_by("path", "seq").alias("path"), F.max_by("line", "seq").alias("line"),
        F.max_by("policy", F.when(F.col("policy").isNotNull(), F.col("seq"))).alias("policy"),
    )
    policies = kept.join(final, group).select("repo", "table_entity", F.coalesce("policy", "name").alias("policy"), "a.*", "path", "line")
    policies = policies.join(tables.select("repo", "table_entity", "table"), ["repo", "table_entity"])
    return tables, policies


def _ambient(tables: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``gap``: the first statement after a table was secured that could not be checked, its own or one without a table."""
    loose = events.where("kind = 'not_checkable' and table is null").select(
        "repo", "seq", F.lit(None).cast("string").alias("table"), F.struct("seq", "path", "line").alias("at")
    )
    points = tables.where(F.col("secure_seq").isNotNull() & (schema_of(F.col("table")) == "public")).select(
        "repo", F.col("secure_seq").alias("seq"), "table", F.lit(None).cast(loose.schema["at"].dataType).alias("at")
    )
    back = points.unionByName(loose).select("*", (-F.col("seq")).alias("_back"), (-chunk_of(F.col("seq"))).alias("_chunk"))
    next_gap = running(back, ["repo"], ["_back"], "_chunk", {"ambient": ("last", "at")}).where("table is not null").select("repo", "table", "ambient")
    joined = tables.join(next_gap, ["repo", "table"], "left")
    return joined.withColumn("gap", F.least("own_gap", "ambient")).drop("own_gap", "ambient")


def policy_findings(tables: DataFrame, policies: DataFrame) -> DataFrame:
    """What is wrong with public tables: ``(repo, table, rule, severity, path, line, policy)``.

    RLS that is off dominates its policies; a gap after a secured state blocks; an unparsed policy is a
    warning only where nothing was ever secured.
    """
    public = tables.where(schema_of(F.col("table")) == "public")
    p = F.struct("for_cmd", "roles", "using_true", "check_true", "has_check").alias("p")
    judged = policies.select("*", p).withColumn("open", open_write(F.col("p"))).drop("p")
    solid = judged.groupBy("repo", "table").agg(F.bool_or(~F.col("open")).alias("has_solid"))
    t = public.join(solid, ["repo", "table"], "left")
    secured = F.coalesce(F.col("rls") & F.col("has_solid"), F.lit(False))
    early = F.col("gap").isNull() & F.col("early_gap").isNotNull() & F.coalesce(F.col("rls"), F.lit(True)) & ~secured
    at = F.coalesce("gap", F.when(early, F.col("early_gap")))
    none = F.lit(None).cast("string")
    lineage = t.where(F.col("gap").isNotNull() | early).select(
        "repo", "table", F.lit("lineage-not-checkable").alias("rule"), F.lit("fail").alias("severity"), at["path"].alias("path"), at["line"].alias("line"), none.alias("policy")
    )
    off = t.where(~F.col("rls") & F.col("rls_location").isNotNull()).select(
        "repo", "table", F.lit("rls-disabled").alias("rule"), F.lit("fail").alias("severity"), F.col("rls_location.path").alias("path"), F.col("rls_location.line").alias("line"), none.alias("policy")
    )
    writing = judged.join(public.select("repo", "table", "rls", "secure_seq"), ["repo", "table"]).where(
        F.coalesce(F.col("rls"), F.lit(True)) & F.col("for_cmd").isin(V.WRITE_COMMANDS) & (F.size(client_roles(F.col("roles"))) > 0)
    )
    unparsed = ~F.col("open") & (~F.col("using_ok") | ~F.col("check_ok"))
    blocking = F.col("secure_seq").isNotNull() | F.coalesce(F.col("rls"), F.lit(False))
    rule = F.when(F.col("open"), "permissive-write-policy").when(unparsed & blocking, "lineage-not-checkable").when(unparsed, "policy-not-checkable")
    of_policies = writing.select(
        "repo", "table", rule.alias("rule"), F.when(F.col("open") | blocking, "fail").otherwise("warn").alias("severity"), "path", "line", "policy"
    ).where("rule is not null")
    return lineage.unionByName(off).unionByName(of_policies)
