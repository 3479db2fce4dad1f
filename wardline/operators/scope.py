"""Change scope: did a set of changes stay inside what a contract allows?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.paths import is_own_artifact, is_regenerated, is_unsafe_path, normalize_path
from wardline.functions.text import let, valid_json
from wardline.operators.globs import match_globs
from wardline.session import broadcast_if_small

# --- inputs ---------------------------------------------------------------------------------

_RECORD = r"(?:[RC][0-9]*\x00+[^\x00]+\x00+[^\x00]+|[A-QS-Z][0-9]*\x00+[^\x00]+)"


def parse_name_status(df: DataFrame, log: str, keys: list[str]) -> DataFrame:
    """NUL-separated name-status records as change rows; a rename or copy gives two."""

    def change(path: Column, kind: Column, old: Column | None = None) -> Column:
        return F.struct(
            normalize_path(path).alias("path"),
            kind.alias("kind"),
            (F.lit(None).cast("string") if old is None else normalize_path(old)).alias("old_path"),
        )

    def rows(record: Column) -> Column:
        parts = F.filter(F.split(record, "\x00"), lambda p: p != "")
        code = F.left(F.get(parts, F.lit(0)), F.lit(1))
        move = F.when(code == "R", "rename").otherwise("copy")
        kind = (
            F.when(code == "A", "add").when(code == "D", "delete").when(code == "M", "modify")
            .when(code == "T", "typechange").when(code == "U", "unmerged").otherwise("change")
        )
        first, second = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        return F.when(
            code.isin("R", "C"),
            F.array(change(first, F.concat(move, F.lit("-from"))), change(second, F.concat(move, F.lit("-to")), first)),
        ).otherwise(F.array(change(first, kind)))

    records = F.regexp_extract_all(F.col(log), F.lit(_RECORD), F.lit(0))
    return df.select(*keys, F.posexplode(F.flatten(F.transform(records, rows))).alias("pos", "c")).select(*keys, "pos", "c.*")


def parse_commit_log(df: DataFrame, log: str, keys: list[str]) -> DataFrame:
    """Lines of a log: 40 hex digits start a commit, other non-empty lines are paths it touched."""
    chunks = F.filter(F.split(F.col(log), r"(?m)^[ \t]*(?=[0-9a-f]{40}[ \t]*$)"), lambda c: c.rlike(r"^[0-9a-f]{40}\s*(?:\n|\z)"))
    commits = df.select(*keys, F.posexplode(chunks).alias("commit_pos", "chunk"))
    lines = F.filter(F.transform(F.split("chunk", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return commits.select(
        *keys, "commit_pos", F.left("chunk", F.lit(40)).alias("commit"), F.explode_outer(F.slice(lines, F.lit(2), F.size(lines))).alias("path")
    )


def keep_first_change(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One record per path: the first, unless it is a plain modify and a later one says more."""
    group = [*(keys or ["repo"]), "path"]
    rest = [c for c in changes.columns if c not in group]
    chosen = F.min_by(F.struct(*rest), F.struct((F.col("kind") == "modify").cast("int"), F.col("pos")))
    return changes.groupBy(*group).agg(chosen.alias("c")).select(*group, "c.*")


def exclude_contract_path(changes: DataFrame, frozen: DataFrame) -> DataFrame:
    """Drop the contract's own path where every copy still equals the frozen one.

    ``frozen`` is ``(repo, contract_path, frozen_digest, index_digest, worktree_digest, later_change)``.
    """
    intact = (
        ~F.col("later_change")
        & (F.col("index_digest") == F.col("frozen_digest"))
        & (F.col("worktree_digest") == F.col("frozen_digest"))
    )
    unchanged = frozen.where(intact).select("repo", F.col("contract_path").alias("path"))
    return changes.join(broadcast_if_small(unchanged), ["repo", "path"], "left_anti")


# --- contracts ------------------------------------------------------------------------------------

CONTRACT = (
    "struct<schemaVersion:bigint,goal:string,allow:array<string>,deny:array<string>,require:array<string>,"
    "maxFiles:bigint,acceptanceNotes:string,baselineCommit:string>"
)


def contract_valid(text: Column) -> Column:
    """struct<error, contract>: the first rule a contract document breaks, else its normalized fields."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff", "")
    doc = F.try_parse_json(clean)
    keys = F.json_object_keys(clean)

    def kind(name: str) -> Column:
        value = F.try_variant_get(doc, f"$.{name}", "variant")
        return F.when(value.isNull(), F.lit("VOID")).otherwise(F.schema_of_variant(value))

    def number(name: str) -> Column:
        return F.try_variant_get(doc, f"$.{name}", "double")

    def strings(name: str) -> Column:
        return F.when(kind(name) == "ARRAY<STRING>", F.try_variant_get(doc, f"$.{name}", "array<string>"))

    numeric = r"^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"
    whole = lambda name: kind(name).rlike(numeric) & (number(name) == F.floor(number(name)))
    string = lambda name: F.try_variant_get(doc, f"$.{name}", "string")

    def globs(name: str) -> Column:
        def problem(g: Column) -> Column:
            return F.when(F.trim(g) == "", F.lit(f"{name}:empty-glob")).when(
                is_unsafe_path(g), F.concat(F.lit(f"{name}:unsafe-glob:"), g)
            )

        bad = F.filter(F.transform(strings(name), problem), lambda p: p.isNotNull())
        mixed = kind(name).startswith("ARRAY") & ~kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")
        return F.when(mixed, F.lit(f"{name}:empty-glob")).otherwise(F.get(bad, F.lit(0)))

    def optional_array(name: str) -> Column:
        wrong = (kind(name) != "VOID") & ~kind(name).startswith("ARRAY")
        return F.coalesce(F.when(wrong, f"{name}:not-an-array"), globs(name))

    baseline = F.lower(F.trim(string("baselineCommit")))
    forbidden = F.get(F.filter(F.array(*[F.lit(k) for k in V.FORBIDDEN_CONTRACT_KEYS]), lambda k: F.array_contains(keys, k)), F.lit(0))
    error = F.coalesce(
        F.when(~valid_json(clean), "json:broken"),
        F.when(keys.isNull(), "json:not-an-object"),
        F.when(~F.coalesce(whole("schemaVersion"), F.lit(False)), "schemaVersion:not-an-integer"),
        F.when(number("schemaVersion") != 1, F.concat(F.lit("schemaVersion:unsupported:"), number("schemaVersion").cast("bigint").cast("string"))),
        F.when((kind("goal") != "STRING") | (F.trim(string("goal")) == ""), "goal:missing"),
        F.when(~kind("allow").startswith("ARRAY") | (kind("allow") == "ARRAY<VOID>"), "allow:missing"),
        globs("allow"),
        optional_array("deny"),
        optional_array("require"),
        F.when(
            (kind("maxFiles") != "VOID") & ~F.coalesce(whole("maxFiles") & (number("maxFiles") >= 0), F.lit(False)),
            "maxFiles:not-a-count",
        ),
        F.when(~kind("acceptanceNotes").isin("VOID", "STRING"), "acceptanceNotes:not-text"),
        F.when(kind("baselineRef") != "VOID", "baselineRef:forbidden"),
        F.when((kind("baselineCommit") != "STRING") | (baseline == ""), "baselineCommit:missing"),
        F.when(~baseline.rlike(r"^[0-9a-f]{40}\z"), F.concat(F.lit("baselineCommit:malformed:"), F.trim(string("baselineCommit")))),
        F.when(forbidden.isNotNull(), F.concat(F.lit("executable-field:"), forbidden)),
    )
    empty = F.array().cast("array<string>")
    tidy = lambda name: F.transform(F.coalesce(strings(name), empty), lambda g: normalize_path(F.trim(g)))
    contract = F.struct(
        number("schemaVersion").cast("bigint").alias("schemaVersion"),
        F.trim(string("goal")).alias("goal"),
        tidy("allow").alias("allow"),
        tidy("deny").alias("deny"),
        tidy("require").alias("require"),
        number("maxFiles").cast("bigint").alias("maxFiles"),
        string("acceptanceNotes").alias("acceptanceNotes"),
        baseline.alias("baselineCommit"),
    )
    return let(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), contract).alias("contract")))


def contract_hash(contract: Column) -> Column:
    """SHA-256 of the canonical contract: fixed key order, sorted normalized globs, absent fields left out."""
    tidy = lambda name: F.array_sort(F.transform(contract[name], normalize_path)).alias(name)
    canonical = F.to_json(
        F.struct(
            contract["schemaVersion"].alias("schemaVersion"),
            F.coalesce(contract["goal"], F.lit("")).alias("goal"),
            tidy("allow"),
            tidy("deny"),
            tidy("require"),
            F.lower(F.coalesce(contract["baselineCommit"], F.lit(""))).alias("baselineCommit"),
            contract["maxFiles"].alias("maxFiles"),
            F.nullif(contract["acceptanceNotes"], F.lit("")).alias("acceptanceNotes"),
        )
    )
    return F.sha2(canonical, 256)


def receipt_hash(contract_digest: Column, baseline: Column, freeze: Column, head: Column, paths: Column, violations: Column, verdict: Column) -> Column:
    """SHA-256 binding a contract's identity to the changes, violations and verdict it produced.

    ``paths`` is array<struct<path, kind>>, ``violations`` array<struct<path, reason, rule>>.
    """
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.lower(c), F.lit('"')), F.lit("null"))
    body = F.concat(
        F.lit('{"contractHash":'), quoted(F.regexp_replace(contract_digest, "^sha256:", "")),
        F.lit(',"baselineCommit":'), quoted(baseline),
        F.lit(',"freezeCommit":'), quoted(freeze),
        F.lit(',"headCommit":'), quoted(head),
        F.lit(',"paths":'), F.to_json(F.array_sort(paths)),
        F.lit(',"violations":'), F.to_json(F.array_sort(violations)),
        F.lit(',"verdict":"'), F.when(verdict == "GO", "GO").otherwise("NO-GO"),
        F.lit(f'","limitation":"{V.SCOPE_LIMITATION}"}}'),
    )
    return F.sha2(body, 256)


# --- evaluation --------------------------------------------------------------------------------------


def _globs(contracts: DataFrame, **lists: str) -> DataFrame:
    """``repo, glob, pos`` and the list each glob stands in."""
    rows = [contracts.select("repo", F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "glob")) for kind, column in lists.items()]
    return reduce(DataFrame.unionByName, rows)


def scope_violations(changes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Changes that a deny glob names, or that no allow glob covers; deny wins. Paths meet globs by what a glob fixes."""
    met = match_globs(changes, _globs(contracts, allow="allow", deny="deny"), ["repo"]).groupBy("repo", "path").agg(
        F.min_by("glob", F.when(F.col("kind") == "deny", F.col("pos"))).alias("denied"), F.min_by("glob", F.when(F.col("kind") == "allow", F.col("pos"))).alias("allowed")
    )
    judged = changes.select("repo", "path").join(broadcast_if_small(contracts.select("repo")), "repo").join(met, ["repo", "path"], "left")
    return judged.where("denied is not null or allowed is null").select(
        "repo",
        "path",
        F.when(F.col("denied").isNotNull(), "denied").otherwise("outside-allow").alias("reason"),
        F.col("denied").alias("rule"),
    )


def required_missing(changes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Required globs that no change of the repo matches."""
    wanted = contracts.select("repo", F.explode(F.array_distinct("require")).alias("rule"))
    met = match_globs(changes, wanted.withColumnRenamed("rule", "glob"), ["repo"]).select("repo", F.col("glob").alias("rule")).distinct()
    return wanted.join(met, ["repo", "rule"], "left_anti").select(
        "repo", F.lit("(none)").alias("path"), F.lit("required-missing").alias("reason"), "rule"
    )


def max_files_violation(changes: DataFrame, contracts: DataFrame) -> DataFrame:
    counted = changes.groupBy("repo").agg(F.count("*").alias("files"))
    return (
        counted.join(contracts.select("repo", "maxFiles"), "repo")
        .where(F.col("files") > F.col("maxFiles"))
        .select("repo", F.lit("(count)").alias("path"), F.lit("max-files").alias("reason"), F.col("maxFiles").cast("string").alias("rule"))
    )


def original_freeze(touches: DataFrame) -> DataFrame:
    """The first touch of the contract path is the only one that can authorise; later ones set a flag.

    ``touches`` is ``(repo, seq, commit, parents, present, dedicated, contract_error, baseline)`` in
    history order. Everything is a partial aggregate, so a long history never meets in one task.
    """
    fields = ["commit", "parents", "present", "dedicated", "contract_error", "baseline"]
    first = touches.groupBy("repo").agg(
        F.count("*").alias("touches"), F.min_by(F.struct(*fields), "seq").alias("first")
    )
    f = F.col("first")
    error = (
        F.when(F.size(f["parents"]) > 1, "freeze:merge")
        .when(~f["present"], "freeze:removed")
        .when(F.size(f["parents"]) != 1, "freeze:parents")
        .when(~f["dedicated"], "freeze:not-dedicated")
        .when(f["contract_error"].isNotNull(), F.concat(F.lit("freeze:invalid:"), f["contract_error"]))
        .when(f["baseline"] != F.get(f["parents"], F.lit(0)), "freeze:baseline")
    )
    return first.select(
        "repo",
        "touches",
        F.when(error.isNull(), f["commit"]).alias("freeze_commit"),
        F.when(error.isNull(), f["baseline"]).alias("baseline"),
        (F.col("touches") > 1).alias("later_change"),
        error.alias("error"),
    )


def scope_verdict(violations: DataFrame, freezes: DataFrame, changes: DataFrame) -> DataFrame:
    """GO iff nothing is violated. A repo without a contract has no row; an untrusted one is NO-GO;
    a later contract change is always a violation."""
    counted = violations.groupBy("repo").agg(F.count("*").alias("n"))
    files = changes.groupBy("repo").agg(F.count("*").alias("files"))
    total = F.when(F.col("error").isNotNull(), 1).otherwise(
        F.coalesce("n", F.lit(0)) + F.col("later_change").cast("int")
    )
    return (
        freezes.join(counted, "repo", "left")
        .join(files, "repo", "left")
        .select(
            "repo",
            F.coalesce("files", F.lit(0)).cast("bigint").alias("file_count"),
            total.cast("bigint").alias("violations"),
            F.when(total == 0, "GO").otherwise("NO-GO").alias("verdict"),
            (F.when(F.col("error").isNotNull(), "untrusted").when(F.col("later_change"), "later-contract-change")).alias("note"),
        )
    )


# --- state of a working tree -----------------------------------------------------------------------------


def tracked_env_status(files: DataFrame) -> DataFrame:
    """Per repo: a tracked environment file fails, an untracked unignored one warns."""
    from wardline.functions.paths import basename, is_real_env

    env = is_real_env(basename(F.col("path")))
    tracked = env & F.col("tracked")
    loose = env & ~F.col("tracked") & ~F.col("ignored")
    counted = files.groupBy("repo").agg(F.count_if(tracked).alias("tracked_env"), F.count_if(loose).alias("loose_env"))
    return counted.withColumn("status", F.when(F.col("tracked_env") > 0, "fail").when(F.col("loose_env") > 0, "warn").otherwise("pass"))


def dirty_status(changes: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Per repo: a tracked change fails, only untracked files warn, the tool's own files pass.

    ``changes`` is ``(repo, path, code)`` with the two-letter porcelain code.
    """
    untracked = F.col("code") == "??"
    own = is_own_artifact(F.col("path"), markers) & (
        untracked | (is_regenerated(F.col("path"), markers) & ~F.contains("code", F.lit("D")))
    )
    counted = changes.groupBy("repo").agg(
        F.count_if(~own & ~untracked).alias("tracked"), F.count_if(~own & untracked).alias("untracked"), F.count_if(own).alias("own")
    )
    return counted.withColumn("status", F.when(F.col("tracked") > 0, "fail").when(F.col("untracked") > 0, "warn").otherwise("pass"))


def schema_bump(diff_lines: DataFrame) -> DataFrame:
    """Per repo: DDL-shaped changed lines without a changed version line warn."""
    changed = diff_lines.where(F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^[+-]{3}\s"))
    flags = changed.groupBy("repo").agg(
        F.count("*").alias("changed_lines"),
        F.bool_or(F.col("line").rlike(V.SCHEMA_DDL)).alias("ddl_changed"),
        F.bool_or(F.col("line").rlike(V.SCHEMA_VERSION)).alias("version_changed"),
    )
    return flags.withColumn("status", F.when(F.col("ddl_changed") & ~F.col("version_changed"), "warn").otherwise("pass"))


# --- content digest -------------------------------------------------------------------------------------------


def dataset_digest(files: DataFrame, content: str, levels: int = 2) -> DataFrame:
    """One SHA-256 per repo over (path, present, content), independent of row order.

    Files are hashed where they are; digests are then folded up a tree of hash prefixes, so no
    task ever holds more than a slice of a repo, however large. NULL content is a missing file.
    """
    body = F.coalesce(F.col(content), F.lit(""))
    leaf = F.sha2(
        F.concat_ws("\n", "path", F.when(F.col(content).isNull(), "0").otherwise("1"), F.sha2(body, 256)), 256
    )
    level = files.select("repo", F.left(F.sha2("path", 256), F.lit(2 * levels)).alias("prefix"), leaf.alias("digest"))
    for depth in reversed(range(levels + 1)):
        keys = ["repo"] if depth == 0 else ["repo", "prefix"]
        level = level.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "\n"), 256).alias("digest"))
        if depth > 0:
            level = level.withColumn("prefix", F.left("prefix", F.lit(2 * (depth - 1))))
    return level.select("repo", "digest")


def staleness(digests: DataFrame, markers: DataFrame) -> DataFrame:
    """``ok``, ``stale`` or ``missing`` per repo against recorded ``(repo, document_exists, marker_digest)``."""
    return markers.join(digests, "repo", "left").select(
        "repo",
        F.when(~F.col("document_exists"), "missing")
        .when(F.col("marker_digest").isNull() | (F.col("marker_digest") != F.col("digest")), "stale")
        .otherwise("ok")
        .alias("status"),
    )


def changes_since(changes: DataFrame, markers: DataFrame) -> DataFrame:
    """The changes ``(repo, path, commit, ts, tracked)`` of each repo after its last hand-off, all of them, with ``marker_ts``.

    ``markers`` is ``(repo, ts)`` with any number of hand-offs per repo; a repo without one is all new. A change at the very time of the
    hand-off belongs to it.
    """
    last = markers.groupBy("repo").agg(F.max("ts").alias("marker_ts"))
    return changes.join(broadcast_if_small(last), "repo", "left").where(F.col("marker_ts").isNull() | (F.col("ts") > F.col("marker_ts")))


def since_last_handoff(changes: DataFrame, markers: DataFrame, show: int | None = None) -> DataFrame:
    """Per repo with changes or hand-offs: commits, files, tracked and untracked ones since the last hand-off.

    A file counts once, as its newest change says. With ``show`` the newest commits are listed, too, and how many more there are; the
    rows themselves are in ``changes_since``.
    """
    newer = changes_since(changes, markers)
    files = newer.groupBy("repo", "path").agg(F.max_by("tracked", F.struct("ts", "commit")).alias("tracked")).groupBy("repo").agg(
        F.count("*").alias("files"), F.count_if("tracked").alias("tracked"), F.count_if(~F.col("tracked")).alias("untracked")
    )
    commits = newer.where("commit is not null").groupBy("repo", "commit").agg(F.max("ts").alias("ts"))
    counts = commits.groupBy("repo").agg(F.count("*").alias("commits"))
    repos = changes.select("repo").unionByName(markers.select("repo")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("commits", "files", "tracked", "untracked")]
    found = repos.join(counts, "repo", "left").join(files, "repo", "left").select("repo", *numbers)
    if show is None:
        return found
    rank = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("commit"))
    heads = commits.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= show).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rn", "commit"))).alias("s"))
    heads = heads.select("repo", F.transform("s", lambda x: x["commit"]).alias("shown"))
    none = F.array().cast(heads.schema["shown"].dataType)
    return found.join(heads, "repo", "left").select(
        *found.columns, F.coalesce("shown", none).alias("shown"), F.greatest(F.col("commits") - show, F.lit(0)).alias("more")
    )
