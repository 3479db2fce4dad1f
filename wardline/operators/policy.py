"""Allow rules: what a reviewed policy authorises, and the snippet that would authorise a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.text import valid_json
from wardline.operators.globs import first_globs
from wardline.session import broadcast_if_small

IGNORE_SCHEMA = (
    "struct<values:array<string>,hashes:array<string>,fingerprints:array<string>,"
    "paths:array<string>,patternIds:array<string>,patterns:array<string>>"
)


def digest_entry(entry: Column) -> Column:
    """A full SHA-256 digest, with or without its ``sha256:`` prefix, in lower case; else NULL."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(entry)), r"^sha256:", ""))
    return F.when(bare.rlike(r"^[0-9a-f]{64}\z"), bare)


def _strings(value: Column) -> Column:
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")


def load_policy(policies: DataFrame) -> DataFrame:
    """One policy row per repo from ``(repo, source, marker_rank, in_index, index_text, worktree_text)``.

    The lowest marker rank wins even when it turns out unusable; only indexed,
    parseable, version 1 content authorises anything, every refusal leaves a warning.
    """
    first = Window.partitionBy("repo").orderBy("marker_rank", "source")
    text = F.regexp_replace(F.col("index_text"), "^\ufeff", "")
    keys = F.json_object_keys(text)
    version_raw = F.get_json_object(text, "$.version")
    version = F.coalesce(version_raw.try_cast("double"), F.lit(1.0))
    nested = F.get_json_object(text, "$.secrets").startswith("{")
    ignore_text = F.when(nested, F.get_json_object(text, "$.secrets.ignore")).otherwise(F.get_json_object(text, "$.ignore"))
    src = F.col("source")
    problem = (
        F.when(
            ~F.col("in_index"),
            F.concat(src, F.lit(": not in the index, its rules allow nothing")),
        )
        .when(F.col("index_text").isNull(), F.concat(src, F.lit(": no content in the index, its rules allow nothing")))
        .when(~valid_json(text), F.concat(src, F.lit(": not JSON, its rules allow nothing")))
        .when(keys.isNull(), F.concat(src, F.lit(": not a JSON object, its rules allow nothing")))
        .when(
            version != 1,
            F.concat(src, F.lit(": version "), version_raw, F.lit(" is not supported, its rules allow nothing")),
        )
    )
    drift = F.when(
        F.col("in_index") & F.col("index_text").isNotNull() & F.col("worktree_text").isNotNull()
        & (F.col("worktree_text") != F.col("index_text")),
        F.concat(src, F.lit(": edited since it was indexed, the indexed content counts")),
    )
    staged = (
        policies.withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .withColumn("problem", problem)
        .withColumn("drift", drift)
        .withColumn("ignore", F.when(F.col("problem").isNull(), F.from_json(ignore_text, IGNORE_SCHEMA)))
    )
    digests = F.concat(_strings(F.col("ignore.hashes")), _strings(F.col("ignore.fingerprints")))
    staged = staged.withColumn("digest_rows", F.transform(digests, lambda d: F.struct(d.alias("entry"), digest_entry(d).alias("digest"))))
    refused = F.size(F.filter("digest_rows", lambda d: d["digest"].isNull()))
    refused_note = F.when(
        refused > 0,
        F.concat(
            src, F.lit(": left out "), refused.cast("string"), F.lit(" hash entries that are not full SHA-256 identities"),
        ),
    )
    return staged.select(
        "repo",
        "source",
        F.col("problem").isNull().alias("trusted"),
        F.array_distinct(_strings(F.col("ignore.values"))).alias("values"),
        F.array_distinct(F.filter(F.transform("digest_rows", lambda d: d["digest"]), lambda d: d.isNotNull())).alias("hashes"),
        _strings(F.col("ignore.paths")).alias("paths"),
        F.array_distinct(F.concat(_strings(F.col("ignore.patternIds")), _strings(F.col("ignore.patterns")))).alias("pattern_ids"),
        F.filter(F.array("drift", "problem", refused_note), lambda w: w.isNotNull()).alias("warnings"),
    )


def allow_rules(loaded: DataFrame) -> DataFrame:
    """The rules of trusted policies as ``(repo, kind, value)`` rows."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("entries"))
            for kind, column in (("patternId", "pattern_ids"), ("value", "values"), ("hash", "hashes"), ("path", "paths"))
        ]
    )
    return (
        loaded.where("trusted")
        .select("repo", F.inline(kinds))
        .select("repo", "kind", F.explode("entries").alias("value"))
    )


def builtin_reason(raw: Column, pattern_id: Column) -> Column:
    return F.when(raw.isin(V.DOCUMENTATION_VALUES), "known documentation value").when(
        (pattern_id == "aws") & raw.endswith("EXAMPLE"), "documentation key id"
    )


def allow_decision(hits: DataFrame, policies: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``reason`` to hits of ``(repo, path, pattern_id, raw, auth_id)``.

    Policies hold one row per repo, and paths meet their globs by what a glob fixes;
    the order is built-in, pattern id, value, hash, path, and the first to match gives the reason.
    """
    rules = policies.select(
        "repo",
        F.col("trusted").alias("_trusted"),
        F.col("pattern_ids").alias("_ids"),
        F.col("values").alias("_values"),
        F.col("hashes").alias("_hashes"),
    )
    globs = policies.where("trusted").select("repo", F.posexplode("paths").alias("pos", "glob"))
    named = first_globs(hits, globs, ["repo"]).withColumnRenamed("glob", "_glob")
    joined = hits.join(broadcast_if_small(rules), "repo", "left").join(named, ["repo", "path"], "left")
    unique = ~F.col("pattern_id").isin(V.NON_UNIQUE_DETECTORS)
    glob = F.col("_glob")
    reason = F.coalesce(
        builtin_reason(F.col("raw"), F.col("pattern_id")),
        F.when(
            F.col("_trusted"),
            F.coalesce(
                F.when(F.array_contains("_ids", F.col("pattern_id")), F.concat(F.lit('policy: patternId "'), F.col("pattern_id"), F.lit('"'))),
                F.when(unique & F.array_contains("_values", F.col("raw")), F.lit("policy: value")),
                F.when(unique & F.array_contains("_hashes", F.col("auth_id")), F.lit("policy: hash")),
                F.when(glob.isNotNull(), F.concat(F.lit('policy: path "'), glob, F.lit('"'))),
            ),
        ),
    )
    return (
        joined.withColumn("reason", reason)
        .withColumn("allowed", F.col("reason").isNotNull())
        .drop("_trusted", "_ids", "_values", "_hashes", "_glob")
    )


def allow_by_path(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits whose path a policy glob of the same repo matches, with the first such glob."""
    globs = rules.where("kind = 'path'").select("repo", F.col("value").alias("glob"), F.col("value").alias("pos"))
    return hits.join(first_globs(hits, globs, ["repo"]), ["repo", "path"]).select(*hits.columns, "glob")


def remediation_snippet(findings: DataFrame, entries: int = V.REMEDIATION_CAP) -> DataFrame:
    """Ignore documents that would allow all findings of a repo, in parts of about ``entries`` entries each.

    Unique patterns contribute digests; patterns whose match is not unique to one secret contribute their path only. Entries are
    distinct and dealt to parts by their hash, so that no repo is sorted or gathered whole. Returns ``repo, part, parts, hashes, paths,
    snippet`` with the numbers of entries of either kind.
    """
    unique = ~F.col("pattern_id").isin(V.NON_UNIQUE_DETECTORS) & F.col("auth_id").isNotNull()
    path = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    rows = findings.select("repo", F.when(unique, "hashes").otherwise("paths").alias("kind"), F.when(unique, F.col("auth_id")).otherwise(path).alias("entry")).distinct()
    parts = rows.groupBy("repo").agg(F.ceil(F.count("*") / entries).cast("int").alias("parts"))
    number = F.conv(F.left(F.sha2("entry", 256), F.lit(8)), 16, 10).cast("bigint")
    dealt = rows.join(broadcast_if_small(parts), "repo").withColumn("part", (number % F.col("parts")).cast("int"))
    listed = dealt.groupBy("repo", "parts", "part").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("entry")))).alias(kind) for kind in ("hashes", "paths")]
    )
    body = F.concat_ws(",", *[F.when(F.size(kind) > 0, F.concat(F.lit(f'"{kind}":'), F.to_json(kind))) for kind in ("hashes", "paths")])
    snippet = F.concat(F.lit('{"version":1,"secrets":{"ignore":{'), body, F.lit("}}}"))
    return listed.select("repo", "part", "parts", F.size("hashes").alias("hashes"), F.size("paths").alias("paths"), snippet.alias("snippet"))
