"""Predicates and functions over repository paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.redact import redact_credentials


def slashes(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "/{2,}", "/")


def segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def has_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(segments(path), F.array(*[F.lit(n) for n in names]))


def skip_secret_path(path: Column) -> Column:
    """Vendored folders, binary assets, and ``.next`` outside ``.next/static``."""
    tail = F.concat(F.lit("/"), slashes(path))
    return (
        has_segment(path, V.SECRET_SKIP_DIRS)
        | tail.rlike(r"/\.next(?:/(?!static(?:/|\z))|\z)")
        | extension(path).isin(V.SECRET_SKIP_EXTENSIONS)
    )


def is_real_env(name: Column) -> Column:
    return ~name.rlike(V.ENV_TEMPLATE_SUFFIX) & ((name == ".env") | F.startswith(name, F.lit(".env.")))


def under_marker(path: Column, markers: list[str] | None = None) -> Column:
    hit = F.lit(False)
    for folder in markers or V.MARKER_DIRS:
        hit = hit | F.startswith(path, F.lit(folder + "/"))
    return hit


def is_own_artifact(path: Column, markers: list[str] | None = None, workflow: str | None = None) -> Column:
    p = slashes(path)
    names = V.GENERATED_DOCUMENTS + V.SEEDED_DOCUMENTS + ([workflow] if workflow else [])
    return p.isin(names) | under_marker(p, markers)


def is_regenerated(path: Column, markers: list[str] | None = None) -> Column:
    """Files rewritten on every run; policy and contract files never are."""
    p = slashes(path)
    authored = [f"{m}/{name}" for m in (markers or V.MARKER_DIRS) for name in (V.POLICY_FILE, V.CONTRACT_FILE)]
    return p.isin(V.GENERATED_DOCUMENTS) | (under_marker(p, markers) & ~p.isin(authored))


def is_brain_artifact(path: Column, markers: list[str] | None = None) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return under_marker(p, markers) | basename(p).isin(V.BRAIN_BASENAMES)


def is_dependency_file(path: Column) -> Column:
    return basename(path).isin(V.DEPENDENCY_FILES)


def is_source_file(path: Column) -> Column:
    return (
        extension(path).isin(V.SOURCE_EXTENSIONS)
        & ~path.rlike(V.GENERATED_NAME)
        & ~has_segment(path, V.SOURCE_SKIP_DIRS)
    )


def owner_path(path: Column) -> Column:
    """The first owner marker a popular path contains, else NULL."""
    hit = F.lit(None).cast("string")
    for marker in reversed(V.OWNER_PATH_MARKERS):
        hit = F.when(F.contains(path, F.lit(marker)), marker).otherwise(hit)
    return hit


def is_unsafe_path(path: Column) -> Column:
    """Empty, NUL, absolute, drive letter, or a parent segment."""
    s = F.trim(F.coalesce(path, F.lit("")))
    norm = normalize_path(s)
    return (
        (s == "")
        | F.contains(s, F.lit("\0"))
        | s.rlike(r"^[/\\]")
        | s.rlike(r"^[a-zA-Z]:[\\/]")
        | norm.isin("", ".", "..")
        | F.array_contains(F.split(norm, "/"), "..")
        | F.startswith(norm, F.lit("/"))
    )


def unsafe_path_for_output(path: Column) -> Column:
    """True when a path must be left out: control characters, or it looks like a credential."""
    return (
        F.coalesce(path, F.lit("")).isin("")
        | path.rlike(r"[\x00-\x1F\x7F]")
        | (redact_credentials(path) != path)
    )


def artifact_uri(path: Column) -> Column:
    """Percent-encoded relative URI of a path; NULL when it must not be emitted."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (
        F.coalesce(path, F.lit("")).isin("")
        | path.rlike(r"[\x00-\x1F\x7F]")
        | norm.rlike(r"^/")
        | norm.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
        | F.exists(F.split(norm, "/", -1), lambda s: s.isin("", ".", ".."))
        | (redact_credentials(norm) != norm)
    )

    def encode(segment: Column) -> Column:
        # form encoding -> URI component encoding
        text = F.url_encode(segment)
        for form, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            text = F.replace(text, F.lit(form), F.lit(plain))
        return text

    return F.when(~bad, F.array_join(F.transform(F.split(norm, "/", -1), encode), "/"))


# --- globs --------------------------------------------------------------------------


def glob_regex(pattern: Column) -> Column:
    """The regular expression of a glob held in a column."""
    pat = slashes(pattern)
    pat = F.when(pat.rlike(r"/$") & ~pat.rlike(r"\*\*/$"), F.concat(pat, F.lit("**"))).otherwise(pat)
    quoted = F.regexp_replace(pat, r"([.+^${}()|\[\]\\])", r"\\$1")
    folder = F.regexp_replace(
        F.regexp_replace(pat, r"/\*\*$", ""), r"([.+*?^${}()|\[\]\\])", r"\\$1"
    )
    wild = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002"))
    wild = F.replace(F.replace(wild, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    wild = F.replace(F.replace(wild, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return (
        F.when(pat == "", F.lit("(?!)"))
        .when(pat == "/**", F.lit(r"(?s).*"))
        .when(pat.rlike(r"/\*\*$"), F.concat(F.lit("(?s)^"), folder, F.lit(r"(?:/.*)?\z")))
        .otherwise(F.concat(F.lit("^"), wild, F.lit(r"\z")))
    )


def glob_literal(pattern: str, dot: str = ".", end: str = r"\z") -> str:
    """The regular expression of a glob known when the query is written (compiled once); ``dot`` and ``end`` in the dialect at hand."""
    pat = re.sub(r"^\./", "", pattern.replace("\\", "/"))
    if not pat:
        return "(?!)"
    if pat.endswith("/") and not pat.endswith("**/"):
        pat += "**"
    quote = lambda s: re.sub(r"([.+*?^${}()|\[\]\\])", r"\\\1", s)
    if pat.endswith("/**"):
        return "(?s).*" if pat == "/**" else "(?s)^" + quote(pat[:-3]) + "(?:/.*)?" + end
    pieces = {"**/": f"(?:{dot}*/)?", "**": f"{dot}*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(pieces.get(t) or quote(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pat))
    return "^" + body + end


def glob_match(path: Column, pattern: Column | str) -> Column:
    if isinstance(pattern, str):
        return slashes(path).rlike(glob_literal(pattern))
    return F.rlike(slashes(path), glob_regex(pattern))


# --- routing of paths ---------------------------------------------------------------


def under_skipped_dir(path: Column) -> Column:
    return has_segment(path, V.ROUTE_SKIP_SEGMENTS)


def is_fixture_path(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.rlike(V.FIXTURE_PATH) | (p.rlike(V.DOCS_PATH) & ~p.rlike("supabase/"))


def is_migration_sql(path: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"(?i)/supabase/migrations/.*\.sql$")


def is_edge_source(path: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))).rlike(
        r"(?i)/supabase/functions/.*\.(ts|js|mjs|tsx|jsx)$"
    )


def is_route_file(path: Column) -> Column:
    return path.rlike(r"^(?:src/)?app/api/(?:.*/)?route\.(ts|tsx|js|mjs)$")


def route_url(path: Column) -> Column:
    """URL of a route file: from its ``api`` segment to the folder that holds it."""
    parts = segments(path)
    at = F.array_position(parts, "api")
    return F.concat(
        F.lit("/"),
        F.array_join(
            F.when(at > 0, F.slice(parts, at.cast("int"), F.greatest(F.size(parts) - at, F.lit(0)).cast("int"))).otherwise(
                F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
            ),
            "/",
        ),
    )
