"""Paths against tables of globs: an equi join on what a glob fixes, then only the candidates are matched.

A glob fixes the folders before its first wildcard and some letters of the name: its end, its beginning, or some inside. Paths meet globs
on both at once, as in a trie: each path is looked up for every folder above it with every length of letters that the globs fix. Globs without a wildcard, and whole folders, are settled by the
join; for the rest each worker compiles a glob once.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.paths import glob_literal, slashes
from wardline.session import bind, broadcast_if_small, cut_lineage, spread

#: Compiled globs that a worker keeps.
COMPILED = 1 << 16
#: Letters at the ends of a name, and inside of it, that are looked up at most; globs that fix more are matched on all of them.
ENDS, INSIDE = 16, 8
#: What a dot stands for in the regular expressions of the JVM, outside of folder globs.
LINE_CHAR = "[^\\n\\r\\x85\\u2028\\u2029]"


@functools.lru_cache(COMPILED)
def _compiled(glob: str) -> re.Pattern:
    return re.compile(glob_literal(glob, LINE_CHAR, r"\Z"))


@F.pandas_udf(T.BooleanType())
def _matches(path: pd.Series, glob: pd.Series) -> pd.Series:
    return pd.Series([_compiled(g).search(p) is not None for p, g in zip(path, glob, strict=True)])


def _key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def plain_glob(glob: Column) -> Column:
    """Forward slashes; a folder stands for all below it."""
    pat = slashes(glob)
    return F.when(pat.endswith("/") & ~pat.endswith("**/"), F.concat(pat, F.lit("**"))).otherwise(pat)


def glob_key(pat: Column) -> Column:
    """struct<kind, value, sure>: what every path that a plain glob matches must have; ``sure`` where that is enough. NULL matches nothing.

    A glob with a wildcard below its folders also fixes the end, the beginning or some letters of the name: kinds ``tail``, ``head`` and
    ``mid`` with their length, in the folder (``under``) or anywhere (``any``).
    """
    wild = pat.rlike(r"[*?]")
    folder = F.regexp_extract(pat, r"^((?:[^*?/]*/)*)", 1)
    above = F.left(folder, F.length(folder) - 1)
    last = F.substring_index(pat, "/", -1)
    tail = F.right(F.regexp_extract(last, r"([^*?]*)$", 1), F.lit(ENDS))
    # what two stars match may begin or end inside of a name
    whole = ~last.contains("**") & ~pat.rlike(r"[^/]\*\*/[^/]*$")
    head = F.when(whole, F.left(F.regexp_extract(last, r"^([^*?]*)", 1), F.lit(ENDS))).otherwise("")
    mid = F.when(~last.contains("**"), F.left(F.regexp_extract(last, r"([^*?]+)", 1), F.lit(INSIDE))).otherwise("")
    fixed = lambda name, text: F.struct(F.concat(F.lit(name), F.length(text).cast("string")).alias("part"), text.alias("text"))
    letters = F.when((tail != "") & (F.length(tail) >= F.length(head)), fixed("tail", tail)).when(head != "", fixed("head", head)).when(mid != "", fixed("mid", mid))
    scope, place = F.when(folder != "", "under").otherwise("any"), F.when(folder != "", above).otherwise("")
    key = lambda kind, value, sure: F.struct(kind.alias("kind"), value.alias("value"), F.lit(sure).alias("sure"))
    found = (
        F.when(~wild, key(F.lit("under"), pat, "exact"))
        .when(pat == "/**", key(F.lit("any"), F.lit(""), "all"))
        .when((folder != "") & (pat == F.concat(folder, F.lit("**"))), key(F.lit("under"), above, "all"))
        .when(letters.isNotNull(), key(F.concat_ws(" ", scope, letters["part"]), F.concat(place, F.lit("\0"), letters["text"]), "no"))
        .otherwise(key(scope, place, "no"))
    )
    return F.when(pat != "", found)


def path_keys(path: Column, kinds: list[str]) -> Column:
    """All keys of the given kinds under which a path can be found."""
    parts = F.split(path, "/", -1)
    last = F.get(parts, F.size(parts) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    scopes = {"under": above, "any": F.array(F.lit(""))}

    def letters(part: str) -> Column:
        name, n = part[: 3 if part.startswith("mid") else 4], int(part.lstrip("abcdefghijklmnopqrstuvwxyz"))
        if name == "mid":
            found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(last) - n + 1), lambda i: F.substring(last, i, F.lit(n))))
        else:
            found = F.array(F.left(last, F.lit(n)) if name == "head" else F.right(last, F.lit(n)))
        return F.when(F.length(last) >= n, found).otherwise(F.array().cast("array<string>"))

    def keys(kind: str) -> Column:
        scope, _, part = kind.partition(" ")
        if not part:
            return F.transform(scopes[scope], lambda f: _key(kind, f))
        texts = letters(part)
        return F.flatten(F.transform(scopes[scope], lambda f: F.transform(texts, lambda x: _key(kind, F.concat(f, F.lit("\0"), x)))))

    return F.concat(*[keys(kind) for kind in kinds])


def match_globs(paths: DataFrame, globs: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, path, …)`` for every distinct path and every row of ``globs`` ``(*group, glob, …)`` of its group that matches it.

    NULL paths and globs match nothing; the columns of ``globs`` come along.
    """
    rules = bind(globs.where("glob is not null"), "_pat", plain_glob(F.col("glob")))
    rules = bind(rules, "_k", glob_key(F.col("_pat"))).where("_k is not null")
    rules = cut_lineage(rules.select(*globs.columns, F.col("_k.kind").alias("_kind"), F.col("_k.value").alias("_value"), F.col("_k.sure").alias("_sure")))
    # a path is cut only as the globs at hand need it; there are at most some ninety kinds
    kinds = sorted(r["_kind"] for r in rules.select("_kind").distinct().collect()) or ["under"]
    looked = spread(paths.select(*group, "path").where("path is not null").distinct(), *group, "path").withColumn("_plain", slashes(F.col("path")))
    looked = looked.select(*group, "path", "_plain", F.explode(path_keys(F.col("_plain"), kinds)).alias("_k")).select(
        *group, "path", "_plain", F.col("_k.kind").alias("_kind"), F.col("_k.value").alias("_value")
    )
    met = looked.join(broadcast_if_small(rules), [*group, "_kind", "_value"])
    columns = [*group, "path", *[c for c in globs.columns if c not in group]]
    settled = met.where((F.col("_sure") == "all") | ((F.col("_sure") == "exact") & (F.col("_plain") == F.col("_value"))))
    tried = met.where("_sure = 'no'").where(_matches("_plain", "glob"))
    return settled.select(*columns).unionByName(tried.select(*columns))


def first_globs(paths: DataFrame, globs: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, path, glob)``: of the matching globs the one with the least ``pos``."""
    return match_globs(paths, globs, group).groupBy(*group, "path").agg(F.min_by("glob", "pos").alias("glob"))
