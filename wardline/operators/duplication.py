"""Where files grow and repeat: sizes, churn, duplicate blocks, complexity and the ranking over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.text import (
    collapse_score, let, line_count, looks_generated, move_for, normalized_lines, size_tier,
)
from wardline.operators.graph import components
from wardline.session import cut_lineage

WINDOW_KEY = ["w1", "w2"]


def line_windows(df: DataFrame, text: str, keys: list[str], k: int = V.DUP_WINDOW) -> DataFrame:
    """Every window of ``k`` consecutive normalized lines of each text.

    A text is one cell, so its windows are cut inside the row: no shuffle. Lines are
    hashed once with two seeds and windows are hashes of hashes (128 bits in all).
    """

    def windows(lines: Column) -> Column:
        seeded = F.struct(
            F.transform(lines, lambda x: F.xxhash64(F.lit(1), x["norm"])).alias("a"),
            F.transform(lines, lambda x: F.xxhash64(F.lit(2), x["norm"])).alias("b"),
        )
        last = F.size(lines) - k
        return F.when(
            last >= 0,
            let(
                seeded,
                lambda h: F.transform(
                    F.sequence(F.lit(0), last),
                    lambda i: F.struct(
                        i.alias("pos"),
                        F.get(lines, i)["line"].alias("line_from"),
                        F.get(lines, i + k - 1)["line"].alias("line_to"),
                        F.xxhash64(F.slice(h["a"], i + 1, F.lit(k))).alias("w1"),
                        F.xxhash64(F.slice(h["b"], i + 1, F.lit(k))).alias("w2"),
                    ),
                ),
            ),
        )

    return df.select(*keys, F.inline(let(normalized_lines(F.col(text)), windows)))


def hot_windows(windows: DataFrame, min_occurrences: int = V.DUP_MIN_OCCURRENCES) -> DataFrame:
    """Windows that occur often enough. Counts combine before the shuffle, so a hot window is cheap."""
    return windows.groupBy(*WINDOW_KEY).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= min_occurrences)


def hot_members(windows: DataFrame, min_occurrences: int = V.DUP_MIN_OCCURRENCES) -> DataFrame:
    """The occurrences of hot windows: a join against one row per hot window (AQE splits a skewed side).

    The windows are written once, a few numbers each, so that no text is cut twice.
    """
    windows = cut_lineage(windows)
    return windows.join(hot_windows(windows, min_occurrences), WINDOW_KEY)


def merge_blocks(members: DataFrame, keys: list[str], k: int = V.DUP_WINDOW) -> DataFrame:
    """Overlapping or touching hot windows of one file become maximal blocks of original lines.

    A file's hot starts fit one row (the file itself is one cell), so islands are
    found over a sorted array.
    """
    starts = members.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("pos", "line_from", "line_to"))).alias("starts")
    )

    def islands(s: Column) -> Column:
        opens = lambda i: (i == 0) | (F.get(s, i)["pos"] - F.get(s, i - 1)["pos"] > k)
        closes = lambda i: (i == F.size(s) - 1) | (F.get(s, i + 1)["pos"] - F.get(s, i)["pos"] > k)
        first = F.filter(F.transform(s, lambda x, i: F.when(opens(i), x["line_from"])), lambda x: x.isNotNull())
        last = F.filter(F.transform(s, lambda x, i: F.when(closes(i), x["line_to"])), lambda x: x.isNotNull())
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("line_from"), b.alias("line_to")))

    return starts.select(*keys, F.posexplode(let(F.col("starts"), islands)).alias("block", "b")).select(
        *keys, (F.col("block") + 1).alias("block"), "b.line_from", "b.line_to"
    )


def shared_members(members: DataFrame, keys: list[str]) -> DataFrame:
    """The complete relation: one row ``(*keys, w1, w2, files)`` per file and hot window that it has, with the number of files that have it."""
    occurrences = members.select(*keys, *WINDOW_KEY).distinct()
    return occurrences.join(occurrences.groupBy(*WINDOW_KEY).agg(F.count("*").alias("files")), WINDOW_KEY).select(*keys, *WINDOW_KEY, "files")


def shared_with(members: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: its class, how many files that has, and its links.

    Files with a hot window in common are of one class, and so are those that other files join; a class is named by its least file. Links
    are ``hot_windows``, the file's, ``shared_windows``, those that another file has, too, and ``shared_files``, the other files of
    each, added up. Which files share which window is in ``shared_members``; file pairs are never formed: the graph has a link from each
    file to the least file of each of its windows.
    """
    rows = cut_lineage(shared_members(members, keys).select(F.struct(*keys).alias("file"), *WINDOW_KEY, "files"))
    least = rows.groupBy(*WINDOW_KEY).agg(F.min("file").alias("least"))
    links = rows.join(least, WINDOW_KEY).select(F.col("file").alias("a"), F.col("least").alias("b"))
    roots = cut_lineage(components(links))
    sizes = roots.groupBy("root").agg(F.count("*").alias("class_files"))
    counts = rows.groupBy("file").agg(
        F.count("*").alias("hot_windows"), F.count_if(F.col("files") > 1).alias("shared_windows"), F.sum(F.col("files") - 1).alias("shared_files")
    )
    found = counts.join(roots, F.col("file") == F.col("node")).join(sizes, "root")
    return found.select("file.*", F.col("root").alias("class"), "class_files", "hot_windows", "shared_windows", "shared_files")


# --- churn ---------------------------------------------------------------------------------


def newest_commits(commits: DataFrame, n: int | None = None, repo: str = "repo", order: tuple[str, str] = ("ts", "commit")) -> DataFrame:
    """All commits or the newest ``n`` of each repo; the rank filter limits each task before the shuffle."""
    if n is None:
        return commits
    rank = Window.partitionBy(repo).orderBy(F.desc(order[0]), F.desc(order[1]))
    return commits.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_rank")


def churn(commits: DataFrame, touches: DataFrame, n: int | None = None) -> DataFrame:
    """Touches per (repo, path) within all commits, or within the newest ``n`` of each repo."""
    recent = newest_commits(commits, n).select("repo", "commit")
    return touches.join(recent, ["repo", "commit"]).groupBy("repo", "path").agg(F.count("*").alias("churn"))


# --- complexity -------------------------------------------------------------------------------

_STRINGS_AND_COMMENTS = (
    r"/\*[\s\S]*?(?:\*/|\z)|//[^\n]*|([\"'`])(?:(?!\1)[^\\]|\\[\s\S])*+(?:\1|\z)"
)
_BRANCH = (
    r"(?<![A-Za-z0-9_])(?:if|for|while|case|catch)(?![A-Za-z0-9_])|&&|\|\|"
)


def strip_comments_and_strings(text: Column) -> Column:
    return F.regexp_replace(text, _STRINGS_AND_COMMENTS, "$1$1")


def complexity(text: Column, norm_lines: Column) -> Column:
    """struct<max_nesting, many_param_fns, branches_per_100>, approximate by design."""

    def build(code: Column) -> Column:
        depth = F.aggregate(
            F.regexp_extract_all(code, F.lit("[{}]"), F.lit(0)),
            F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
            lambda acc, c: let(
                F.when(c == "{", acc["now"] + 1).otherwise(F.greatest(acc["now"] - 1, F.lit(0))),
                lambda now: F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top")),
            ),
        )
        params = F.concat(
            F.regexp_extract_all(code, F.lit(r"(?<![A-Za-z0-9_])function\s*\w*\s*\(([^()]*)\)"), F.lit(1)),
            F.regexp_extract_all(code, F.lit(r"\(([^()]*)\)\s*=>"), F.lit(1)),
        )
        many = F.filter(params, lambda p: (F.trim(p) != "") & (F.size(F.split(F.trim(p), ",", -1)) >= 6))
        branches = F.regexp_count(code, F.lit(_BRANCH))
        return F.struct(
            depth["top"].alias("max_nesting"),
            F.size(many).alias("many_param_fns"),
            F.when(norm_lines > 0, F.floor(branches / norm_lines * 100 + 0.5)).otherwise(0).cast("int").alias("branches_per_100"),
        )

    return let(strip_comments_and_strings(text), build)


# --- ranking --------------------------------------------------------------------------------------


def line_counts(files: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``lines, generated, size_tier`` of every file; a generated file has no tier."""
    rows = files.select(*keys, line_count(F.col(text)).alias("lines"), looks_generated(F.col(text)).alias("generated"))
    return rows.withColumn("size_tier", F.when(~F.col("generated"), size_tier(F.col("lines"))))


def file_metrics(sizes: DataFrame, churned: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Size with churn and duplicate blocks, both 0 where absent."""
    dup = blocks.groupBy(*keys).agg(F.count("*").alias("duplicate_blocks"))
    return (
        sizes.join(churned, keys, "left")
        .join(dup, keys, "left")
        .select(
            *sizes.columns,
            F.coalesce("churn", F.lit(0).cast("bigint")).alias("churn"),
            F.coalesce("duplicate_blocks", F.lit(0).cast("bigint")).alias("duplicate_blocks"),
        )
    )


def is_candidate() -> Column:
    return (
        (F.col("lines") > V.SIZE_NOTICE)
        | (F.col("duplicate_blocks") > 0)
        | ((F.col("churn") >= V.HOT_CHURN) & (F.col("lines") >= V.HOT_MIN_LINES))
    )


def collapse_candidates(metrics: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The ``top`` heaviest files by size, churn and duplication."""
    scored = metrics.where(is_candidate()).withColumn(
        "score", collapse_score(F.col("lines"), F.col("churn"), F.col("duplicate_blocks"))
    )
    return (
        scored.orderBy(F.desc("score"), F.desc("lines"), *keys)
        .limit(top)
        .withColumn("move", move_for(F.col("lines"), F.col("churn"), F.col("duplicate_blocks")))
    )


def accretion_band(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How loud the signals are: severe, notable or quiet."""
    grouped = metrics.groupBy(*(keys or [])).agg(
        F.count("*").alias("files"),
        F.count_if(F.col("size_tier") == "notice").alias("notice"),
        F.count_if(F.col("size_tier") == "warn").alias("warn"),
        F.count_if(F.col("size_tier") == "flag").alias("flag"),
        F.coalesce(F.sum("duplicate_blocks"), F.lit(0)).cast("bigint").alias("duplicate_blocks"),
        F.count_if(F.col("churn") >= V.HOT_CHURN).alias("hot_files"),
        F.coalesce(F.bool_or((F.col("size_tier") == "warn") & (F.col("churn") >= V.HOT_CHURN)), F.lit(False)).alias("_hot_warn"),
        F.count_if(is_candidate()).alias("candidates"),
    )
    loud = (F.col("flag") > 0) | F.col("_hot_warn") | (F.col("duplicate_blocks") >= 5)
    return grouped.withColumn(
        "band", F.when(loud, "severe").when(F.col("candidates") > 0, "notable").otherwise("quiet")
    ).drop("_hot_warn")


def severe_hotspots(sizes: DataFrame, churned: DataFrame, keys: list[str]) -> DataFrame:
    """The cheap advisory: large files, or big and hot ones; no duplication pass."""
    hot = F.coalesce("churn", F.lit(0)) >= V.HOT_CHURN
    severe = (F.col("lines") > V.SIZE_FLAG) | ((F.col("lines") > V.SIZE_WARN) & hot)
    return sizes.join(churned, keys, "left").agg(F.count_if(severe).alias("severe_hotspots"))
