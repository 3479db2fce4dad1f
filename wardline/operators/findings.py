"""From hits to findings: grouping per file, disclosure of allowed hits, merged views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import let


def findings_by_file(hits: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row per (repo, file, label), blocking and allowed apart; the first hit gives the position.

    Counts and the first hit are partial aggregates, so a hot repo is combined before the shuffle.
    """
    keys = group or ["repo", "path", "label"]
    order = F.struct("hit_order", "index")
    reason = F.when(F.col("allowed"), F.col("reason"))
    return hits.groupBy(*keys, "allowed", reason.alias("reason")).agg(
        F.count("*").alias("count"),
        F.min_by("pattern_id", order).alias("pattern_id"),
        F.min_by("fp", order).alias("fp"),
        F.min_by("auth_id", order).alias("auth_id"),
        F.min_by("index", order).alias("index"),
        F.min_by("length", order).alias("length"),
    )


def collapse_views(hits: Column) -> Column:
    """Merge the views of one occurrence: one entry per (kind, auth_id, span) with its ``views``.

    Sorting by that key puts an occurrence's few views next to each other, so the
    merge is a pass over neighbours instead of a comparison of all pairs.
    """
    keyed = F.array_sort(
        F.transform(
            hits,
            lambda h, i: F.struct(
                h["kind"].alias("kind"),
                h["auth_id"].alias("auth_id"),
                h["original_index"].alias("start"),
                h["original_length"].alias("length"),
                i.alias("order"),
                h.alias("hit"),
            ),
        )
    )

    def same(a: Column, b: Column) -> Column:
        return (
            (a["start"] == b["start"]) & (a["length"] == b["length"]) & (a["kind"] == b["kind"]) & (a["auth_id"] == b["auth_id"])
        )

    def merge(rows: Column) -> Column:
        new = lambda x, i: (i == 0) | ~F.coalesce(same(F.get(rows, i - 1), x), F.lit(False))
        starts = F.filter(F.transform(rows, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())

        def group(run: Column) -> Column:
            views = F.array_distinct(F.transform(run, lambda y: y["hit"]["view"]))
            return F.struct(F.get(run, F.lit(0))["order"].alias("order"), F.get(run, F.lit(0))["hit"].alias("hit"), views.alias("views"))

        leaders = let(
            starts, lambda at: F.transform(at, lambda p, k: let(F.slice(rows, p + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - p), group))
        )
        return F.transform(
            F.array_sort(F.transform(leaders, lambda x: F.struct(x["order"].alias("order"), x["hit"].alias("hit"), x["views"].alias("views")))),
            lambda x: F.struct(
                x["hit"]["kind"].alias("kind"),
                x["hit"]["pattern_id"].alias("pattern_id"),
                x["hit"]["label"].alias("label"),
                x["hit"]["fp"].alias("fp"),
                x["hit"]["auth_id"].alias("auth_id"),
                x["hit"]["original_index"].alias("start"),
                x["hit"]["original_length"].alias("length"),
                x["hit"]["allowed"].alias("allowed"),
                F.when(F.array_contains(x["views"], "raw"), "raw").otherwise(x["hit"]["view"]).alias("view"),
                x["views"].alias("views"),
            ),
        )

    return let(keyed, merge)


def collapse_view_rows(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The same merge over exploded hits, as one aggregation with partial combine."""
    raw_first = F.struct((F.col("view") != "raw").cast("int"), F.col("hit_order"))
    return hits.groupBy(*keys, "kind", "auth_id", "original_index", "original_length").agg(
        F.min_by("pattern_id", "hit_order").alias("pattern_id"),
        F.min_by("label", "hit_order").alias("label"),
        F.min_by("view", raw_first).alias("view"),
        F.array_sort(F.collect_set("view")).alias("views"),
    )
