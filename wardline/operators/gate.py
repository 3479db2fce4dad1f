"""PASS / BLOCK / REDACT over a column of payload texts, as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.text import auth_id, fingerprint, let
from wardline.operators.detect import denylist_hits, pii_hits, secret_hits
from wardline.operators.findings import collapse_views
from wardline.operators.policy import builtin_reason
from wardline.session import bind


def mask(hit: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), hit["pattern_id"], F.lit(":"), F.left(hit["auth_id"], F.lit(8)), F.lit("]"))


def payload_hits(text: Column, denylist: list[str] | None = None) -> Column:
    """Secrets in every view, personal data and denied terms, merged per occurrence; no raw value."""
    parts = [secret_hits(text, evasions=True), pii_hits(text)]
    if denylist:
        parts.append(denylist_hits(text, denylist))
    identified = F.transform(
        F.concat(*parts),
        lambda h: F.struct(
            h["kind"].alias("kind"),
            h["pattern_id"].alias("pattern_id"),
            h["label"].alias("label"),
            h["view"].alias("view"),
            h["original_index"].alias("original_index"),
            h["original_length"].alias("original_length"),
            fingerprint(h["raw"]).alias("fp"),
            auth_id(h["raw"]).alias("auth_id"),
            ((h["kind"] == "secret") & builtin_reason(h["raw"], h["pattern_id"]).isNotNull()).alias("allowed"),
        ),
    )
    return collapse_views(identified)


def redact_spans(text: Column, blocking: Column) -> Column:
    """Replace blocking spans by their masks, right to left; spans that overlap become one, under the mask of the one that starts first."""

    def rebuild(spans: Column) -> Column:
        # spans are sorted by start, then end, descending; overlap is only possible with the last kept one
        clash = F.exists(
            F.transform(spans, lambda s, i: (i > 0) & (s["end"] > F.get(spans, i - 1)["start"])), lambda x: F.coalesce(x, F.lit(False))
        )
        last = lambda kept: F.element_at(F.concat(kept, F.array(kept_or_first)), F.greatest(F.size(kept), F.lit(1)))
        kept_or_first = F.get(spans, F.lit(0))
        merged = F.aggregate(
            spans,
            F.slice(spans, F.lit(1), F.lit(0)),
            lambda kept, s: F.when((F.size(kept) == 0) | (s["end"] <= last(kept)["start"]), F.concat(kept, F.array(s))).otherwise(
                F.concat(
                    F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))),
                    F.array(F.struct(s["start"].alias("start"), F.greatest(s["end"], last(kept)["end"]).alias("end"), s["mask"].alias("mask"))),
                )
            ),
        )

        def pieces(kept: Column) -> Column:
            ordered = F.reverse(kept)

            def stitched(spans_asc: Column) -> Column:
                parts = F.transform(
                    spans_asc,
                    lambda s, i: F.concat(
                        F.substring(
                            text,
                            (F.coalesce(F.get(spans_asc, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                            (s["start"] - F.coalesce(F.get(spans_asc, i - 1)["end"], F.lit(0))).cast("int"),
                        ),
                        s["mask"],
                    ),
                )
                tail = F.substring(text, (F.element_at(spans_asc, -1)["end"] + 1).cast("int"), F.length(text))
                return F.concat(F.array_join(parts, ""), tail)

            return F.when(F.size(kept) > 0, let(ordered, stitched)).otherwise(text)

        return let(F.when(clash, merged).otherwise(spans), pieces)

    spans = F.transform(
        blocking,
        lambda h: F.struct(
            h["start"].alias("start"),
            F.least(h["start"] + h["length"], F.length(text).cast("bigint")).alias("end"),
            mask(h).alias("mask"),
        ),
    )
    return let(F.reverse(F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"]))), rebuild)


def redaction_map_hash(blocking: Column) -> Column:
    """SHA-256 of the canonical JSON object of masks, sorted, first identity per mask."""

    def canonical(pairs: Column) -> Column:
        firsts = F.filter(pairs, lambda p, i: (i == 0) | (F.get(pairs, i - 1)["mask"] != p["mask"]))
        body = F.transform(firsts, lambda p: F.concat(F.lit('"'), p["mask"], F.lit('":"'), p["auth_id"], F.lit('"')))
        return F.sha2(F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")), 256)

    pairs = F.array_sort(
        F.transform(blocking, lambda h, i: F.struct(mask(h).alias("mask"), i.alias("order"), h["auth_id"].alias("auth_id")))
    )
    return F.when(F.size(blocking) > 0, let(pairs, canonical))


def gate(df: DataFrame, text: str, redact: bool = False, denylist: list[str] | None = None) -> DataFrame:
    """Add the gate's decision to each payload row: action, hits, hash of the redaction map, bytes,
    digest and, when asked for, the redacted text. Works on batch and streaming frames alike."""
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = bind(df, "_all", payload_hits(body, denylist))
    kept = F.filter("_all", lambda h: ~h["allowed"])
    split = scanned.select(
        *df.columns, kept.alias("hits"), F.size(F.filter("_all", lambda h: h["allowed"])).alias("allowed_hits")
    )
    blocked = F.size("hits") > 0
    columns = [
        F.when(~blocked, "PASS").otherwise("REDACT" if redact else "BLOCK").alias("action"),
        redaction_map_hash(F.col("hits")).alias("redaction_map_hash"),
        F.octet_length(body).cast("bigint").alias("bytes"),
        F.sha2(body, 256).alias("sha256"),
    ]
    if redact:
        columns.append(F.when(blocked, redact_spans(body, F.col("hits"))).alias("redacted"))
    return split.select("*", *columns)


def closed_reason(reason: Column, truncated: Column) -> Column:
    """NULL unless truncated; unknown reasons read ``error``."""
    return F.when(truncated, F.when(reason.isin(V.GATE_REASONS), reason).otherwise("error"))


def proof_record(gated: DataFrame, keys: list[str], truncated: Column | None = None, reason: Column | None = None) -> DataFrame:
    """The append-only proof of a gate run: identities only, never the text or a raw match."""
    cut = F.lit(False) if truncated is None else truncated
    why = F.lit(None).cast("string") if reason is None else reason
    return gated.select(
        *keys,
        F.lit(1).alias("version"),
        F.lit("gate").alias("command"),
        "bytes",
        "sha256",
        "action",
        cut.alias("truncated"),
        closed_reason(why, cut).alias("reason"),
        F.transform(
            "hits",
            lambda h: F.struct(
                h["kind"].alias("kind"), h["pattern_id"].alias("pattern_id"), h["label"].alias("label"),
                h["fp"].alias("fp"), h["auth_id"].alias("auth_id"), h["view"].alias("view"), h["views"].alias("views"),
            ),
        ).alias("hits"),
        "redaction_map_hash",
    )
