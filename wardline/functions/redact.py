"""Redaction chains: Column in, Column out, literal patterns only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.text import let, replace_all


def redact_credentials(text: Column) -> Column:
    """Keep the public shape of a credential, drop its value (display text, paths, messages)."""
    return replace_all(F.coalesce(text, F.lit("")), V.CREDENTIAL_REDACTIONS)


def redact_all(text: Column) -> Column:
    """Outbound text: wide shapes first, then every catalogue detector without its validator."""
    rules = [*V.OUTBOUND_REDACTIONS, *((anchors, pattern) for _, _, anchors, pattern in V.SECRET_DETECTORS)]

    def chain(given: Column) -> Column:
        # the mask brings no anchor and no shared part, so what the given text lacks stays absent along the chain
        return replace_all(
            given["text"],
            [
                (pattern, V.OUTBOUND_MASK, anchors, [given[f"part{i}"] for i, part in enumerate(V.OUTBOUND_SHARED) if all(part in a for a in anchors)])
                for anchors, pattern in rules
            ],
        )

    parts = lambda t: [F.contains(t, F.lit(part)).alias(f"part{i}") for i, part in enumerate(V.OUTBOUND_SHARED)]
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.struct(t.alias("text"), *parts(t)), chain))


def redact_paths_user(text: Column, home_dir: str = "", username: str = "") -> Column:
    """Home folder, user segment and absolute paths."""
    quote = lambda s: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)
    rules: list[tuple[str, str]] = []
    if len(home_dir) > 1:
        rules.append(("(?i)" + quote(home_dir), "[HOME]"))
        if "\\" in home_dir:
            rules.append(("(?i)" + quote(home_dir.replace("\\", "/")), "[HOME]"))
    if len(username) >= 2:
        for folder in ("Users", "home"):
            rules.append((rf"(?i)([/\\]{folder}[/\\])" + quote(username) + V.WORD_EDGE, "$1[USER]"))
    return replace_all(F.coalesce(text, F.lit("")), rules + V.ABSOLUTE_PATHS)


def redact_token(text: Column, token: str = "") -> Column:
    """Bearer headers, token shapes, and the token in use when it has eight characters or more."""
    out = replace_all(F.coalesce(text, F.lit("")), V.TOKEN_REDACTIONS)
    secret = token.strip()
    return F.replace(out, F.lit(secret), F.lit("[REDACTED]")) if len(secret) >= 8 else out


def sanitize_markdown(text: Column) -> Column:
    """Text that is safe inside a Markdown comment: no markup, links, mentions or credentials."""
    return redact_credentials(replace_all(F.coalesce(text, F.lit("")), V.MARKDOWN_CLEANUPS))
