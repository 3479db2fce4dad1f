"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but the space and U+0009 to U+000D.
WORD_GAP = "[ \\t-\\r]+"
GAP_CHARS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def narrow(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns, so that no other column of the caller can clash with a working column."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def wrapped(df: DataFrame, **columns: Column) -> DataFrame:
    """The caller's row as one struct ``row`` beside working columns; ``df.select("row.*")`` gives it back."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """A value kept by a Python worker between its tasks."""
    holder = sys.modules.setdefault("_wardline_worker_cache", types.ModuleType("_wardline_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
