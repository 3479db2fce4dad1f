"""Running values over long ordered groups, without putting a group into one task.

A plain window sorts a whole key in one task. Here rows are windowed per (key, chunk),
each chunk is summarised by one row, the few summaries are windowed per key, and the two
are combined. A chunk is any column that never decreases along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import broadcast_if_small

CHUNK_ROWS = 1 << 16


def chunk_of(order: Column, size: int = CHUNK_ROWS) -> Column:
    """Chunks of a dense numeric order."""
    return F.floor(order / size)


def running(df: DataFrame, keys: list[str], order: list[str], chunk: str, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add values over the rows before each row. ``specs`` maps a new column to ``(kind, column)``:

    ``max``, ``sum`` and ``count_if`` over all rows before, ``last`` non-NULL value before, ``lag`` the
    value of the row just before, ``number`` the 1-based position of the row itself.
    """
    before = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys, chunk).orderBy(*order)
    chunks_before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    chunk_order = Window.partitionBy(*keys).orderBy(chunk)
    position = F.struct(*order)
    # struct ordering is NULL-safe; a wrapped value keeps "no row" and "NULL in the row before" apart
    local, summary, carried, combined = [], [], [], []
    for name, (kind, column) in specs.items():
        a, b, c = f"_l_{name}", f"_s_{name}", f"_c_{name}"
        value = F.col(column) if column else F.lit(1)
        if kind == "max":
            local.append(F.max(value).over(before).alias(a))
            summary.append(F.max(value).alias(b))
            carried.append(F.max(b).over(chunks_before).alias(c))
            combined.append(F.greatest(F.col(c), F.col(a)).alias(name))
        elif kind in ("sum", "count_if"):
            number = value.cast("int") if kind == "count_if" else value
            local.append(F.sum(number).over(before).alias(a))
            summary.append(F.sum(number).alias(b))
            carried.append(F.sum(b).over(chunks_before).alias(c))
            combined.append((F.coalesce(c, F.lit(0)) + F.coalesce(a, F.lit(0))).alias(name))
        elif kind == "number":
            local.append(F.row_number().over(here).alias(a))
            summary.append(F.count("*").alias(b))
            carried.append(F.sum(b).over(chunks_before).alias(c))
            combined.append((F.coalesce(c, F.lit(0)) + F.col(a)).cast("bigint").alias(name))
        elif kind == "last":
            local.append(F.last(value, ignorenulls=True).over(before).alias(a))
            summary.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(b))
            carried.append(F.last(b, ignorenulls=True).over(chunks_before).alias(c))
            combined.append(F.coalesce(a, c).alias(name))
        elif kind == "lag":
            wrapped = F.struct(value.alias("v"))
            local.append(F.lag(wrapped).over(here).alias(a))
            summary.append(F.max_by(wrapped, position).alias(b))
            carried.append(F.lag(b).over(chunk_order).alias(c))
            combined.append(F.coalesce(a, c)["v"].alias(name))
        else:
            raise ValueError(kind)
    rows = df.select("*", *local)
    carry = df.groupBy(*keys, chunk).agg(*summary).select(*keys, chunk, *carried)
    return rows.join(broadcast_if_small(carry), [*keys, chunk]).select(*df.columns, *combined)
