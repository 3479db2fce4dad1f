"""Token counts: an exact histogram of encoded lengths answers totals, quantiles and truncated totals for any context limit."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import narrow
from wardline.llm.tokens import encoder, tokenizer_path
from wardline.operators.running import running
from wardline.session import cut_lineage

#: Neighbouring lengths that are summed in one task.
LENGTHS_PER_CHUNK = 512


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length.

    Every whole text is encoded. NULL and empty texts have length 0; repeated rows count each time; an empty table gives no
    rows; other columns are ignored. Each batch is counted before the shuffle, which moves one row per length and task.
    """
    path = tokenizer or tokenizer_path()

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        total: Counter[int] = Counter()
        for batch in batches:
            for _, ids in encoder(path).encode_column(batch.column(0)):
                total.update(pc.divide(pc.binary_length(ids), 4).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["n_tokens", "n"])

    counted = narrow(docs, t=F.col(text)).mapInArrow(count, "n_tokens long, n long")
    return cut_lineage(counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per observed length, read as a context limit.

    ``docs_at_most`` and ``tokens_at_most`` belong to documents that fit whole, ``docs_longer`` to those cut at the limit;
    ``truncated_total`` is the sum of min(length, limit), ``dropped_tokens`` what the cut loses, ``share_at_most`` the
    quantile that the limit is. Between two observed lengths everything is linear in the limit (see ``at_limits``).
    The sums run per chunk of lengths and over chunk totals, so no task holds all lengths.
    """
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens")).withColumn(
        "chunk", F.floor(F.col("n_tokens") / LENGTHS_PER_CHUNK)
    )
    before = running(rows, [], ["n_tokens"], "chunk", {"docs_before": ("sum", "n_docs"), "tokens_before": ("sum", "tokens")})
    back = rows.select((-F.col("n_tokens")).alias("n_tokens"), (-F.col("chunk")).alias("chunk"), "n_docs", "tokens")
    after = running(back, [], ["n_tokens"], "chunk", {"docs_longer": ("sum", "n_docs"), "tokens_longer": ("sum", "tokens")})
    joined = before.join(after.select((-F.col("n_tokens")).alias("n_tokens"), "docs_longer", "tokens_longer"), "n_tokens")
    n, longer = F.col("n_tokens"), F.col("docs_longer")
    at_most, tokens = F.col("docs_before") + F.col("n_docs"), F.col("tokens_before") + F.col("tokens")
    return joined.select(
        "n_tokens", "n_docs", at_most.alias("docs_at_most"), longer.alias("docs_longer"), tokens.alias("tokens_at_most"), (tokens + n * longer).alias("truncated_total"),
        (F.col("tokens_longer") - n * longer).alias("dropped_tokens"), (at_most / (at_most + longer)).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_longer, truncated_total, dropped_tokens`` for any limits, one aggregate over the histogram."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    answers = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(n > limit, d)), F.lit(0)).alias("docs_longer"),
            F.coalesce(F.sum(F.least(n, F.lit(limit)) * d), F.lit(0)).alias("truncated_total"),
            F.coalesce(F.sum(F.when(n > limit, (n - limit) * d)), F.lit(0)).alias("dropped_tokens"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*answers).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of the documents does not exceed."""
    picked = [F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("share_at_most") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return sums.agg(F.array(*picked).alias("a")).select(F.inline("a"))
