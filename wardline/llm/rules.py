"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, DataFrame functions only.

A sketch is a set of counted buckets whose bounds do not depend on the data: whole numbers below 32 have a bucket each, above
that every power of two is cut into 32. Sketches merge by adding counts, give the same result in any order, and place a
quantile within 1/32 of its value. A group's sketch is blended with those of its language and of the corpus, which weigh as much as
a fixed number of documents: small groups follow their language, large ones themselves, and no group changes at a size.

A threshold lies a multiple of the median deviation away from the median. Neither moves much while less than half of a group is junk,
and a group's distance is at most a fixed multiple of its language's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import narrow, words_of, wrapped
from wardline.session import bind, cut_lineage

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: What the sketches of a group's language and of the corpus weigh in its own, in documents, and the parts that a document is counted in.
LANG_WEIGHT, CORPUS_WEIGHT, PARTS = 150, 50, 10_000
#: Measured per 1,000 words (lines for dup_rate): the least distance of a threshold from the median, as a group in which
#: nearly all values are equal has no spread of its own. The lower side is judged for word length only.
LEAST_SPREAD = {"symbol_rate": 250, "dup_rate": 400, "repeat_rate": 250, "word_length": 1500}
BELOW = {"word_length"}
#: A threshold lies this many median deviations away from the median, and at most so many times as far as its language's.
REACH, WIDEST = 6, 4


def with_measures(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of ``text``; each array is built once, long texts cost n log n."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    df = df.select(*keep, words_of(text).alias("_words"), F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("_lines"))
    df = bind(df, "_w", F.col("_words"))
    df = df.select(
        *keep, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") < WINDOW, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
        .alias("_hash"),
    )
    df = bind(df, "_h", F.col("_hash"))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = bind(df, "_s", F.when(repeats, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(e["h"] == F.get("_s", j)["h"], F.lit(False))
    starts = F.filter(F.transform("_s", lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"])), lambda x: x.isNotNull())
    df = bind(df, "_p", F.array_sort(starts))
    following = F.slice("_p", F.lit(2), F.size("_p"))
    covered = F.zip_with("_p", following, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"))
    repeat = F.when(F.coalesce(F.size("_p"), F.lit(0)) > 0, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def rates() -> dict[str, Column]:
    """Whole numbers per 1,000 words or lines; NULL where there are none."""
    per = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN ({a} * 1000) div {b} END")
    return {
        "symbol_rate": per("n_symbols", "n_words"), "dup_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_start(b: Column) -> Column:
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n`` of the documents that pass the base rules; equal buckets are added before the shuffle."""
    values = F.array(*[F.struct(F.lit(name).alias("measure"), c.alias("v")) for name, c in rates().items()])
    each = measured.where(~base_failed()).select("lang", "source", F.inline(values)).where("v IS NOT NULL")
    return each.groupBy("lang", "source", "measure", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """``k, lang, source, measure, bucket, w``: the sketches of groups (k = 0) and languages (k = 1) with those above them added by weight."""
    lang = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    corpus = lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    part = lambda docs, keys: F.expr(f"(n * {docs * PARTS}L) div sum(n) OVER (PARTITION BY {keys})").alias("w")
    own = lang.select("lang", "measure", "bucket", part(LANG_WEIGHT, "lang, measure"))
    above = lang.select("lang", "measure").distinct().join(corpus.select("measure", "bucket", part(CORPUS_WEIGHT, "measure")), "measure")
    base = own.unionByName(above).groupBy("lang", "measure", "bucket").agg(F.sum("w").alias("w"))
    key = F.struct("lang", "measure").alias("g")  # a struct is equal to another where both have NULLs
    groups = sketch.select("source", key).distinct()
    given = groups.join(base.select(key, "bucket", "w"), "g").select("g.lang", "source", "g.measure", "bucket", "w")
    counted = sketch.select("lang", "source", "measure", "bucket", (F.col("n") * PARTS).alias("w"))
    each = given.unionByName(counted).groupBy("lang", "source", "measure", "bucket").agg(F.sum("w").alias("w"))
    return each.select(F.lit(0).alias("k"), "*").unionByName(base.select(F.lit(1).alias("k"), "lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "w"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source, <measure>_low, <measure>_high`` per group; a group has at most a few hundred buckets for each measure."""
    group = Window.partitionBy("k", "lang", "source", "measure")
    half = lambda order: F.sum("w").over(group.orderBy(order)) * 2 >= F.sum("w").over(group)
    b = blended(sketch).select("k", "lang", "source", "measure", "w", bucket_start(F.col("bucket")).alias("v"))
    b = b.withColumn("enough", half("v")).withColumn("median", F.min(F.when(F.col("enough"), F.col("v"))).over(group)).withColumn("off", F.abs(F.col("v") - F.col("median")))
    b = b.withColumn("enough", half("off")).groupBy("k", "lang", "source", "measure").agg(F.max("median").alias("median"), F.min(F.when(F.col("enough"), F.col("off"))).alias("off"))
    floor = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])[F.col("measure")]
    b = cut_lineage(b.select("k", F.struct("lang", "measure").alias("g"), "source", "median", F.greatest(F.col("off") * REACH, floor).alias("reach")))
    widest = b.where("k = 1").select("g", (F.col("reach") * WIDEST).alias("most"))
    fences = b.where("k = 0").join(widest, "g").select("g.*", "source", "median", F.least("reach", "most").alias("reach"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, side)).alias
    columns = [pick(m, F.col("median") + F.col("reach"))(f"{m}_high") for m in LEAST_SPREAD] + [pick(m, F.col("median") - F.col("reach"))(f"{m}_low") for m in LEAST_SPREAD if m in BELOW]
    return fences.groupBy("lang", "source").agg(*columns)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Join the thresholds of each row's group and add ``base_failed`` and ``kept``."""
    limits = limits.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), *limits.columns[2:])
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    fits = F.lit(True)
    for name, rate in rates().items():
        fits &= F.coalesce(rate <= F.col(f"{name}_high"), F.lit(True))
        if name in BELOW:
            fits &= F.coalesce(rate >= F.col(f"{name}_low"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & fits)


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, written once (a few numbers per row): the sketches and the verdict both read them."""
    return cut_lineage(with_measures(narrow(docs, doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"), text=F.col("text")), F.col("text"), ["doc_id", "lang", "source"]))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its counts, ``base_failed`` and ``kept``.

    NULL texts count as empty and fail the base rules; NULL languages and sources are groups of their own; repeated rows are
    judged each; ties fall on the kept side (a value equal to a threshold passes); an empty table gives no rows; columns other
    than doc_id, text, lang and source are ignored.
    """
    measured = measures(docs)
    out = judged(measured, cut_lineage(thresholds(sketches(measured))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; same cases as ``quality_verdicts``."""
    limits = cut_lineage(thresholds(sketches(measures(docs))))
    rows = wrapped(docs, text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    measured = with_measures(rows, F.col("text"), ["row", "lang", "source"])
    return judged(measured, limits).where("kept").select("row.*")
