"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

A document's failures are bits. An existential self-join marks exact copies: a left-semi join on hash, exact text and a smaller
doc_id. The union of these marks with the other failures is added up to one bit combination per document; the numbers of
documents per part and combination answer all 120 orders at once, since whether a filter removes a document in an order only
depends on which of its failing filters comes first.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import narrow, words_of
from wardline.session import cut_lineage

FILTERS = "ABCDE"
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS = 200
#: A text with more than one in so many of all rows is joined in ``SALTS`` parts; so there are at most as many such texts.
HOT_SHARE, SALTS = 1024, 64


def failures(text: Column) -> Column:
    """The bits of filters A to D for a whole text that is not NULL."""
    words = F.col("_words")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(c, F.lit(BITS[name])).otherwise(F.lit(0)) for name, c in failed.items()), F.lit(0))


def _hashed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``part, doc_id, h, g, text``: NULL texts and parts as empty, with two 64-bit hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs, part=F.coalesce(F.col("lang").cast("string"), F.lit("")), doc_id=F.col("doc_id").cast("long"), text=text)
    return rows.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit("second"), "text")}).select(*keep)


def earlier_copies(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """``part, doc_id, h, g`` of each row whose text some row with a smaller doc_id has, too.

    The right side holds one row per distinct text, with the least doc_id, reduced before the shuffle. Rows of a text that many
    rows share are dealt by doc_id over ``SALTS`` parts, each of which meets a copy of that one row.
    """
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > total / HOT_SHARE).select("h"))
    left = _hashed(docs, ["part", "doc_id", "h", "g", "text"]).where(F.col("doc_id").isNotNull())
    least = lambda rows: rows.groupBy("h", "text").agg(F.min("doc_id").alias("least"))
    right = _hashed(docs, ["doc_id", "h", "text"])
    # the other texts meet by (h, text), as their least ids were found, so that a text moves once for either side
    found = left.join(hot, "h", "left_anti").alias("l").join(least(right.join(hot, "h", "left_anti")).alias("r"), _same("h", "text"), "left_semi")
    dealt = left.join(hot, "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = least(right.join(hot, "h", "left_semi")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found_hot = dealt.alias("l").join(copies.alias("r"), _same("h", "salt", "text"), "left_semi")
    return found.unionByName(found_hot.drop("salt")).select("part", "doc_id", "h", "g")


def _same(*columns: str) -> Column:
    equal = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in columns]
    return reduce(and_, equal) & (F.col("r.least") < F.col("l.doc_id"))


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: rows per part and combination of failing filters, and how many of them are labelled so.

    Rows are told apart by doc_id and text; repeated rows count each time. A NULL doc_id has no label, is never a later copy and
    never makes one. A document counts as good or toxic where any of its labels says 1.
    """
    text = F.col("text")
    rows = _hashed(docs, ["part", "doc_id", "h", "g", "text"]).withColumn("_words", words_of(text))
    rows = rows.select("part", "doc_id", "h", "g", failures(text).alias("bits"))
    keys = ["part", "doc_id", "h", "g"]
    counted = cut_lineage(rows.groupBy(*keys, "bits").agg(F.count("*").alias("n")))
    copies = earlier_copies(docs, counted).select(*keys, F.lit(BITS["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    one = counted.unionByName(copies).groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    slim = one.groupBy("part", "doc_id", "bits").agg(F.sum("n").alias("n"))
    marks = narrow(labels, doc_id=F.col("doc_id").cast("long"), good=(F.col("quality") == 1).cast("int"), toxic=(F.col("toxic") == 1).cast("int"))
    marks = marks.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = slim.join(marks, "doc_id", "left")
    weigh = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    return joined.groupBy("part", "bits").agg(F.sum("n").alias("n"), weigh("good"), weigh("toxic"))


def _steps() -> Column:
    """All (order, step, bits of earlier filters, bit of this one) as one constant array of 600."""
    found = []
    for order in permutations(FILTERS):
        for i, name in enumerate(order):
            found.append(("".join(order), i + 1, sum(BITS[x] for x in order[:i]), BITS[name]))
    texts, numbers, before, this = zip(*found, strict=True)
    arrays = [F.lit(list(texts)), F.lit(list(numbers)), F.lit(list(before)), F.lit(list(this))]
    return F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, ("filter_order", "step", "before", "this"), strict=True)])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step, see the columns at the end; an empty table gives no rows.

    Only ``text``, ``lang`` and ``doc_id`` are read, and ``doc_id``, ``quality`` and ``toxic`` of the labels; other columns are
    ignored. NULL and empty texts are equal texts; a NULL ``lang`` belongs to the part of the empty string. A part is one row of at
    most 32 combinations, so that nothing but these numbers is gathered.
    """
    parts = combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("found"))
    rows = parts.select("part", "found", F.inline(_steps()).alias("filter_order", "step", "before", "this"))

    def total(column: str, keep) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("found", zero, lambda a, x: a + F.when(keep(x["bits"]), x[column]).otherwise(zero))

    before, this = F.col("before"), F.col("this")
    fails = lambda b: b.bitwiseAND(this) != 0
    here = lambda b: fails(b) & (b.bitwiseAND(before) == 0)
    # of the orders of the k failing filters, one in k begins with this one: 120 / k orders in which it removes the document
    share = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + F.when(fails(x["bits"]), x["n"] * (F.lit(120) / F.greatest(F.bit_count(x["bits"]), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda b: b.bitwiseAND(before.bitwiseOR(this)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda b: fails(b) & (b.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda b: b == this).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
