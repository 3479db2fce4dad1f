"""Texts against a table of denied terms: all terms at once, by an automaton with failure links.

Terms are dealt into parts of bounded size. A part is built into one automaton per worker, which reads each text once whatever the
number of terms; a table of several parts takes one pass for each, so the driver never holds more than one part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import auth_id, fingerprint
from wardline.session import cut_lineage

#: Code points of the terms of one part; an automaton takes about 100 bytes for each.
PART_CHARS = 4_000_000
#: Rows of texts and matches that are Python objects at a time.
SLICE, MATCHES = 64, 1 << 16


@functools.lru_cache(1)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        found.add_word(term, (number, len(term)))
    found.make_automaton()
    return found


def occurrences(machine, text: str) -> Iterator[tuple[int, int]]:
    """(number of the term, start) of each term's occurrences that do not overlap others of the same term, from the left."""
    free: dict[int, int] = {}
    for last, (number, size) in machine.iter(text):
        start = last - size + 1
        if start >= free.get(number, 0):
            free[number] = last + 1
            yield number, start


def _parts(terms: DataFrame, size: int) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(number of parts, terms of one part), part after part."""
    wanted = cut_lineage(terms.select(F.col("term").cast("string").alias("term")).where(F.length("term") >= 2).distinct())
    total = wanted.agg(F.sum(F.length("term")).alias("n")).first()["n"] or 0
    count = -(-total // size)
    for k in range(count):
        # hashed parts are of nearly equal size
        yield count, tuple(sorted(r["term"] for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(count)) == k).collect()))


def match_terms(df: DataFrame, text: str, keys: list[str], terms: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(*keys, term, index, length, fp, auth_id)``: occurrences of the terms of two code points or more in whole texts.

    ``terms`` has a column ``term``; NULL and repeated terms count once. Occurrences of one term do not overlap; those of different
    terms may. NULL texts have none. ``index`` is the code point before which a match begins.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("term", T.StringType()), T.StructField("index", T.LongType()), T.StructField("length", T.IntegerType())])
    rows = df.select(*keys, F.col(text).alias("_text")).where("_text is not null")

    def search(part: tuple[str, ...]):
        shared = df.sparkSession.sparkContext.broadcast(part)

        def work(batches):
            import pyarrow as pa

            words = shared.value
            machine = _automaton(words)

            def rows_of(piece, at, found, starts):
                # only the keys are repeated for each match, never the text
                held = [piece.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
                columns = [*held, pa.array([words[n] for n in found], pa.string()), pa.array(starts, pa.int64()), pa.array([len(words[n]) for n in found], pa.int32())]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for batch in batches:
                for a in range(0, batch.num_rows, SLICE):
                    piece = batch.slice(a, SLICE)
                    at, found, starts = [], [], []
                    for i in range(piece.num_rows):
                        for number, start in occurrences(machine, piece.column(len(keys))[i].as_py()):
                            at.append(i)
                            found.append(number)
                            starts.append(start)
                            if len(at) == MATCHES:
                                yield rows_of(piece, at, found, starts)
                                at, found, starts = [], [], []
                    yield rows_of(piece, at, found, starts)

        return rows.mapInArrow(work, schema)

    passes = []
    for count, part in _parts(terms, part_chars):
        # with several parts each pass is written before the next part is read
        passes.append(search(part) if count == 1 else cut_lineage(search(part)))
    found = functools.reduce(DataFrame.unionByName, passes) if passes else df.sparkSession.createDataFrame([], schema)
    return found.withColumn("fp", fingerprint(F.col("term"))).withColumn("auth_id", auth_id(F.col("term")))
