"""Substring deduplication by relative Lempel-Ziv parsing of every document against the indexed corpus.

The reference is the corpus itself. Its phrases (runs of windows with one anchor, see ``anchors.py``) are indexed in blocks: a
block is one partition of the phrase index, and each phrase of a document is looked up in the block that its anchor belongs
to, so a document is parsed against all blocks without meeting each block's text. The parse is greedy: from left to right, a factor
goes on while the next phrase is found and its source place follows that of the phrase before; else it ends and the next
begins. A factor has at least one window. Where a factor ends, the windows at its boundary are compared with the other
contents of the same anchor (``repeats.py``), so that the spans are exact to the word.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.repeats import Alphabet, keyed, packed, repeated_windows, texts_of, with_spans, word_codes

WINDOW = 35
GRAM = 8


def words(window: int = WINDOW) -> Alphabet:
    return Alphabet(word_codes, lambda codes: codes, np.uint64, window, min(GRAM, window))


def factors(spans: list[dict] | None, window: int) -> list[tuple[int, int, int | None, int | None]]:
    """Greedy factors ``(first word, words, source document, first word there)`` of one text from its found phrases."""
    out: list[list] = []
    last = None
    for place, source_id, source_place in sorted(((s["place"], s["source_id"], s["source_place"]) for s in spans or ()), key=lambda s: s[0]):
        start, count = place >> 8, place & 255
        source = None if source_place is None else source_place >> 8
        shift = None if source is None else start - source
        if out and start <= last and shift is not None and out[-1][2] == source_id and out[-1][4] == shift:
            out[-1][1] = max(out[-1][1], start + count + window - 1 - out[-1][0])
        else:
            out.append([start, count + window - 1, source_id, source, shift])
        last = max(last or 0, start + count)
    return [tuple(f[:4]) for f in out]


def in_factors(found: list[tuple], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for start, length, *_ in found:
        edge[start] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def parsed(docs: DataFrame, window: int = WINDOW, keep: dict | None = None) -> DataFrame:
    """``doc_id, text_key, z, given`` (the doc_id of the table, and further columns) with the ``spans`` found in each text."""
    rows = keyed(docs, F.col("doc_id"), F.col("text"), given=F.col("doc_id").cast("long"), **(keep or {}))
    z = packed(rows)
    return with_spans(z, repeated_windows(rows.select("doc_id", "text_key", "text"), z, words(window)))


def relative_factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, source_id, source_start``: the factors of every document, in words.

    The source is the first place of the factor's phrases in the corpus (the document itself where it is that place) and NULL
    for a stretch settled at a boundary.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(d, *f) for d, s in zip(batch.column("given").to_pylist(), batch.column("spans").to_pylist(), strict=True) for f in factors(s, window)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "source_id", "source_start"])

    return parsed(docs, window).select("given", "spans").mapInArrow(work, "doc_id long, start long, length long, source_id long, source_start long")


def _kept(batches, window: int):
    """(batch, row, words, kept words) of each row of ``parsed``."""
    import zstandard

    for batch, i, z in texts_of(batches, "z"):
        tokens = zstandard.decompress(z).split()
        spans = batch.column("spans")[i].as_py()
        if not spans:
            yield batch, i, tokens, tokens
            continue
        gone = in_factors(factors(spans, window), len(tokens))
        yield batch, i, tokens, [t for t, g in zip(tokens, gone, strict=True) if not g]


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row of ``docs``.

    Each word that a window covers whose word sequence also starts anywhere else is removed, all occurrences alike. NULL and
    blank texts have no words; a text shorter than a window loses nothing; repeated rows are occurrences of each other; an empty
    table gives no rows; columns other than doc_id and text are ignored.
    """

    def work(batches):
        import pyarrow as pa

        out: list[tuple] = []
        for batch, i, tokens, kept in _kept(batches, window):
            out.append((batch.column("given")[i].as_py(), len(tokens), len(tokens) - len(kept), sha256(b" ".join(kept)).hexdigest()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    import pyarrow as pa

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return parsed(docs, window).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``: kept words joined by one space, ``n_chars`` counted anew.

    A text that loses nothing is kept as it is. All rows stay, and all their columns.
    """
    rest = docs.drop("text")
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns])
    found = parsed(docs, window, {"row": row, "had_text": F.col("text").isNotNull()})

    def work(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            texts = []
            for one, i, tokens, kept in _kept([batch], window):
                whole = len(kept) == len(tokens)
                data = zstandard.decompress(one.column("z")[i].as_py()) if whole else b" ".join(kept)
                texts.append(data.decode() if one.column("had_text")[i].as_py() else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = found.select("z", "row", "had_text", "spans").mapInArrow(work, T.StructType([found.schema["row"], T.StructField("text", T.StringType())]))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)
