"""Exact removal of repeated byte strings, by names and sorted suffix windows around a difference cover.

Comparing suffixes needs a sample of places such that any two equal windows meet it at equal distances. A fixed difference
cover (the residues 1 and 2 of triples, or a larger cover) does this for any two windows, but samples every text alike: at 0.5 GB of input some
hundred million rows for each level of naming. Here the sample is chosen by content (anchors, ``anchors.py``): equal windows
hold the same anchor at the same distance, and about one byte in eighty is sampled. The steps are those of the algorithm:

* sampled places are sorted (shuffled) by their anchor string, and those that are unique are done;
* their surroundings get names: a rolling hash names a whole run of windows, which is what recursion over names of triples
  would give, since two runs have equal names exactly if all their 200-byte windows are equal in turn;
* remaining suffixes, those that start in runs with a name of their own, are merged by the sample they contain: windows with
  the same anchor are sorted together;
* neighbours in that order are compared, here over the 200-byte prefix.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.repeats import Alphabet, byte_codes, byte_symbols, covered, flags, keyed, packed, repeated_windows, spans_of, texts_of, with_spans

WINDOW = 200
GRAM = 32


def text_bytes(window: int = WINDOW) -> Alphabet:
    return Alphabet(byte_codes, byte_symbols, np.uint8, window, min(GRAM, window))


def marked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    rows = keyed(docs, F.col("doc_id"), F.col("text"), given=F.col("doc_id").cast("long"))
    z = packed(rows)
    return with_spans(z, repeated_windows(rows.select("doc_id", "text_key", "text"), z, text_bytes(window)))


def repeated_bytes_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``.

    Each byte that a ``window``-byte string covers which also starts anywhere else is removed, all occurrences alike; matches
    never cross documents. NULL is empty; a text shorter than a window loses nothing; repeated rows are occurrences of each other; an
    empty table gives no rows; columns other than doc_id and text are ignored.
    """

    def work(batches):
        import pyarrow as pa
        import zstandard

        out: list[tuple] = []
        for batch, i, z in texts_of(batches, "z"):
            data, spans = zstandard.decompress(z), batch.column("spans")[i].as_py()
            removed, runs, kept = 0, 0, data
            if spans:
                gone = covered(flags(spans, len(data) - window + 1), window, len(data))
                removed, runs = int(gone.sum()), len(spans_of(gone))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((batch.column("given")[i].as_py(), len(data), removed, runs, sha256(kept).hexdigest()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    import pyarrow as pa

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([*[(n, pa.int64()) for n in names[:4]], ("kept_sha256", pa.string())])
    return marked(docs, window).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
