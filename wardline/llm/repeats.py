"""Which windows of a corpus occur more than once: the engine of the two substring operators.

1. Every text is parsed into runs of windows (``anchors.py``); runs whose anchor string occurs once are dropped.
2. Runs that occur more than once as a whole are settled: all their windows are repeated.
3. Of the rest, only runs whose anchor also has another content can hold repeated windows, at their ends: where a
   repeated stretch begins or breaks off. The symbols of these runs meet by anchor, their windows are sorted and neighbours
   are compared. Anchors with very many contents are not gathered: their windows are counted by a shuffle.
Nothing is sampled or capped; every shuffle moves a few numbers per run, and texts move compressed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.anchors import Rolling, U, mixed, pieces
from wardline.llm.common import narrow, worker_cache
from wardline.session import cut_lineage

#: Contents of one anchor that are compared in one task; anchors with more are counted window by window.
GATHERED = 32_768
#: Symbols compared at a time.
COMPARED = 1 << 19
REMEMBERED_WORDS = 250_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value


def word_codes(data: bytes) -> np.ndarray:
    """A 64-bit symbol for each word; bytes.split() cuts at the space and U+0009 to U+000D only."""
    return np.fromiter(map(worker_cache("words", _WordHashes).__getitem__, data.split()), U)


def byte_codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def byte_symbols(codes: np.ndarray) -> np.ndarray:
    return worker_cache("bytes", lambda: mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)))[codes]


@dataclass(frozen=True)
class Alphabet:
    """How a text becomes codes and these 64-bit symbols, how long a window is and how long its anchor string."""

    codes: Callable[[bytes], np.ndarray]
    symbols: Callable[[np.ndarray], np.ndarray]
    kind: type
    window: int
    gram: int


KEY = "doc_id long, text_key long"


#: Keys of texts without a doc_id are at least this, all others have 32 bits.
NO_ID = 1 << 62


def keyed(docs: DataFrame, doc_id: Column, text: Column, **more: Column) -> DataFrame:
    """``doc_id, text_key, text`` and more; rows that agree in both keys have equal results.

    The keys are never NULL, so that grouping and joining by them deal rows out alike (see ``given_id``). NULL texts become empty.
    """
    t, given = F.coalesce(text, F.lit("")), doc_id.cast("long")
    key = F.when(given.isNull(), F.xxhash64(t).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))).otherwise(F.hash(t).cast("long"))
    return narrow(docs, doc_id=F.coalesce(given, F.lit(0).cast("long")), text_key=key, text=t, **more)


def given_id() -> Column:
    """The doc_id of a row of keys as the table has it."""
    return F.when(F.col("text_key") < NO_ID, F.col("doc_id")).alias("doc_id")


def packed(rows: DataFrame) -> DataFrame:
    """The same, and further columns, with the text as zstd bytes ``z``, for shuffles."""
    rest = [c for c in rows.columns if c != "text"]

    def work(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                z = [squeeze(t.as_buffer()) for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(z, pa.binary())], names=[*rest, "z"])

    return rows.mapInArrow(work, T.StructType([*[f for f in rows.schema.fields if f.name != "text"], T.StructField("z", T.BinaryType())]))


def texts_of(batches, column: str = "text"):
    """(row, bytes of its text) for each row of Arrow batches; row is the batch and the index in it."""
    import pyarrow as pa

    for batch in batches:
        values = batch.column(column).cast(pa.binary())
        for i in range(batch.num_rows):
            yield batch, i, values[i].as_py()


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _anchor_counts(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """``anchor, n``, added up per batch before the shuffle."""
    window, gram = alphabet.window, alphabet.gram
    symbols = lambda data: alphabet.symbols(alphabet.codes(data))

    def work(batches):
        import pyarrow as pa

        found, size = [], 0
        for _, _, data in texts_of(batches):
            for _, rolling in pieces(symbols(data), window):
                found.append(rolling.runs(window, gram).anchor)
                size += len(found[-1])
            if size > 1 << 18:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n)], names=["anchor", "n"])
                found, size = [], 0
        if found:
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n)], names=["anchor", "n"])

    return rows.select("text").mapInArrow(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _runs(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """``anchor, content, doc_id, text_key, place``; place is the first window, shifted by 8 bits, and the number of windows."""
    window, gram = alphabet.window, alphabet.gram
    symbols = lambda data: alphabet.symbols(alphabet.codes(data))

    def flush(ids, keys, sizes, runs):
        import pyarrow as pa

        reps = np.array(sizes)
        id_column = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), reps)))
        content = np.concatenate([r[1] for r in runs])
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate([r[0] for r in runs]))), pa.array(signed(content)), id_column, pa.array(np.repeat(np.array(keys, np.int64), reps)), pa.array(np.concatenate([r[2] for r in runs]))],
            names=["anchor", "content", "doc_id", "text_key", "place"],
        )

    def work(batches):
        ids, keys, sizes, runs, size = [], [], [], [], 0
        for batch, i, data in texts_of(batches):
            for offset, rolling in pieces(symbols(data), window):
                r = rolling.runs(window, gram)
                if not len(r.start):
                    continue
                ids.append(batch.column("doc_id")[i].as_py())
                keys.append(batch.column("text_key")[i].as_py())
                sizes.append(len(r.start))
                runs.append((r.anchor, r.low ^ mixed(r.high), (r.start + offset) << 8 | r.count))
                size += len(r.start)
            if size > 1 << 16:
                yield flush(ids, keys, sizes, runs)
                ids, keys, sizes, runs, size = [], [], [], [], 0
        if ids:
            yield flush(ids, keys, sizes, runs)

    return rows.mapInArrow(work, f"anchor long, content long, {KEY}, place long")


def _contents(listed: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Symbols of the listed runs: ``doc_id, text_key, z, runs array<struct<anchor, place, n, many>>`` to one row per run."""
    window, codes = alphabet.window, alphabet.codes

    def work(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out: list[tuple] = []
                for i in range(part.num_rows):
                    s = codes(zstandard.decompress(part.column("z")[i].as_py()))
                    head = (part.column("doc_id")[i].as_py(), part.column("text_key")[i].as_py())
                    for run in part.column("runs")[i].as_py():
                        first, count = run["place"] >> 8, run["place"] & 255
                        out.append((*head, run["anchor"], run["place"], run["n"], run["many"], s[first : first + count + window - 1].tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text_key", "anchor", "place", "n", "many", "symbols"])

    return listed.mapInArrow(work, f"{KEY}, anchor long, place long, n long, many boolean, symbols binary")


def window_hashes(alphabet: Alphabet, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of the contents, and the place where each content's windows begin in them."""
    window, kind = alphabet.window, alphabet.kind
    lengths = np.array([len(c) for c in contents]) // np.dtype(kind).itemsize
    counts = lengths - window + 1
    low, high = [], []
    for k in range(0, len(contents), 1024):
        rolling = Rolling(alphabet.symbols(np.concatenate([np.frombuffer(c, kind) for c in contents[k : k + 1024]])))
        n, sizes = counts[k : k + 1024], lengths[k : k + 1024]
        at = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n)
        low.append(rolling.stretch(0, at, at + window))
        high.append(rolling.stretch(1, at, at + window))
    return np.concatenate(low), np.concatenate(high), np.concatenate([[0], np.cumsum(counts)])


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of each stretch of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _compared(contents: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Repeated windows of runs that occur once: contents sorted by anchor, windows of whole anchors sorted, neighbours compared."""
    width = np.dtype(alphabet.kind).itemsize

    def settle(rows: list[tuple]):
        import pyarrow as pa

        low, high, first = window_hashes(alphabet, [r[-1] for r in rows])
        weight = np.repeat(np.array([r[4] for r in rows]), np.diff(first))
        order = np.lexsort((high, low))
        a, b, w = low[order], high[order], weight[order]
        same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        group = np.cumsum(~same) - 1
        total = np.bincount(group, weights=w)
        repeated = np.zeros(len(a), bool)
        repeated[order] = total[group] >= 2
        out = []
        for k, r in enumerate(rows):
            if r[4] == 1:
                for at, count in spans_of(repeated[first[k] : first[k + 1]]):
                    out.append((r[0], r[1], ((r[3] >> 8) + at) << 8 | count))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_key", "place"])

    def work(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_key", "anchor", "place", "n", "symbols")], strict=True):
                if size > COMPARED and r[2] != last:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[-1]) // width
                last = r[2]
        if rows:
            yield settle(rows)

    dealt = contents.where("NOT many").select("doc_id", "text_key", "anchor", "place", "n", "symbols").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, f"{KEY}, place long")


def _counted(contents: DataFrame, alphabet: Alphabet) -> DataFrame:
    """The same for anchors with very many contents: a row per window, added up before the shuffle, so no task holds an anchor."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                raw = part.column("symbols").to_pylist()
                low, high, first = window_hashes(alphabet, raw)
                rep = pa.array(np.repeat(np.arange(len(raw)), np.diff(first)))
                place = part.column("place").take(rep).to_numpy() >> 8
                place = (place + np.arange(len(low)) - np.repeat(first[:-1], np.diff(first))) << 8 | 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rep), part.column("text_key").take(rep), part.column("n").take(rep), pa.array(place), pa.array(signed(low)), pa.array(signed(high))],
                    names=["doc_id", "text_key", "n", "place", "low", "high"],
                )

    windows = contents.where("many").select("doc_id", "text_key", "place", "n", "symbols").mapInArrow(work, f"{KEY}, n long, place long, low long, high long")
    total = windows.groupBy("low", "high").agg(F.sum("n").alias("n")).where("n >= 2").select("low", "high")
    return windows.where("n = 1").join(total, ["low", "high"], "left_semi").select("doc_id", "text_key", "place")


def repeated_windows(rows: DataFrame, z: DataFrame, alphabet: Alphabet) -> DataFrame:
    """``doc_id, text_key, place, source_id, source_place``: stretches of repeated windows of ``keyed`` rows.

    ``place`` is the first window, shifted by 8 bits, plus the number of windows. For whole runs the source is the first place
    in the corpus where the run occurs (by doc_id); it is NULL for windows that were settled one by one.
    """
    # small tables of their own: a join of two plain shuffles can be split where one anchor is in very many runs
    twice = cut_lineage(_anchor_counts(rows, alphabet).where("n >= 2").select("anchor"))
    runs = cut_lineage(_runs(rows, alphabet).join(twice, "anchor", "left_semi"))
    contents = cut_lineage(
        runs.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("source"))
    )
    several = cut_lineage(contents.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m >= 2 AND least = 1").select("anchor", "m"))
    run = F.struct("anchor", F.col("source.place").alias("place"), F.least("n", F.lit(2)).cast("long").alias("n"), (F.col("m") > GATHERED).alias("many"))
    listed = contents.join(several, "anchor").select(F.col("source.doc_id").alias("doc_id"), F.col("source.text_key").alias("text_key"), run.alias("run"))
    per_doc = listed.groupBy("doc_id", "text_key").agg(F.collect_list("run").alias("runs"))
    fetched = z.select("doc_id", "text_key", "z").dropDuplicates(["doc_id", "text_key"])
    symbols = cut_lineage(_contents(per_doc.join(fetched, ["doc_id", "text_key"]).select("doc_id", "text_key", "z", "runs"), alphabet))
    nothing = [F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("long").alias("source_place")]
    ends = _compared(symbols, alphabet).unionByName(_counted(symbols, alphabet)).select("*", *nothing)
    found = contents.where("n >= 2").select("anchor", "content", F.col("source.doc_id").alias("source_id"), F.col("source.place").alias("source_place"))
    whole = runs.join(found, ["anchor", "content"]).select("doc_id", "text_key", "place", "source_id", "source_place")
    return whole.unionByName(ends)


def spans_per_text(found: DataFrame) -> DataFrame:
    """All stretches of a text in one row; repeated rows of a table bring theirs once."""
    return found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("place", "source_id", "source_place")).alias("spans"))


def with_spans(z: DataFrame, found: DataFrame) -> DataFrame:
    per = spans_per_text(found)
    return z.join(per, ["doc_id", "text_key"], "left").select(*z.columns, "spans")


def flags(spans: list[dict] | None, windows: int) -> np.ndarray:
    """True for each repeated window."""
    edge = np.zeros(max(windows, 0) + 1, np.int32)
    for s in spans or ():
        edge[s["place"] >> 8] += 1
        edge[(s["place"] >> 8) + (s["place"] & 255)] -= 1
    return np.cumsum(edge[:-1]) > 0


def covered(window_flags: np.ndarray, window: int, symbols: int) -> np.ndarray:
    """True for each symbol in a flagged window."""
    edge = np.zeros(symbols + 1, np.int32)
    at = np.flatnonzero(window_flags)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0

