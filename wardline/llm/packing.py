"""Packing documents into training sequences by lexical retrieval.

Documents are dealt by range of their two most telling ids, so that lexically close ones lie together, and each stretch of
``SHARD`` documents is a shard with a BM25 inverted index (term frequencies of the shard's documents, document frequencies
and mean length of the whole corpus). A seed document opens a window; the index returns its neighbours that are not used yet, best first,
and they fill the window greedily. The last one is cut where the window is full, and its rest is the next seed. What is
left of the last window of a task is cut into powers of two, so no sequence is padded.

Terms are the ids of the tokenizer, of which there are at most ``BINS``, which bounds the corpus statistics; the statistics cover
all ids of all documents. Texts are encoded once and travel as ids.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.repeats import NO_ID, keyed, texts_of
from wardline.llm.tokens import encoder, tokenizer_path
from wardline.session import cut_lineage

LENGTH = 2048
END = 1
#: Documents of a shard, and ids after which it is closed earlier.
SHARD = 512
SHARD_IDS = 1 << 23
BINS = 1 << 16
K1, B = 1.2, 0.75


def encoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text_key, ids``: the ids of every text as compressed little-endian numbers, encoded once."""

    def work(batches):
        import pyarrow as pa
        import zstandard

        squeeze, encode = zstandard.ZstdCompressor(level=1).compress, encoder(tokenizer).encode_column
        for batch in batches:
            for start, ids in encode(batch.column("text")):
                ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 2
                data = np.frombuffer(ids.buffers()[2], "<u4", int(ends[-1]) // 2).astype("<u2").data.cast("B")
                z = [squeeze(data[a:b]) for a, b in itertools.pairwise(ends.tolist())]
                part = batch.slice(start, len(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(z, pa.binary())], names=["doc_id", "text_key", "ids"])

    return rows.mapInArrow(work, "doc_id long, text_key long, ids binary")


def unpacked(z: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(z), "<u2").astype("<u4")


def terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a text and how often each occurs."""
    if len(ids) > 4096:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        return values, counts[values]
    ordered = np.sort(ids.astype("<u2"), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first].astype(np.int64), np.concatenate([first[1:], [len(ordered)]]) - first if len(ordered) else first


def corpus_statistics(texts: DataFrame) -> tuple[np.ndarray, float]:
    """Inverse document frequency of each id and the mean length, over all documents; at most BINS + 2 rows are collected."""

    def work(batches):
        import pyarrow as pa

        found, docs, length = np.zeros(BINS, np.int64), 0, 0
        for _, _, z in texts_of(batches, "ids"):
            ids = unpacked(z)
            found[terms(ids)[0]] += 1
            docs += 1
            length += len(ids)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(found[used], [docs, length]))], names=["bin", "n"])

    df, docs, length = np.zeros(BINS), 0, 0
    for r in texts.select("ids").mapInArrow(work, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        if r["bin"] >= 0:
            df[r["bin"]] = r["n"]
        elif r["bin"] == -1:
            docs = r["n"]
        else:
            length = r["n"]
    return np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32), length / max(docs, 1)


def routed(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id, text_key, ids, r1, r2``: the two ids with the most weight in each text, -1 where there is none."""
    weights = texts.sparkSession.sparkContext.broadcast(idf)  # BINS numbers

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            first, second = [], []
            for _, _, z in texts_of([batch], "ids"):
                values, n = terms(unpacked(z))
                weight = n * weights.value[values]
                order = np.argsort(-weight, kind="stable")[:2]
                top = [*values[order].tolist(), -1, -1]
                first.append(top[0])
                second.append(top[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text_key", "ids")], pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=["doc_id", "text_key", "ids", "r1", "r2"])

    return texts.mapInArrow(work, "doc_id long, text_key long, ids binary, r1 int, r2 int")


class Index:
    """BM25 postings of one shard."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.of = [terms(t) for t in texts]
        bins = np.concatenate([b for b, _ in self.of])
        tf = np.concatenate([n for _, n in self.of]).astype(np.float32)
        doc = np.repeat(np.arange(len(texts)), [len(b) for b, _ in self.of])
        length = np.array([n.sum() for _, n in self.of], np.float32)
        weight = idf[bins] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
        order = np.argsort(bins, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float64)
        self.live = len(texts)
        self._settle(np.bincount(bins, minlength=BINS))

    def _settle(self, counts: np.ndarray) -> None:
        """Where the postings of each id start and end."""
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts

    def forget_used(self, free: np.ndarray) -> None:
        """Leave out the postings of used documents, each time another quarter of the documents is used; other scores stay as they are."""
        live = int(np.count_nonzero(free))
        if live > 0.75 * self.live:
            return
        self.live, keep = live, free[self.doc]
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.doc, self.weight = self.doc[keep], self.weight[keep]
        self._settle(kept[self.ends] - kept[self.starts])

    def scores(self, query: np.ndarray, n: int) -> np.ndarray:
        """Score of each of the n documents for the query's terms."""
        first, count = self.starts[query], self.ends[query] - self.starts[query]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.doc[at], self.weight[at], n)


def _best_first(rank: np.ndarray, n: int):
    """The n best places, equal ones in order of place; the first few are found without sorting all."""
    few = min(n, 24)
    head = np.argpartition(-rank, few - 1)[:few]
    edge = rank[head].min()
    sure = np.flatnonzero(rank > edge)
    yield from sure[np.argsort(-rank[sure], kind="stable")]
    done = len(sure)
    rest = np.flatnonzero(rank <= edge)
    yield from rest[np.argsort(-rank[rest], kind="stable")][: n - done]


class Packer:
    """Windows of one task: rows ``(doc_id, start, length, crc, doc_tokens, sequence, offset)`` are collected in ``out``."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.length, self.sequence, self.used, self.out = length, first_sequence, 0, []
        self.open: list[tuple[int | None, np.ndarray, int, int]] = []

    def put(self, doc_id: int | None, ids: np.ndarray, start: int) -> int:
        """Add ids from ``start`` as far as the window has room; returns where it stopped."""
        n = min(len(ids) - start, self.length - self.used)
        self.open.append((doc_id, ids, start, n))
        self.used += n
        if self.used == self.length:
            self.seal()
        return start + n

    def seal(self) -> None:
        """Number the pieces of the open window as one sequence."""
        offset = 0
        for doc_id, ids, start, n in self.open:
            self.out.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.sequence, offset))
            offset += n
        self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def shard(self, rows: list[tuple[int | None, np.ndarray]], idf: np.ndarray, mean: float) -> None:
        """Pack all documents of a shard; its last window may stay open for the next shard."""
        index, n = Index([ids[:-1] for _, ids in rows], idf, mean), len(rows)
        free = np.ones(n, bool)
        seed, position = None, 0
        while True:
            if seed is None:
                rest = np.flatnonzero(free)
                if not len(rest):
                    return
                seed, position = int(rest[0]), 0
                free[seed] = False
            position = self.put(rows[seed][0], rows[seed][1], position)
            if position < len(rows[seed][1]):
                continue
            query, seed = index.of[seed], None
            if not self.used or not free.any():
                continue
            index.forget_used(free)
            rank = np.where(free, index.scores(query[0], n), -1.0)
            for k in _best_first(rank, int(free.sum())):
                free[k] = False
                position = self.put(rows[k][0], rows[k][1], 0)
                if position < len(rows[k][1]):
                    seed = int(k)
                    break
                if not self.used:
                    break

    def close(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two, the longest first."""
        pieces, left = self.open, self.used
        self.open, self.used = [], 0
        room = 0
        for doc_id, ids, start, n in pieces:
            while n:
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                take = min(n, room)
                self.open.append((doc_id, ids, start, take))
                start, n, room = start + take, n - take, room - take
                if not room:
                    self.seal()


ROW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_rows(routes: DataFrame, idf: np.ndarray, mean: float, length: int = LENGTH) -> DataFrame:
    weights = routes.sparkSession.sparkContext.broadcast(idf)  # BINS numbers

    def batch_of(rows: list[tuple]):
        import pyarrow as pa

        names = [c.split()[0] for c in ROW.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def work(batches):
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, key, z in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_key", "ids")], strict=True):
                ids = np.append(unpacked(z), np.uint32(END)).astype("<u4")
                rows.append((doc_id if key < NO_ID else None, ids))
                size += len(ids)
                if len(rows) >= SHARD or size > SHARD_IDS:
                    packer.shard(rows, weights.value, mean)
                    rows, size = [], 0
                    yield batch_of(packer.out)
                    packer.out = []
        if rows:
            packer.shard(rows, weights.value, mean)
        packer.close()
        yield batch_of(packer.out)

    dealt = routes.repartitionByRange("r1", "r2", "doc_id", "text_key").sortWithinPartitions("r1", "r2", "doc_id", "text_key")
    return dealt.mapInArrow(work, ROW)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row for each piece of a document.

    A document is its ids by the tokenizer and then the id END; every id is in exactly one piece, pieces follow each other in a
    sequence without gaps, and sequences have ``length`` ids or a power of two. NULL and empty texts are the END id alone;
    repeated rows are packed each; equal scores go by the order of the range; an empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    texts = cut_lineage(encoded(keyed(docs, F.col("doc_id"), F.col("text")), tokenizer or tokenizer_path()))
    idf, mean = corpus_statistics(texts)
    return packed_rows(routed(texts, idf), idf, mean, length)
