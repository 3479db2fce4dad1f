"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For every item, windows of as many words as the item has are slid over each text, also past its two ends, where they are clipped down to the
fewest words that can still reach the similarity (``least_words``). A window's fingerprint has a bit for each of 64
signed sums over the words' hashes; running sums give all windows of a size at once. An item's fingerprints are found through ``BLOCKS``
blocks of bits: fingerprints within ``RADIUS`` differ in at most RADIUS // BLOCKS bits in one block at least, so a lookup of
every block value in a table of its near values misses none. Candidates are verified by the exact similarity of weighted
shingles.

A window can only reach the similarity if it shares shingles with the item; windows are therefore formed where a text has a shingle of the
benchmark at all. Benchmarks are read in parts of about ``PART_WORDS`` words and ``PART_ITEMS`` items at most, each sent to all tasks and searched
in one pass over the documents.
"""

from __future__ import annotations

import uuid
from functools import reduce
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.anchors import Rolling, U, mixed
from wardline.llm.common import narrow, words_of, worker_cache
from wardline.llm.repeats import given_id, keyed, texts_of, word_codes
from wardline.session import cut_lineage

#: Values of the bits of a shingle's hash that are looked at first.
SEEN = 1 << 20
SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 20, 4
BLOCK_BITS = 64 // BLOCKS
#: A part's bounds: the near values of an item's four blocks take about 110 KB.
PART_WORDS, PART_ITEMS = 1_000_000, 1_000


def fingerprint_sums(words: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 per bit of the word hashes, one row more than words."""
    bits = np.unpackbits(mixed(words).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the windows of words from ``starts`` up to ``ends``."""
    return np.packbits(sums[ends] - sums[starts] > 0, axis=1).view(np.uint64).ravel()


def least_words(size: int) -> int:
    """Words of the shortest piece of an item that can reach the similarity: a piece has no shingle besides the item's."""
    return size if size < SHINGLE else ceil(SIMILARITY * (size - SHINGLE + 1) - 1e-9) + SHINGLE - 1


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per shingle in text order; fewer words than ``size`` are one shingle."""
    n = max(1, len(words) - size + 1)
    return mixed(Rolling(words).every(0, min(size, len(words)), 0, n))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles, counts as weights."""
    values, n = np.unique(a, return_counts=True)
    others, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


def shared_shingles(words, size: int):
    """Shingles that a window of so many words shares with an item of ``size`` words at least where they are similar enough.

    With n and m shingles and s of them shared the similarity is s / (n + m - s).
    """
    n, m = np.maximum(words - SHINGLE + 1, 1), max(size - SHINGLE + 1, 1)
    return SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9


def near_blocks(radius: int = RADIUS, blocks: int = BLOCKS) -> np.ndarray:
    """All differences of a block with at most radius // blocks bits."""
    values = np.arange(1 << (64 // blocks), dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius // blocks]


class Items:
    """The items of one part of a benchmark, indexed by size and by the near values of their fingerprint blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.by_size: dict[int, list[tuple[int, np.ndarray, np.uint64]]] = {}
        every = []
        for item_id, text in items:
            words = word_codes(text.encode())
            if not len(words):
                continue
            shingles = shingle_hashes(words)
            print_ = fingerprints(fingerprint_sums(words), np.array([0]), np.array([len(words)]))[0]
            self.by_size.setdefault(len(words), []).append((item_id, shingles, print_))
            if len(words) >= SHINGLE:
                every.append(shingles)
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, U)
        self.seen = np.zeros(SEEN, bool)
        self.seen[(self.shingles & U(SEEN - 1)).astype(np.int64)] = True
        self.tables = {size: self._table(np.array([p for _, _, p in found], U)) for size, found in self.by_size.items()}

    @staticmethod
    def _table(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: sorted near values, and the item that each belongs to."""
        near, out = near_blocks(), []
        for b in range(BLOCKS):
            block = (prints >> U(b * BLOCK_BITS)).astype(np.uint32) & np.uint32((1 << BLOCK_BITS) - 1)
            values = (block[:, None] ^ near[None, :]).ravel()
            item = np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
            order = np.argsort(values, kind="stable")
            ends = np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)
            out.append((ends[:-1], ends[1:], item[order]))
        return out

    def candidates(self, size: int, prints: np.ndarray) -> np.ndarray:
        """(window, item) pairs within the radius."""
        pairs = []
        for b, (first, last, item) in enumerate(self.tables[size]):
            block = ((prints >> U(b * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = last[block] - first[block]
            window = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(first[block] - np.cumsum(n, dtype=np.int64) + n, n) + np.arange(n.sum())
            pairs.append(np.stack([window, item[at]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        own = np.array([p for _, _, p in self.by_size[size]], U)
        return pairs[np.bitwise_count(prints[pairs[:, 0]] ^ own[pairs[:, 1]]) <= RADIUS]

    def hits(self, data: bytes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item that a text contains."""
        words = word_codes(data)
        short = [size for size in self.by_size if size < SHINGLE]
        if len(words) == 0:
            return []
        found = np.zeros(0, np.int64)
        if len(words) >= SHINGLE and len(self.shingles):
            text = shingle_hashes(words)
            # most shingles fail a look at some of their bits already
            maybe = np.flatnonzero(self.seen[(text & U(SEEN - 1)).astype(np.int64)])
            at = np.searchsorted(self.shingles, text[maybe])
            found = maybe[self.shingles[np.minimum(at, len(self.shingles) - 1)] == text[maybe]]
        if not len(found) and not short:
            return []
        sums, out = None, []
        known = np.zeros(max(len(words) - SHINGLE + 1, 0) + 1, np.int32)
        known[found + 1] = 1
        known = np.cumsum(known)  # how many shingles of the items begin before each word
        for size, own in self.by_size.items():
            least = least_words(size)
            if least > len(words) or (size >= SHINGLE and len(found) < shared_shingles(least, size)):
                continue
            # places of whole windows, from the first to the last that has ``least`` words within the text
            starts = np.arange(len(words) + size - 2 * least + 1) + least - size
            if size >= SHINGLE:
                # windows with fewer of the items' shingles than any similar window has
                a, b = np.maximum(starts, 0), np.minimum(starts + size, len(words))
                held = known[np.maximum(b - SHINGLE + 1, a)] - known[a]
                starts = starts[held >= shared_shingles(b - a, size)]
            if not len(starts):
                continue
            starts, ends = np.maximum(starts, 0), np.minimum(starts + size, len(words))
            if len(words) < size:
                starts, ends = np.unique(np.stack([starts, ends]), axis=1)  # the whole text once
            sums = fingerprint_sums(words) if sums is None else sums
            best: dict[int, tuple[float, int, int]] = {}
            for w, k in self.candidates(size, fingerprints(sums, starts, ends)):
                start, n = int(starts[w]), int(ends[w] - starts[w])
                s = weighted_similarity(shingle_hashes(words[start : start + n]), own[k][1])
                if s >= SIMILARITY and (k not in best or (-s, start, -n) < best[k]):
                    best[k] = (-s, start, -n)
            out += [(own[k][0], start, -n, -s) for k, (s, start, n) in best.items()]
        return out


def parts_of(benchmark: DataFrame, part_words: int = PART_WORDS) -> list[list[tuple[int, str]]]:
    """Distinct items with text in parts whose words have a bound; only one part is at the driver at a time."""
    items = narrow(benchmark, item_id=F.col("item_id").cast("long"), text=F.col("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("c")).withColumn("n", F.size(words_of(F.col("text"))) + F.length("text") / 16)
    total, number = items.agg(F.sum("n"), F.count("*")).first()
    count = max(1, ceil((total or 0) / part_words), ceil(number / PART_ITEMS))
    for k in range(count):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()]


HITS = "doc_id long, text_key long, item_id long, start long, n_words long, similarity double"


def contaminated_windows(rows: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``doc_id, text_key, item_id, start, n_words, similarity`` of ``keyed`` rows: the best window of each item in each text."""
    found = []
    for items in parts_of(benchmark, part_words):
        sent = rows.sparkSession.sparkContext.broadcast(items)  # at most part_words words

        def work(batches, sent=sent, part=uuid.uuid4().hex):
            import pyarrow as pa

            kept = worker_cache("items", dict)  # the index of a part is built once in a worker, not in each of its tasks
            if part not in kept:
                kept.clear()
                kept[part] = Items(sent.value)
            index = kept[part]
            names = [c.split()[0] for c in HITS.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.float64()]
            for batch in batches:
                out = [(batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py(), *hit) for _, i, data in texts_of([batch]) for hit in index.hits(data)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found.append(rows.mapInArrow(work, HITS))
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: documents that contain a benchmark item, with the item's best window.

    A window of as many words as the item, clipped where the text begins or ends, counts if its weighted Jaccard similarity over
    shingles of ``SHINGLE`` words is ``SIMILARITY`` or more and its fingerprint within ``RADIUS``; of equal windows the first is
    reported, the longer before the shorter, and ``n_words`` is what it has within the text. Items and texts that are
    NULL or blank match nothing; repeated rows of either table are reported once each for documents and once for items; a
    text shorter than the item is a window as a whole; items of fewer words than a shingle are one shingle; other columns are ignored.
    """
    return contaminated_windows(keyed(docs, F.col("doc_id"), F.col("text")), benchmark).select(given_id(), "item_id", "start", "n_words", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with all their columns; same cases as ``contaminated``."""
    bad = cut_lineage(contaminated_windows(keyed(docs, F.col("doc_id"), F.col("text")), benchmark).select("doc_id", "text_key").distinct())
    rows = keyed(docs, F.col("doc_id"), F.col("text"), row=F.struct("*"))
    return rows.join(bad, ["doc_id", "text_key"], "left_anti").select("row.*")

