"""Near-duplicate detection with DartMinHash over weighted word shingles.

A text is a weighted set: its shingles with their counts. Hashed darts fall on the regions of the elements, (weight) x (rank); only darts
below an element's weight count. Each dart belongs to one of the coordinates of the signature, which keeps its earliest dart
(least rank). Two texts have the same dart at a coordinate with a probability equal to their weighted Jaccard similarity.
Ranks are visited in bands of growing width until every coordinate has a dart, so a text costs a few hashes per shingle and
about k ln k darts, whatever its length; counts are whole, so the weight axis has unit cells that are wholly in or out.

Signatures meet in bands of ``ROWS`` coordinates. Members of a bucket are compared with representatives of it, not with
each other: links within a class add nothing to it. Only in buckets that still hold several classes, all members outside the largest class
are searched against all members, in blocks, by an inverted index of the shingles that lives in a task; so no link
between texts that share a bucket is lost, and no table of pairs is made. Every comparison is exact.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.anchors import PIECE, Rolling, U, mixed
from wardline.llm.common import worker_cache
from wardline.llm.components import components
from wardline.llm.repeats import NO_ID, byte_symbols, given_id, keyed, packed, texts_of
from wardline.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: Signature of 100 darts in bands of 4: a pair at similarity 0.8 shares no band with a probability of 2 in a million.
BANDS, ROWS = 25, 4
#: Representatives of a bucket, chosen by different hashes.
ORDERS = 2
#: Texts of a bucket that meet as many others of it in one task.
BLOCK = 1024
#: Rank bands start with [0, 2**FIRST); later ones reach 2**STEP times as far.
FIRST, STEP = -2, 1
#: More darts than this fall on a cell of at most one on average with a probability under 1e-17.
DARTS = 20
_GAP = re.compile(rb"[ \t-\r]")
_IN_WORD = np.array([_GAP.fullmatch(bytes([b])) is None for b in range(256)])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (cut at the space and U+0009 to U+000D), from running sums over about ``PIECE`` bytes at a time."""
    codes, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(codes):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(codes)
        part = codes[at:end]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = _IN_WORD[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(mixed(Rolling(byte_symbols(part)).stretch(0, edges[::2], edges[1::2])))
        at = end
    return np.concatenate(out) if len(out) != 1 else out[0]


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the elements of a text, a repeated shingle once for each occurrence; a shorter text is one shingle."""
    words = word_hashes(data) if data else np.zeros(0, U)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    found = np.sort(mixed(Rolling(words).every(0, min(size, len(words)), 0, n)))
    fresh = np.concatenate([[True], found[1:] != found[:-1]])
    if fresh.all():
        return mixed(found)
    place = np.arange(n)
    cell = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return mixed(found + cell.astype(U) * U(0x9E3779B97F4A7C15))


def _poisson(mean: float) -> list[int]:
    """Bounds below which a uniform 64-bit hash means more than 0, 1, 2, ... darts."""
    term, rest, out = float(np.exp(-mean)), 1.0, []
    for k in range(DARTS):
        rest -= term
        out.append(min(int(rest * 2.0**64), 2**64 - 1) if rest > 1e-17 else 0)
        term *= mean / (k + 1)
    return out


class _Cells:
    """Rank bands cut into cells of at most one dart on average: salt, low end, width and bounds of each, in order of rank."""

    def __init__(self, low: float, band: int):
        high = 2.0**band
        parts = max(1, int(high - low))
        self.width = (high - low) / parts
        self.low = low + self.width * np.arange(parts)
        self.salt = mixed((np.arange(parts, dtype=U) | U((band - FIRST) << 32)) + U(0xA24BAED4963EE407))
        self.bounds = _poisson(self.width)


def _cells(done: int, upto: int) -> tuple[np.ndarray, ...]:
    """Salts, low ends, widths and bounds of the cells of some rank bands, a row for each cell."""
    kept = worker_cache("dart_cells", dict)
    if (done, upto) not in kept:
        bands = [_Cells(2.0 ** (FIRST + STEP * (k - 1)) if k else 0.0, FIRST + STEP * k) for k in range(done, upto)]
        n = [len(c.low) for c in bands]
        kept[done, upto] = (
            np.concatenate([c.salt for c in bands])[:, None], np.concatenate([c.low for c in bands]), np.repeat([c.width for c in bands], n),
            np.ascontiguousarray(np.repeat(np.array([c.bounds for c in bands], U), n, axis=0).T),
        )
    return kept[done, upto]


def _thrown(elements: np.ndarray, done: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and rank of every dart of the elements in some bands."""
    salt, low, width, bounds = _cells(done, upto)
    cells = mixed(elements ^ salt)
    row, column = np.nonzero(cells < bounds[0][:, None])
    hit = cells[row, column]
    hits, rows = [], []
    for n in range(DARTS):
        if n:
            more = np.flatnonzero(hit < bounds[n][row])
            row, hit = row[more], hit[more]
        if not len(hit):
            break
        hits.append(hit + U((n + 1) * 0xD1B54A32D192ED03 % 2**64))
        rows.append(row)
    if not hits:
        return np.zeros(0, U), np.zeros(0)
    dart, row = mixed(np.concatenate(hits)), np.concatenate(rows)
    return dart, low[row] + width[row] * ((mixed(dart ^ U(0x5851F42D4C957F2D)) >> U(11)).astype(np.float64) * 2.0**-53)


def signature(elements: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each coordinate; of equal ranks the one with the least hash."""
    earliest, names = np.full(k, np.inf), np.zeros(k, U)
    wanted = k * (np.log(k) + 2) / len(elements)
    done, upto = 0, max(1, int(np.ceil((np.log2(wanted) - FIRST) / STEP)) + 1)
    while True:
        dart, rank = _thrown(elements, done, upto)
        place = (dart % U(k)).astype(np.int64)
        first, name = np.full(k, np.inf), np.full(k, U(2**64 - 1))
        np.minimum.at(first, place, rank)
        least = np.flatnonzero(rank == first[place])
        np.minimum.at(name, place[least], dart[least])
        better = first < earliest
        earliest[better], names[better] = first[better], name[better]
        if np.isfinite(earliest).all():
            return names
        done, upto = upto, upto + 1


def band_keys(names: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band of coordinates; equal keys of different bands differ by the band's number."""
    rows = names.reshape(bands, -1)
    key = np.arange(bands, dtype=U)
    for column in rows.T:
        key = mixed(key * U(0x9E3779B97F4A7C15) ^ column)
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signed_texts(rows: DataFrame) -> DataFrame:
    """``doc_id, text_key, node, n, bands`` of ``keyed`` rows; node is a 128-bit hash of the words, NULL without words."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        names = ["doc_id", "text_key", "node", "n", "bands"]
        out: list[tuple] = []
        for batch, i, data in texts_of(batches):
            elements = shingles(data)
            head = (batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py())
            if len(elements):
                out.append((*head, xxhash.xxh3_128_digest(b" ".join(data.split())), len(elements), band_keys(signature(elements)).view(np.int64)))
            else:
                out.append((*head, None, 0, None))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(work, "doc_id long, text_key long, node binary, n long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts have the similarity; ``texts`` is ``node, z`` with each node once."""

    def work(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (shingles(zstandard.decompress(batch.column(c)[i].as_py())) for c in ("za", "zb"))
                keep.append(similarity(x, y) >= SIMILARITY)
            part = batch.select(["a", "b"])
            yield part.filter(pa.array(keep, pa.bool_()))

    za, zb = texts.select(F.col("node").alias("a"), F.col("z").alias("za")), texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return pairs.join(za, "a").join(zb, "b").select("a", "b", "za", "zb").mapInArrow(work, "a binary, b binary")


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of each member of a bucket and the bucket's representatives; ``rows`` is ``key, node``."""
    least = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")).alias(f"r{k}") for k in range(ORDERS)]
    buckets = rows.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), *least).where("x <> y")
    reps = F.explode(F.array(*[f"r{k}.node" for k in range(ORDERS)])).alias("r")
    return rows.join(buckets, "key").select("node", reps).where("node <> r").select(*_ordered(F.col("node"), F.col("r"))).distinct()


def _blocks(placed: DataFrame) -> DataFrame:
    """``key, qb, mb, node, root, asks``: the members of buckets that hold several classes, dealt to tasks in blocks.

    All members but those of the largest class ask, and all answer. Both sides are cut into blocks of about ``BLOCK`` nodes and
    each block of askers meets each block of answerers, so a bucket of any size is worked on by many tasks of a bounded size.
    """
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("largest"), F.sum("c").alias("m"), F.count("*").alias("classes")).where("classes > 1")
    several = buckets.select("key", F.col("largest.root").alias("most"), F.ceil(F.col("m") / BLOCK).alias("mbs"), F.ceil((F.col("m") - F.col("largest.c")) / BLOCK).alias("qbs"))
    met = placed.join(cut_lineage(several), "key")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    answer = met.select("key", every(F.col("qbs")).alias("qb"), mine(F.col("mbs")).alias("mb"), "node", "root", F.lit(False).alias("asks"))
    ask = met.where("root <> most").select("key", mine(F.col("qbs")).alias("qb"), every(F.col("mbs")).alias("mb"), "node", "root", F.lit(True).alias("asks"))
    return answer.unionByName(ask)


def _crossing(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` between different classes of a block: one for each pair of an asker and another class with a similar text."""

    def settle(rows: list[tuple]):
        import pyarrow as pa
        import zstandard

        bags = [shingles(zstandard.decompress(r[2])) for r in rows]
        members = [i for i, r in enumerate(rows) if not r[3]]
        found: set[tuple[bytes, bytes]] = set()
        if members:
            sizes = np.array([len(bags[i]) for i in members])
            values, owner = np.concatenate([bags[i] for i in members]), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for q, r in enumerate(rows):
                if not r[3]:
                    continue
                first, last = np.searchsorted(values, bags[q], "left"), np.searchsorted(values, bags[q], "right")
                n = last - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(members))
                seen = {r[1]}
                for k in np.flatnonzero(both >= SIMILARITY * (len(bags[q]) + sizes - both)):
                    other = rows[members[k]]
                    if other[1] not in seen:
                        seen.add(other[1])
                        found.add((min(r[0], other[0]), max(r[0], other[0])))
        pairs = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def work(batches):
        rows, now = [], None
        for batch in batches:
            for key, qb, mb, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "qb", "mb", "node", "root", "z", "asks")], strict=True):
                if now != (key, qb, mb) and rows:
                    yield settle(rows)
                    rows = []
                now = (key, qb, mb)
                rows.append(tuple(row))
        if rows:
            yield settle(rows)

    dealt = blocks.join(texts, "node").select("key", "qb", "mb", "node", "root", "z", "asks").repartition("key", "qb", "mb").sortWithinPartitions("key", "qb", "mb")
    return dealt.mapInArrow(work, "a binary, b binary").distinct()


def near_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signed`` (see ``signed_texts``) and ``node, root`` for nodes that are near another, of ``keyed`` rows."""
    signed = cut_lineage(signed_texts(rows))
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    stars = cut_lineage(_stars(nodes.select("node", F.explode("bands").alias("key"))))
    met = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("node", "k.*")
    one_text = packed(rows).dropDuplicates(["doc_id", "text_key"])
    texts = cut_lineage(one_text.join(keys.join(met, "node", "left_semi"), ["doc_id", "text_key"]).select("node", "z"))
    links = cut_lineage(_verified(stars, texts))
    root = components(links)
    placed = nodes.join(met, "node", "left_semi").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("bands").alias("key"))
    crossing = cut_lineage(_crossing(_blocks(cut_lineage(placed)), texts))
    return signed, root if crossing.isEmpty() else components(links.unionByName(crossing))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` per row of ``docs``: the smallest doc_id of the class of near and exact copies that the row is in.

    Classes are the components of all links with a weighted Jaccard similarity of ``SIMILARITY`` or more over shingles of
    ``SHINGLE`` words (words between white space, counts as weights); exact copies are one node and never paired. NULL and
    blank texts have no shingles and are in a class of their own; repeated rows are copies; a class whose doc_ids are all NULL
    has a NULL id; an empty table gives no rows; other columns are ignored.
    """
    signed, root = near_classes(keyed(docs, F.col("doc_id"), F.col("text")))
    placed = signed.select(given_id(), "node").join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    ids = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(ids, "root", "left").select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest doc_id, with all its columns; rows without words all stay once per (doc_id, text)."""
    rows = keyed(docs, F.col("doc_id"), F.col("text"))
    signed, root = near_classes(rows)
    placed = signed.select("doc_id", "text_key", "node").join(root, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
    chosen = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct((F.col("text_key") >= NO_ID).alias("none"), "doc_id", "text_key")).alias("k"))
    kept = chosen.select("k.doc_id", "k.text_key").unionByName(placed.where("root IS NULL").select("doc_id", "text_key").distinct())
    key = keyed(docs, F.col("doc_id"), F.col("text"), row=F.struct("*")).select("row", "doc_id", "text_key")
    once = key.dropDuplicates(["doc_id", "text_key"])
    return once.join(kept, ["doc_id", "text_key"], "left_semi").select("row.*")
