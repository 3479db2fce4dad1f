"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes of a text, and where both end a token at once.

An Arrow-native pipeline. Encoded texts are list columns; they are flattened and their parent indices kept. Cumulative sums of the
tokens' byte lengths, segmented by document, give document-end keys; an outer Acero hash join on these keys cuts the bytes at every
end of either side. Each piece lies in exactly one token of each side, so pieces are the links, and pieces that end on both sides
end the groups. ``Table.group_by`` counts id pairs per document and per block of documents; Spark merges these counts. Each block then
meets the corpus-wide counts of its own pairs, so no task holds all pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import narrow, worker_cache
from wardline.session import cut_lineage

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters encoded and aligned at a time; longer texts are cut before a single space between other characters.
PART_CHARS = 1 << 19
#: Characters of a block of documents, whose pairs meet the corpus-wide counts in one task.
BLOCK_CHARS = 1 << 23
#: Neither tokenizer joins what stands before such a space with the space, so that the parts' tokens are those of the text.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f▁]) (?=[^\s\x1c-\x1f▁])")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their tokens and the decimal ids as they stand in a group's text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_of_letter()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(n_a, n_b) > 1 << 16:
            raise ValueError("an id pair is held in 32 bits; a vocabulary has more than 65,536 ids")
        entries = [self.a.id_to_token(i) or "" for i in range(n_a)]
        bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in entries]
        bytes_b = []
        for i in range(n_b):
            piece = self.b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = [pa.array(x, pa.binary()) for x in (bytes_a, bytes_b)]
        self.lengths = [pa.array([len(t) for t in x], pa.int64()) for x in (bytes_a, bytes_b)]
        # id * 2 + (1 where the token ends its group); those of B after those of A
        self.decimals = pa.array([f"{i}{end}" for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for end in (",", last)])
        self.first_b = 2 * n_a

    def encode(self, texts: list[str]):
        """List columns of ids of both sides."""
        import pyarrow as pa

        sides = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        return [_lists(np.fromiter(chain.from_iterable(ids), np.int32), [len(x) for x in ids], pa) for ids in sides]


def _lists(flat, lengths, pa):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _pair(path_a: str, path_b: str) -> Pair:
    return worker_cache(f"align:{path_a}:{path_b}", lambda: Pair(path_a, path_b))


def parts_of(text: str) -> list[str]:
    """A text cut into parts of about ``PART_CHARS``; a part leaves out the space before it, which both encoders add."""
    parts, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = CUT.search(text, at + PART_CHARS)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.end()
    return [*parts, text[at:]]


def _same_bytes(tables: Pair, sides, texts: list[str]):
    """Whether the bytes of both sides' tokens, joined, are the space and the text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    want = pa.array([f" {t}".encode() for t in texts], pa.binary())
    joined = [pc.binary_join(pa.ListArray.from_arrays(ids.offsets, data.take(ids.values)), b"") for ids, data in zip(sides, tables.bytes, strict=True)]
    return pc.and_(pc.equal(joined[0], want), pc.equal(joined[1], want))


def align(tables: Pair, sides) -> dict[str, np.ndarray | list]:
    """Links and groups of texts whose tokens' bytes agree: per text numbers, group texts, and (text, pair, times) of its links."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(sides[0])
    ends = []
    for ids, lengths, name in zip(sides, tables.lengths, "ab", strict=True):
        flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
        total = pc.cumulative_sum(lengths.take(flat))
        before = np.concatenate([[0], np.asarray(total)])[np.asarray(ids.offsets)[:-1]]
        segment = pc.subtract(total, pa.array(before).take(doc))
        key = pc.add(pc.shift_left(doc.cast(pa.int64()), pa.scalar(40, pa.int64())), segment)
        ends.append(pa.table({"key": key, name: pa.array(np.arange(len(flat), dtype=np.int64))}))
    cut = ends[0].join(ends[1], "key", join_type="full outer", use_threads=False).combine_chunks()
    cut = cut.take(pc.sort_indices(cut["key"]))
    at_a, at_b = cut["a"].combine_chunks(), cut["b"].combine_chunks()
    both = np.asarray(pc.and_(at_a.is_valid(), at_b.is_valid()))
    key, link_a, link_b = np.asarray(cut["key"]), np.asarray(pc.fill_null_backward(at_a)), np.asarray(pc.fill_null_backward(at_b))
    flat_a, flat_b = np.asarray(sides[0].values), np.asarray(sides[1].values)
    doc = key >> 40
    links = pa.table({"doc": doc, "pair": (flat_a[link_a].astype(np.int64) << 16) | flat_b[link_b]})
    counted = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    return {
        "n_groups": np.bincount(doc[both], minlength=n), "n_links": np.bincount(doc, minlength=n),
        "groups": _group_texts(tables, sides, flat_a, flat_b, link_a[both], link_b[both]),
        "doc": np.asarray(counted["doc"]), "pair": np.asarray(counted["pair"]).astype("<u4"), "times": np.asarray(counted["count_all"]).astype("<u4"),
    }


def _group_texts(tables: Pair, sides, flat_a, flat_b, last_a, last_b) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` per text; ``last_a`` and ``last_b`` are the tokens that end the groups."""
    import pyarrow as pa
    import pyarrow.compute as pc

    places, codes = [], []
    for flat, mine, other, first in ((flat_a, last_a, last_b, 0), (flat_b, last_b, last_a, tables.first_b)):
        closing = np.zeros(len(flat), np.int64)
        closing[mine] = 1
        group = np.cumsum(closing) - closing
        # tokens of the other side in front: of earlier groups for A, of this group as well for B
        ahead = np.concatenate([[0], other + 1])
        places.append(np.arange(len(flat)) + ahead[group + (1 if first else 0)])
        codes.append(first + 2 * flat.astype(np.int64) + closing)
    order = np.empty(len(flat_a) + len(flat_b), np.int64)
    order[places[0]], order[places[1]] = codes
    offsets = np.asarray(sides[0].offsets) + np.asarray(sides[1].offsets)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tables.decimals.take(pa.array(order))), "").to_pylist()


class _Doc:
    """Running result of one document over its parts."""

    def __init__(self, doc_id):
        self.doc_id, self.sums, self.valid, self.pairs, self.times = doc_id, np.zeros(4, np.int64), True, [], []
        self.digest, self.tail = hashlib.sha256(), ""

    def add(self, sums, groups: str, pairs, times) -> None:
        self.digest.update((self.tail + groups[:-1]).encode())
        self.tail = ";"
        self.sums += sums
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self) -> tuple:
        if not self.valid or not self.pairs:
            return self.doc_id, 0, 0, 0, 0, "", b"", b""
        pairs, times = (np.concatenate(x) for x in (self.pairs, self.times))
        if len(self.pairs) > 1:
            pairs, inverse = np.unique(pairs, return_inverse=True)
            times = np.bincount(inverse, times)
        return self.doc_id, *self.sums.tolist(), self.digest.hexdigest(), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()


def _run(tables: Pair, batch: list[tuple[_Doc, str]]) -> None:
    texts = [t for _, t in batch]
    sides = tables.encode(texts)
    good = np.asarray(_same_bytes(tables, sides, texts))
    for (doc, _), ok in zip(batch, good, strict=True):
        doc.valid &= bool(ok)
    docs = [d for (d, _), ok in zip(batch, good, strict=True) if ok]
    if not docs:
        return
    if not good.all():
        import pyarrow as pa

        kept = [s.filter(pa.array(good)) for s in sides]
        sides = [_lists(np.asarray(s.flatten()), np.diff(np.asarray(s.offsets)), pa) for s in kept]
    found = align(tables, sides)
    cuts = np.searchsorted(found["doc"], np.arange(len(docs) + 1))
    sizes = [np.diff(np.asarray(s.offsets)) for s in sides]
    for i, doc in enumerate(docs):
        at = slice(cuts[i], cuts[i + 1])
        doc.add(np.array([sizes[0][i], sizes[1][i], found["n_groups"][i], found["n_links"][i]]), found["groups"][i], found["pair"][at], found["times"][at])


ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, block long"


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of ``docs``: numbers of tokens, groups and links, the digest of its groups, its id pairs (A's id in the upper half of
    an unsigned 32-bit number) with the times that each is linked, and the block of documents that it belongs to."""
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tables = _pair(path_a, path_b)
        task, block, in_block = TaskContext.get().partitionId(), 0, 0
        names = [c.split()[0] for c in ROW.split(", ")]
        types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int64()]

        def emit(ready: list[tuple[_Doc, int]]):
            rows = [(*d.row(), b) for d, b in ready]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        waiting, size, ready = [], 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = _Doc(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                if in_block and in_block + len(text) > BLOCK_CHARS:
                    block, in_block = block + 1, 0
                in_block += len(text)
                ready.append((doc, (task << 32) | block))
                for part in parts_of(text) if text else []:
                    waiting.append((doc, part))
                    size += len(part)
                    if size >= PART_CHARS:
                        _run(tables, waiting)
                        waiting, size = [], 0
                if not waiting:
                    yield emit(ready)
                    ready = []
        if waiting:
            _run(tables, waiting)
        if ready:
            yield emit(ready)

    return narrow(docs, d=F.col("doc_id").cast("long"), t=F.coalesce(F.col("text"), F.lit(""))).mapInArrow(work, ROW)


def _block_pairs(batches):
    """Pairs added up per block, batch by batch."""
    import pyarrow as pa

    for batch in batches:
        pairs, times = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        block = np.repeat(np.asarray(batch.column(0)), [len(p) // 4 for p in pairs])
        rows = pa.table({"block": block, "pair": np.frombuffer(b"".join(pairs), "<u4").astype(np.int64), "n": np.frombuffer(b"".join(times), "<u4").astype(np.int64)})
        yield from rows.group_by(["block", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["block", "pair", "n"]).to_batches()


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(key, docs, counts):
    """Look up a block's pairs in their corpus-wide counts and add up per document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    counts = counts.sort_by("pair")
    known, n, best = (np.asarray(counts[c].combine_chunks()) if counts.num_rows else np.empty(0, np.int64) for c in ("pair", "n", "best"))
    sums = []
    for p, t in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, times = np.searchsorted(known, np.frombuffer(p, "<u4")), np.frombuffer(t, "<u4").astype(np.int64)
        sums.append((int((times * best[at]).sum()), int((times * n[at]).sum())) if len(times) else (0, 0))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, values in zip(("n_best", "count_sum"), zip(*sums, strict=True), strict=True):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out.append_column("groups_sha256", pc.cast(docs["groups_sha256"], pa.string()))


def pair_counts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair) of the written alignments, and ``pair, n, best``: corpus-wide links of each pair, 1 where B's id has no greater one."""
    per_block = cut_lineage(found.select("block", "pairs", "times").mapInArrow(_block_pairs, "block long, pair long, n long"))
    counts = cut_lineage(per_block.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFF)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # at most one row per id of B, which are 65,536
    counts = counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    return per_block.select("block", "pair").distinct(), counts


def aligned_digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    Whole texts are encoded. NULL and empty texts, and texts that a tokenizer does not give back byte by byte, have zeros and an empty
    digest and add nothing to the counts; repeated rows count each time; pairs of equal counts are all best; an empty table gives no
    rows; other columns are ignored.
    """
    found = cut_lineage(alignments(docs, path_a, path_b))
    blocks, counts = pair_counts(found)
    local = blocks.join(counts, "pair").select("block", "pair", "n", "best")
    return found.groupBy("block").cogroup(local.groupBy("block")).applyInArrow(_weighed, OUT)
