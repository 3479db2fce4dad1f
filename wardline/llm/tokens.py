"""Encoding whole texts with a public tokenizer, a batch of texts as Arrow columns.

The tokenizer treats white space as a boundary and drops it, so the ids of a text are the ids of its pieces between
white space, in order. Texts are cut into pieces, and each distinct piece of a batch is looked at once.

Where the tokenizer normalizes and splits by the rules named below, a piece of Latin letters, digits and signs is cut into the
tokenizer's own words here; the words of many pieces are encoded by its model in one call, and each ends with a token that marks
the end of a word. Any other piece, and any other tokenizer, goes through the tokenizer whole. Each worker remembers the words and
whole pieces it has met first, up to a bound; others are encoded again.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np

from wardline.llm.common import worker_cache

TOKENIZER = "word_bpe_49k.json"
#: Words and whole pieces that a worker remembers: two Arrow columns, about 30 bytes each.
REMEMBERED = 1_000_000
#: Bytes of text that are cut at a time (or one text), and ids' bytes that are put together at a time.
TEXT_BYTES, IDS_BYTES = 1 << 24, 1 << 23
#: Words in one call of the model, which needs some hundred bytes for each id.
WORDS = 1 << 14
#: Arrow splits at these, the tokenizer does not.
NOT_WHITE_SPACE = "[\x1c-\x1f]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules by which a piece may be cut into words outside the tokenizer.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, "Lowercase"]
END_OF_WORD = "</w>"
#: Pieces for which Arrow and the tokenizer agree on case, letters and digits, and their words in lower case.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PLAIN_WORDS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
PLAIN_SIGNS = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]]


def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, if the tokenizer goes by the rules above; else None."""
    given = json.loads(tokenizer.to_str())
    normalizers = [n["type"] if set(n) == {"type"} else n for n in (given["normalizer"] or {}).get("normalizers", [])]
    splits = (given["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = given["model"]
    ruled = (
        normalizers == NORMALIZERS
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0] == {"type": "Split", "pattern": {"Regex": WORD_RULE}, "behavior": "Removed", "invert": True}
        and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == END_OF_WORD and not model["dropout"]
        and all(a["content"].startswith("<|") for a in given["added_tokens"])
    )
    if not ruled:
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(END_OF_WORD)]] = True
    return ends


def _joined(parts, offsets: np.ndarray):
    """Neighbouring values as one, from each offset to the next; nothing is copied."""
    import pyarrow as pa

    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets]), parts.buffers()[2] or pa.py_buffer(b"")])


def _offsets(lists) -> np.ndarray:
    """Where each list begins in the flattened values."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.known_ids = pa.array([""]), pa.array([b""], pa.large_binary())
        self.ends = _word_ends(self.tokenizer)
        if self.ends is not None:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes_of = {ord(c): level.pre_tokenize_str(c)[0][0] for c in PLAIN_SIGNS}

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words by the model, ``WORDS`` in one call, cut behind each id that ends a word."""
        out = []
        for some in itertools.batched(words, WORDS):
            ids = np.array(self.model.encode_batch_fast([" ".join(some).translate(self.bytes_of)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some) or cuts[-1] != 4 * len(ids):
                out += self.encode_all(list(some))
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def is_plain(self, pieces):
        import pyarrow.compute as pc

        return pc.and_(pc.match_substring_regex(pieces, PLAIN), pc.invert(pc.match_substring(pieces, "<|")))

    def words_of_pieces(self, pieces):
        """A list for each piece: its words where it is plain, else itself; empty strings among them have no ids."""
        import pyarrow.compute as pc

        if self.ends is not None:
            words = pc.replace_substring_regex(pc.utf8_lower(pieces), PLAIN_WORDS, r"\1 ")
            pieces = pc.if_else(self.is_plain(pieces), words, pieces)
        return pc.split_pattern(pieces, " ")

    def encode_new(self, new):
        """Ids of words, and of pieces that are not plain; plain words have no sign that a piece of the others lacks."""
        import pyarrow as pa

        plain = self.is_plain(new).to_numpy(zero_copy_only=False) if self.ends is not None else np.zeros(len(new), bool)
        words, rest = new.filter(pa.array(plain)).to_pylist(), new.filter(pa.array(~plain)).to_pylist()
        ids = (self.encode_words(words) if words else []) + (self.encode_all(rest) if rest else [])
        place = np.empty(len(new), np.int64)
        place[np.argsort(~plain, kind="stable")] = np.arange(len(new))
        return pa.array(ids, pa.large_binary()).take(pa.array(place))

    def encode_distinct(self, words):
        """Ids of distinct words; those that there is room for are remembered."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.known)
        if not at.null_count:
            return self.known_ids.take(at)
        new, n = words.filter(at.is_null()), len(self.known)
        fresh = self.encode_new(new)
        places = at.fill_null(0).to_numpy().astype(np.int64)
        places[at.is_null().to_numpy(zero_copy_only=False)] = n + np.arange(len(new))
        every = pa.concat_arrays([self.known_ids, fresh])
        if room := max(REMEMBERED - n, 0):
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.known_ids = pa.concat_arrays([self.known_ids, fresh.slice(0, room)])
        return every.take(pa.array(places))

    def encode_column(self, texts) -> Iterator[tuple[int, object]]:
        """First row and ids (large binaries) of stretches of an Arrow column of texts."""
        import pyarrow.compute as pc

        size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(size // TEXT_BYTES)) + 1).tolist(), len(texts)]
        for first, end in zip(edges, edges[1:], strict=False):
            yield from ((first + start, ids) for start, ids in self._encode(texts.slice(first, end - first).fill_null("")))

    def _encode(self, texts) -> Iterator[tuple[int, object]]:
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, NOT_WHITE_SPACE)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if len(whole) else texts)
        offsets, coded = _offsets(lists), lists.flatten().dictionary_encode()
        del lists
        cut = self.words_of_pieces(coded.dictionary)
        words = cut.flatten().dictionary_encode()
        ids_of = _joined(self.encode_distinct(words.dictionary).take(words.indices), _offsets(cut))
        del cut, words
        size = np.concatenate([[0], np.cumsum(pc.binary_length(ids_of).to_numpy()[coded.indices.to_numpy()])])[offsets]
        edges = [0, *(np.flatnonzero(np.diff(size[1:] // IDS_BYTES)) + 1).tolist(), len(texts)]
        for first, end in zip(edges, edges[1:], strict=False):
            a, b = offsets[first], offsets[end]
            ids = _joined(ids_of.take(coded.indices.slice(a, b - a)), offsets[first : end + 1] - a)
            inside = whole[(whole >= first) & (whole < end)].tolist()
            if inside:
                given = ids.to_pylist()
                for i, data in zip(inside, self.encode_all([texts[i].as_py() for i in inside]), strict=True):
                    given[i - first] = data
                ids = pa.array(given, pa.large_binary())
            yield first, ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa

        return [data for _, ids in self.encode_column(pa.array(texts, pa.string())) for data in ids.to_pylist()]


def encoder(path: str) -> PieceEncoder:
    return worker_cache(f"pieces:{path}", lambda: PieceEncoder(path))
