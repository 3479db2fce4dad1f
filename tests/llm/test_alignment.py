"""Token alignment against comparing the byte ranges of all tokens of a text."""

import hashlib
from collections import Counter

import cases
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wardline.llm import align
from wardline.llm.align import Pair, aligned_digest, parts_of


def _letters():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in kept:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def tokens(sides, text):
    a, b = sides
    letters = _letters()
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 and b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (one, two) if text and all(b"".join(t for _, t in s) == want for s in (one, two)) else ([], [])


def ranges(side):
    at, out = 0, []
    for i, data in side:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(sides, rows):
    found, counts = [], Counter()
    for d, text, *_ in rows:
        a, b = (ranges(s) for s in tokens(sides, text or ""))
        links, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in x if start <= s and e <= end) for x in (a, b)))
            start = end
        found.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for d, n_a, n_b, n_g, links, text in found
    ]


ODD = [
    "two  spaces   three", "tab\tnew\n\nline \n end ", "▁ lower block", "<|endoftext|> and <s> </s> <unk> <0x41>", "é é ﬁ 　wide", "emoji \U0001f600\U0001f468‍\U0001f469 x",
    "\x00 nul \x1c gap", " leading", "trailing ", " ", "don't we'll 12345 ###", "﻿mark", "a" * 300,
]


def test_against_byte_ranges(spark, sides):
    rows = [r for r in cases.rows() if r[0] != 13] + [(100 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    got = aligned_digest(cases.with_clashes(cases.table(spark, rows)))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert cases.multiset(got.collect()) == cases.multiset(brute(sides, rows))
    assert {r.doc_id: r.n_a for r in got.collect()}[102] == 0
    assert aligned_digest(cases.table(spark, [])).collect() == []


def test_long_texts_in_parts(sides, monkeypatch):
    monkeypatch.setattr(align, "PART_CHARS", 40)
    tables = Pair(*(public_tokenizers.path(n) for n in (align.TOKENIZER_A, align.TOKENIZER_B)))
    for text in [*ODD, cases.passage(3, 80), "no space " + "x" * 200, "a \n b \t c  d " * 20]:
        parts = parts_of(text)
        assert " ".join(parts) == text
        whole, cut = tables.encode([text]), tables.encode(parts)
        for one, many in zip(whole, cut, strict=True):
            assert one.flatten().to_pylist() == many.flatten().to_pylist()
    doc = align._Doc(1)
    text = cases.passage(7, 90)
    align._run(tables, [(doc, p) for p in parts_of(text)])
    assert len(doc.pairs) > 3
    want = brute(sides, [(1, text)])[0]
    assert doc.row()[1:6] == (*want[1:5], want[7])


def test_blocks_share_corpus_counts(spark, sides, monkeypatch):
    rows = [(i, cases.passage(i % 17, 40), "en", "s", 0) for i in range(60)]
    got = aligned_digest(cases.table(spark, rows).repartition(7))
    assert cases.multiset(got.collect()) == cases.multiset(brute(sides, rows))
