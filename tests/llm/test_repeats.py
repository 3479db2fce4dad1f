"""Substring operators against counting every window."""

import hashlib
from collections import Counter

import cases
import pytest

from wardline.llm import repeats
from wardline.llm.rlz import relative_factors, remove_substrings, substring_digest
from wardline.llm.suffix import repeated_bytes_digest


def gone(symbols: list, counts: Counter, window: int) -> list[bool]:
    out = [False] * len(symbols)
    for i in range(len(symbols) - window + 1):
        if counts[tuple(symbols[i : i + window])] > 1:
            out[i : i + window] = [True] * window
    return out


def marks(texts: list[list], window: int) -> list[list[bool]]:
    counts = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    return [gone(t, counts, window) for t in texts]


def digest(parts: bytes) -> str:
    return hashlib.sha256(parts).hexdigest()


@pytest.mark.parametrize("gathered", [repeats.GATHERED, 1])
def test_word_windows(spark, monkeypatch, gathered):
    monkeypatch.setattr(repeats, "GATHERED", gathered)
    data = cases.rows()
    texts = [cases.words(r[1]) for r in data]
    want = Counter()
    for r, t, g in zip(data, texts, marks(texts, 35), strict=True):
        want[r[0], len(t), sum(g), digest(b" ".join(w for w, x in zip(t, g, strict=True) if not x))] += 1
    assert cases.multiset(substring_digest(cases.with_clashes(cases.table(spark))).collect()) == want


@pytest.mark.parametrize("gathered", [repeats.GATHERED, 1])
def test_byte_windows(spark, monkeypatch, gathered):
    monkeypatch.setattr(repeats, "GATHERED", gathered)
    data = [r for r in cases.rows() if r[0] != 13]
    texts = [list((r[1] or "").encode()) for r in data]
    want = Counter()
    for r, t, g in zip(data, texts, marks(texts, 200), strict=True):
        starts = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        want[r[0], len(t), sum(g), starts, digest(bytes(b for b, x in zip(t, g, strict=True) if not x))] += 1
    assert cases.multiset(repeated_bytes_digest(cases.with_clashes(cases.table(spark, data))).collect()) == want


def test_other_window_lengths_and_pieces(spark, monkeypatch):
    data = [(i, t, None, None, 0) for i, t in enumerate(["aa bb cc dd ee", "cc dd ee ff", "aa bb", "zz aa bb cc"])]
    texts = [cases.words(r[1]) for r in data]
    got = {r.doc_id: r.n_removed for r in substring_digest(cases.table(spark, data), 3).collect()}
    assert got == {r[0]: sum(g) for r, g in zip(data, marks(texts, 3), strict=True)}


def test_factors_cover_what_is_removed(spark):
    found = {}
    for r in relative_factors(cases.table(spark)).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        assert r.length >= 35
    removed = {r.doc_id: r.n_removed for r in substring_digest(cases.table(spark)).collect()}
    assert {d: len(s) for d, s in found.items()} == {d: n for d, n in removed.items() if n}


def test_removal_keeps_rows_and_columns(spark):
    df = cases.with_clashes(cases.table(spark))
    out = remove_substrings(df)
    assert out.columns == df.columns and out.count() == df.count()
    got = {r.doc_id: r for r in out.where("doc_id IN (5, 6, 8, 10)").collect()}
    assert got[5].text is None and got[6].text == "" and got[8].text == "one" and got[10].row == "kept-row"
    assert got[10].text == " ".join(cases.passage(2, 260).split()) and got[10].n_chars == len(got[10].text)


def test_empty_table(spark):
    empty = cases.table(spark, [])
    assert substring_digest(empty).collect() == [] and repeated_bytes_digest(empty).collect() == [] and remove_substrings(empty).collect() == []
