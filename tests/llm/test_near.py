"""Near duplicates against comparing all pairs, and components against union-find."""

import random

import cases
import numpy as np

from wardline.llm import dart
from wardline.llm.components import components
from wardline.llm.dart import band_keys, keep_one, near_duplicates, shingles, signature, similarity


def classes(data, least=0.8):
    bags = [cases.shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and cases.weighted(a, bags[j]) >= least:
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(data):
        if bags[i] and r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return [(r[0], ids.get(find(i)) if bags[i] else r[0]) for i, r in enumerate(data)]


def test_classes_with_awkward_rows(spark):
    data = cases.rows()
    assert cases.multiset(near_duplicates(cases.with_clashes(cases.table(spark))).collect()) == cases.multiset(classes(data))
    assert near_duplicates(cases.table(spark, [])).collect() == []


def test_a_group_of_edited_copies(spark):
    rng, words = random.Random(5), cases.passage(9, 200).split()
    data = []
    for i in range(60):
        mine = list(words)
        for _ in range(rng.randint(0, 6)):
            mine[rng.randrange(len(mine))] = f"edit{rng.randint(0, 9)}"
        data.append((i, " ".join(mine), "en", "s", 0))
    assert sorted(tuple(r) for r in near_duplicates(cases.table(spark, data)).collect()) == sorted(classes(data))


def test_one_row_of_each_class_stays(spark):
    df = cases.with_clashes(cases.table(spark))
    out = keep_one(df)
    assert out.columns == df.columns
    kept = out.select("doc_id", "text").collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15] and sum(r.doc_id is None for r in kept) == 2


def test_signature_agreement_is_weighted_similarity():
    rng = np.random.default_rng(3)
    for n, m in ((400, 300), (50, 45), (3, 2), (3000, 2500)):
        a = shingles(" ".join(f"w{x}" for x in rng.integers(0, 10**9, n)).encode())
        b = np.concatenate([a[:m], shingles(b"q w e r t y u i o p")])
        agree = np.mean([(signature(a ^ np.uint64(s)) == signature(b ^ np.uint64(s))).mean() for s in range(1, 30)])
        assert abs(agree - similarity(a, b)) < 0.06
    assert (band_keys(signature(a)) == band_keys(signature(a[::-1]))).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(500 + i, 501 + i) for i in range(60)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in links for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_a_template_family_links_only_what_is_similar(spark):
    rng, frame = random.Random(8), cases.passage(3, 60).split()
    data = []
    for i in range(40):
        own = cases.passage(1000 + i // 2, 26).split()
        if i % 2:
            own[rng.randrange(len(own))] = "other"
        data.append((i, " ".join(frame[:30] + own + frame[30:]), "en", "s", 0))
    got = sorted(tuple(r) for r in near_duplicates(cases.table(spark, data)).collect())
    assert got == sorted(classes(data)) and len({c for _, c in got}) > 10


def test_word_hashes_of_pieces_of_any_length(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"ab \t\n\x0b\x0c\r\x1c\xc2\xa0") for _ in range(rng.randint(1, 60)))
        monkeypatch.setattr(dart, "PIECE", 1 << 20)
        whole = dart.word_hashes(data)
        monkeypatch.setattr(dart, "PIECE", 7)
        assert (dart.word_hashes(data) == whole).all() and len(whole) == len(data.split())
        assert len(dict(zip(data.split(), whole.tolist(), strict=True))) == len(set(whole.tolist()))
