"""Quality rules, scores, decontamination, packing and lengths on awkward rows."""

import itertools
import random
import tracemalloc
import zlib
from collections import defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import gam, tokens
from wardline.llm.decontam import contaminated, drop_contaminated
from wardline.llm.lengths import at_limits, length_histogram, quantiles, suffix_sums
from wardline.llm.packing import BINS, LENGTH, Index, pack
from wardline.llm.rules import bucket, bucket_start, keep_good, quality_verdicts, thresholds
from wardline.llm.tokens import PieceEncoder, tokenizer_path


def ids_of(texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_rules_counts(spark):
    out = quality_verdicts(cases.with_clashes(cases.table(spark)).drop("n_words", "kept")).collect()
    want = cases.multiset([])
    for r in cases.rows():
        w = cases.words(r[1])
        grams = defaultdict(list)
        for i in range(len(w) - 7):
            grams[tuple(w[i : i + 8])].append(i)
        covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in (r[1] or "").split("\n") if cases.words(x)]
        symbols = sum(c in "#*$%&|<>" for c in r[1] or "")
        chars = sum(len(x.decode()) for x in w)
        want[r[0], len(w), chars, symbols, len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert cases.multiset(r[:-1] for r in out) == want
    assert all(not (r.base_failed and r.kept) for r in out)
    assert quality_verdicts(cases.table(spark, [])).collect() == []


def test_thresholds_adapt_to_the_group(spark):
    clean = [(i, cases.passage(100 + i, 80), "en", "plain", 0) for i in range(220)]
    marked = [(1000 + i, " ".join(w + "*" for w in cases.passage(500 + i, 80).split()), "en", "marked", 0) for i in range(220)]
    odd = (5000, " ".join(w + "*#" for w in cases.passage(9, 80).split()), "en", "plain", 0)
    df = cases.with_clashes(cases.table(spark, [*clean, *marked, odd]))
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in df.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {5000}


def test_junk_of_two_fifths_of_a_group_goes(spark):
    text = lambda i, mark: " ".join(w + mark for w in cases.passage(i, 60).split())
    clean = [(i, text(i, ""), "en", "a", 0) for i in range(180)]
    junk = [(1000 + i, text(500 + i, "*" * (1 + i % 3)), "en", "a", 0) for i in range(120)]
    other = [(2000 + i, text(2000 + i, ""), "en", "b", 0) for i in range(250)]
    few = [(3000 + i, text(4000 + i, ""), None, None, 0) for i in range(3)]
    kept = {r.doc_id for r in quality_verdicts(cases.with_clashes(cases.table(spark, clean + junk + other + few)).drop("n_words", "kept")).where("kept").collect()}
    assert kept == {r[0] for r in clean + other + few}


def test_limits_follow_the_group_without_a_step(spark):
    row = lambda source, n, v: [("en", source, "word_length", int(b), n) for b in [v]]
    at = {v: spark.range(1).select(bucket(F.lit(v)).alias("b")).first().b for v in (4000, 5000, 8000)}
    highs = []
    for n in (10, 199, 200, 201, 100_000):
        sketch = spark.createDataFrame(row("most", 5000, at[4000]) + row("own", n, at[8000]) + row("wide", n, at[5000]), "lang string, source string, measure string, bucket long, n long")
        highs.append({r.source: r.word_length_high for r in thresholds(sketch).collect()})
    assert highs[1] == highs[2] == highs[3] and highs[0]["own"] < highs[4]["own"] and highs[4]["wide"] < highs[4]["own"]


def test_buckets_hold_their_values(spark):
    df = spark.range(0, 200_000, 7).select("id", bucket(F.col("id")).alias("b"))
    for r in df.select("id", bucket_start(F.col("b")).alias("s"), bucket_start(F.col("b") + 1).alias("e")).collect():
        assert r.s <= r.id < r.e and (r.e - r.s) * 32 <= max(r.id, 32)


def test_scores_on_held_out_rows(spark):
    good = [(i, cases.passage(i, 60 + i % 40), "en", "s", 0) for i in range(400)]
    bad = [(400 + i, " ".join(w + "$" * (i % 3 + 1) for w in cases.passage(2000 + i, 60).split()), "en", "s", 0) for i in range(200)]
    docs = cases.table(spark, [*good, *bad, *cases.rows()])
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(600)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = gam.train(docs, labels)
    out = gam.scored(cases.with_clashes(docs), model)
    rows = out.collect()
    assert len(rows) == 600 + len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id is not None and 20 <= r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id < 400) for r in judged]) > 0.97
    again = {(r.doc_id, round(r.score, 12)) for r in gam.scored(docs, gam.train(docs, labels)).collect()}
    assert again == {(r.doc_id, round(r.score, 12)) for r in rows}
    assert gam.scored(cases.table(spark, []), model).collect() == []
    assert gam.train(docs, labels.limit(0)).score(np.zeros((1, len(gam.FEATURES))))[0] == 0.5


def test_pairs_catch_what_single_features_miss():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_contaminated_windows(spark):
    item, edited = cases.passage(70, 40), cases.passage(71, 50).split()
    edited[25] = "other"
    docs = [*cases.rows(), (101, f"{cases.passage(72, 30)} {item} {cases.passage(73, 30)}", "en", "s", 0), (102, cases.passage(74, 20) + " " + " ".join(edited), "en", "s", 0), (103, " ".join(item.split()[:20]), "en", "s", 0), (104, "five words", "en", "s", 0)]
    bench = spark.createDataFrame([(1, item), (2, cases.passage(71, 50)), (3, None), (4, " "), (5, "five words"), (None, item), (1, item)], "item_id long, text string")
    df = cases.with_clashes(cases.table(spark, docs))
    got = sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 6)) for r in contaminated(df, bench).collect())
    near = cases.weighted(cases.shingles(" ".join(edited)), cases.shingles(cases.passage(71, 50)))
    assert near >= 0.8 and got == [(101, 1, 30, 40, 1.0), (102, 2, 20, 50, round(near, 6)), (104, 5, 0, 2, 1.0)]
    clean = drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == len(docs) - 3
    assert contaminated(df, bench.limit(0)).collect() == [] and contaminated(cases.table(spark, []), bench).collect() == []


def test_items_cut_off_by_the_ends_of_a_text(spark):
    item = cases.passage(80, 59).split()
    before, after = cases.passage(81, 30), cases.passage(82, 30)
    cut = {1: item[:-1], 2: item[1:], 3: item[4:-4], 4: item[:40]}
    docs = [(d, " ".join(w)) for d, w in cut.items()] + [(5, " ".join(item[7:]) + " " + after), (6, before + " " + " ".join(item[:-7])), (7, before + " " + " ".join(item[:-12])), (8, before + " " + " ".join(item))]
    df = cases.table(spark, [(d, t, "en", "s", 0) for d, t in docs])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.start, r.n_words, round(r.similarity, 6)) for r in contaminated(df, bench).collect()}
    share = lambda n: round((n - 4) / 55, 6)
    assert got == {1: (0, 58, share(58)), 2: (0, 58, share(58)), 3: (0, 51, share(51)), 5: (0, 52, share(52)), 6: (30, 52, share(52)), 8: (30, 59, 1.0)}
    assert sorted(r.doc_id for r in drop_contaminated(df, bench).collect()) == [4, 7]


def test_pieces_hold_every_id_once(spark):
    data = [*cases.rows(), (200, "<|endoftext|> x<|startoftext|>y", "en", "s", 0)]
    out = pack(cases.with_clashes(cases.table(spark, data))).collect()
    want = cases.multiset([])
    for r, ids in zip(data, ids_of([r[1] for r in data]), strict=True):
        want[r[0], len(ids) + 1] += 1
    assert sum(r.length for r in out) == sum(n * k for (_, n), k in want.items())
    assert {(r.doc_id, r.doc_tokens) for r in out} == set(want)
    ids = {(r[0], len(i) + 1): np.array([*i, 1], "<u4") for r, i in zip(data, ids_of([r[1] for r in data]), strict=True) if r[0] is not None}
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
        if r.doc_id is not None:
            assert zlib.crc32(ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for rows in sequences.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        assert end == LENGTH or (end < LENGTH and end & (end - 1) == 0)
    assert pack(cases.table(spark, [])).collect() == []


def test_pieces_encode_like_whole_texts():
    texts = [r[1] for r in cases.rows()] + ["don't STOP", "áb é ́x", "İstanbul ΣΑΣ", "x y z\u0085w", "x\x1dy z", "🙂🙂 a🙂b", "1234 56", "<|endoftext|>a b<|endoftext|>"]
    enc = PieceEncoder(tokenizer_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == ids_of(texts)


def test_words_of_pieces_are_encoded_once_and_together():
    rng = random.Random(5)
    signs = "abcXYZ019'sStTdDlLmMvVrReE<|>/w_-.,!\"#~ÀÉßöÿ×÷İıſ日é́ª²Σς"
    pieces = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(5000)] + ["</w>", "a</w>b", "'LL'x", "it's'STart", "x" * 3000, "<|startoftext|", "a<|endoftext|>b"]
    enc = PieceEncoder(tokenizer_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(pieces)] == ids_of(pieces)
    enc, asked = PieceEncoder(tokenizer_path()), []
    whole, words = enc.encode_all, enc.encode_words
    enc.encode_all = lambda given: asked.append(("pieces", given)) or whole(given)
    enc.encode_words = lambda given: asked.append(("words", sorted(given))) or words(given)
    texts = ["Hello, hello HELLO. (hello)", "hello; world-hello"]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == ids_of(texts)
    assert asked == [("words", sorted(["hello", ",", ".", "(", ")", ";", "world", "-"]))]


def test_a_worker_remembers_words_in_little_memory():
    enc = PieceEncoder(tokenizer_path())
    enc.encode(["warm up"])
    words = ["".join(w) + end for w in itertools.product("abcdefghij", repeat=5) for end in ("", ",")]
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    enc.encode([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert taken < 10_000_000


def test_batches_cut_anywhere_encode_alike(monkeypatch):
    texts = [r[1] for r in cases.rows()] + ["", None, " \t\n", "one two\x1dthree", "eins zwei drei, vier. " * 9, "日本 don't İst", "\x1e", "one two three"]
    column = pa.array(["left out", *texts, "left out", "left out"]).slice(1, len(texts))
    enc, want = PieceEncoder(tokenizer_path()), ids_of(texts)
    for name, value in (("REMEMBERED", 3), ("TEXT_BYTES", 40), ("IDS_BYTES", 30), ("WORDS", 2)):
        monkeypatch.setattr(tokens, name, value)
    for _ in range(2):
        at, found = 0, []
        for start, ids in enc.encode_column(column):
            assert start == at
            at += len(ids)
            found += [np.frombuffer(b, "<u4").tolist() for b in ids.to_pylist()]
        assert found == want
    assert len(enc.known) == len(enc.known_ids) <= 4
    assert enc.encode([]) == [] and list(enc.encode_column(pa.array([], pa.string()))) in ([], [(0, pa.array([], pa.large_binary()))])


def test_an_index_without_used_documents_scores_the_others_alike():
    rng = np.random.default_rng(3)
    texts = [rng.integers(2, 400, rng.integers(0, 90)).astype("<u4") for _ in range(64)]
    idf = rng.random(BINS).astype(np.float32)
    index, whole, free = Index(texts, idf, 40.0), Index(texts, idf, 40.0), np.ones(64, bool)
    for k in rng.permutation(64)[:60]:
        free[k] = False
        index.forget_used(free)
        query = index.of[k][0]
        assert (index.scores(query, 64)[free] == whole.scores(query, 64)[free]).all()
    assert len(index.doc) < len(whole.doc) / 4


def test_length_histogram(spark):
    data = cases.rows()
    lengths = sorted(map(len, ids_of([r[1] for r in data])))
    hist = length_histogram(cases.with_clashes(cases.table(spark)))
    sums = suffix_sums(hist)
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n) and r.docs_at_most == sum(x <= n for x in lengths) and r.docs_longer == sum(x > n for x in lengths)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.dropped_tokens == sum(max(x - n, 0) for x in lengths)
        assert r.tokens_at_most == sum(x for x in lengths if x <= n) and r.share_at_most == pytest.approx(r.docs_at_most / len(lengths))
    for r in at_limits(hist, [0, 1, 5, 100, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths) and r.docs_longer == sum(x > r.context_limit for x in lengths)
    assert [r.n_tokens for r in quantiles(sums, [0.0, 0.5, 1.0]).collect()] == [lengths[0], lengths[(len(lengths) + 1) // 2 - 1], lengths[-1]]
    assert suffix_sums(length_histogram(cases.table(spark, []))).collect() == []
