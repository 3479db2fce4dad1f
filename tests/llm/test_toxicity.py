"""The convolutional classifier: gradients, whole texts, held-out rows and thresholds by language."""

import random
import zlib

import cases
import numpy as np

from wardline.llm import cnn


def plain_pool(model, rows):
    """Every filter at every window, text by text."""
    out = []
    for t in rows:
        padded = np.concatenate([np.zeros((cnn.PAD, 2), int), t, np.zeros((cnn.PAD, 2), int)])
        x = model.embeddings[padded[:, 0]] + model.embeddings[padded[:, 1]]
        values = []
        for k, width in enumerate(cnn.WIDTHS):
            first = cnn.PAD - width + 1
            z = [x[i : i + width].reshape(-1) @ model.filters[k] + model.biases[k] for i in range(first, cnn.PAD + len(t))]
            values.append(np.maximum(np.max(z, axis=0), 0) if z else np.zeros(cnn.FILTERS))
        out.append(np.concatenate(values))
    return np.array(out)


def some_model(texts):
    rng = np.random.default_rng(3)
    model = cnn._new_model(texts, np.array([0.5]), rng)[0]
    model.embeddings = rng.standard_normal(model.embeddings.shape).astype(np.float32)
    model.embeddings[0] = 0
    model.biases = [rng.standard_normal(cnn.FILTERS).astype(np.float32) for _ in cnn.WIDTHS]
    return model


def test_pooling_is_that_of_the_whole_text(monkeypatch):
    texts = [cnn.word_rows(t) for t in ["one", cases.passage(1, 30), "", None, cases.passage(2, 301), "a b", cases.passage(3, 77)]]
    model = some_model(texts)
    want = plain_pool(model, [t for t in texts if len(t)])
    for part in (1 << 15, 64, 10):
        monkeypatch.setattr(cnn, "PART_WORDS", part)
        got = cnn.pooled(model, texts)
        assert np.abs(got[[i for i, t in enumerate(texts) if len(t)]] - want).max() < 1e-4
        assert (got[2] == got[3]).all()


def test_words_are_looked_up_without_case_and_edges():
    a, b, c = (cnn.word_rows(t) for t in ("Strange!! word", "strange WORD###", "strangely"))
    assert (a == b).all() and a[0, 1] == c[0, 1] != 0 and a[0, 0] != c[0, 0] and a[1, 1] == 0


def test_thresholds():
    p, y = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1, 1, 1, 0, 0])
    assert 0.2 < cnn.best_threshold(p, y) <= 0.3
    assert cnn.best_threshold(p, np.ones(5)) == 0.5


def rows_with_bad_words():
    rng, bad = random.Random(4), {"en": ["vexun", "grolt", "zarp"], "de": ["achtung1", "blorf", "snark"]}
    docs, labels = [], []
    for i in range(1400):
        lang = "en" if i % 3 else "de"
        words = cases.passage(i, rng.randint(5, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad[lang]) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = rows_with_bad_words()
    docs += [(r[0] + 5000 if r[0] is not None else None, *r[1:]) for r in cases.rows()]
    table, marks = cases.table(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (4, 1, 9)], "doc_id long, quality int, toxic int")
    model = cnn.train(cases.with_clashes(table), marks)
    got = cnn.scored(cases.with_clashes(table), model).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.flagged == (r.score >= r.threshold) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r for r in got if r.held_out and r.doc_id < 1400]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in judged]) > 0.97
    assert set(model.thresholds) == {"en", "de"}
    assert len({r.score for r in got if r.doc_id in (5005, 5006, 5007)}) == 1
    # the language is no input: the same texts under other names have the same scores
    other = cnn.scored(table.drop("lang"), model).collect()
    assert sorted((str(r.doc_id), r.score) for r in other) == sorted((str(r.doc_id), r.score) for r in got)
    again = cnn.train(table.repartition(3), marks)
    assert np.array_equal(again.embeddings, model.embeddings) and again.thresholds == model.thresholds


def test_labels_outside_the_training_part_are_not_read(spark):
    docs, labels = rows_with_bad_words()
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    one, two = (cnn.train(cases.table(spark, docs[:300]), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(one.embeddings, two.embeddings) and one.shift == two.shift


def test_empty_tables_and_single_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = cnn.train(cases.table(spark, []), none)
    assert cnn.scored(cases.table(spark, []), model).collect() == []
    assert {round(r.score, 6) for r in cnn.scored(cases.table(spark), model).collect()} <= {round(float(x), 6) for x in np.linspace(0, 1, 1_000_001)}
    ones = cnn.train(cases.table(spark), spark.createDataFrame([(d, 1, 1) for d in range(1, 16)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in cnn.scored(cases.table(spark), ones).collect())


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    docs, labels = rows_with_bad_words()
    # a word that only whole long texts hold
    docs += [(2000 + i, " ".join(["calm"] * 50_001 + ["only"] + [f"spoken{i}"]), "en", "s", 0) for i in range(12)]
    labels += [(2000 + i, 1, 0) for i in range(12)]
    table, marks = cases.table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(cnn, "CHUNK_ROWS", 500)
    model = cnn.train(table, marks)
    assert model.embeddings[cnn.word_rows("only")[0, 0]].any()
    assert set(model.thresholds) == {"en", "de"}
    judged = [r for r in cnn.scored(table, model).collect() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id < 1400 and r.doc_id % 5 == 0) for r in judged]) > 0.95
    again = cnn.train(table.repartition(3), marks)
    assert np.array_equal(again.embeddings, model.embeddings) and again.thresholds == model.thresholds


def test_long_texts_are_read_in_parts(monkeypatch):
    texts = [cnn.word_rows(t) for t in ["one", cases.passage(1, 30), "", cases.passage(2, 301), "a b"]]
    model = some_model(texts)
    pool, words = cnn._winners(model, texts)
    assert np.allclose(pool, cnn.pooled(model, texts), atol=1e-5)
    monkeypatch.setattr(cnn, "PART_WORDS", 10)
    in_parts, others = cnn._winners(model, texts)
    assert np.allclose(pool, in_parts, atol=1e-5) and all((a[1] == b[1]).all() and (a[3] == b[3]).all() for a, b in zip(words, others, strict=True))
