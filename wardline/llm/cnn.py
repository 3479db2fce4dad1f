"""Toxicity: a convolutional text classifier, trained in numpy, whose flags use thresholds calibrated by language.

A word is the sum of two rows of a table of embeddings, looked up by the hash of the word and the hash of its first letters. Filters of several widths slide over the whole text, the greatest
answer of each filter is kept, and a weighted sum of these is the logit. A held-back part of the training rows turns logits into
probabilities and picks the threshold of each language. Neither the language nor any id is an input of a score.

The model is fitted on every labelled row outside the held-out part, from its whole text. The rows are dealt by a hash of doc_id into
chunks of about ``CHUNK_ROWS``; in each round every chunk is gone through once in a task of its own, starting from the same model, and
the models are averaged, an embedding over the chunks that moved it. One chunk alone goes through all its rounds in a task. Words that
fewer than ``LEAST_DOCS`` rows hold keep a zero embedding, so that words never seen do not move a score. The driver holds one model,
the counts of the table's rows, and held-back rows as counts of logits.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import narrow, worker_cache
from wardline.session import broadcast_if_small, cut_lineage

#: Labelled rows that one task trains on.
CHUNK_ROWS = 12_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
PAD = max(WIDTHS) - 1
EPOCHS, BATCH, RATE, LEAST_DOCS, DROPOUT = 8, 32, 0.005, 3, 0.3
#: Letters of a longer word that are looked up beside the word itself.
PREFIX = 5
#: Every so many-th training row is held back for calibration.
HELD_BACK = 5
#: Labelled toxic rows of a language that weigh as much as the threshold of all languages.
PRIOR_ROWS = 20
#: Windows scored at a time; longer texts are scored in overlapping parts.
PART_WORDS = 1 << 15
REMEMBERED_WORDS = 500_000
#: Rows of embeddings that are averaged at a time, and steps of a logit that held-back rows are counted by.
BLOCK, STEPS = 1 << 10, 1000
#: Stripped from both ends of a word.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


def _row(key: str) -> int:
    return 1 + zlib.crc32(key.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


class _Rows(dict):
    """The embedding rows of a lower-case word as one number: that of the word, then that of its prefix; row 0 is no word."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES) or word
        value = _row(bare) | (_row(bare[:PREFIX] + "*") << 16 if len(bare) > PREFIX else 0)
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value


def word_rows(text: str | None) -> np.ndarray:
    """The embedding rows (word, prefix) of each word of a whole text, case and punctuation at the ends aside."""
    known = worker_cache("cnn_words", _Rows)
    return np.fromiter(map(known.__getitem__, (text or "").lower().split()), "<u4").view("<u2").reshape(-1, 2)


@dataclass
class Model:
    """Embeddings, filters per width as (width x DIM, FILTERS), weights of pooled answers, calibration and thresholds."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    start: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row with padding before each and after the last; where each begins and ends."""
    lengths = np.array([len(t) for t in texts])
    begins = PAD + np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]])
    row = np.zeros((int(lengths.sum()) + PAD * (len(texts) + 1), 2), np.int64)
    for at, t in zip(begins, texts, strict=True):
        row[at : at + len(t)] = t
    return row, begins, begins + lengths


def _embedded(model: Model, row: np.ndarray) -> np.ndarray:
    return model.embeddings[row[:, 0]] + model.embeddings[row[:, 1]]


def _answers(model: Model, x: np.ndarray, k: int) -> np.ndarray:
    """Answer of each filter of the k-th width to the window that starts at each place."""
    width = WIDTHS[k]
    n = len(x) - width + 1
    taps = model.filters[k].reshape(width, DIM, FILTERS)
    total = x[:n] @ taps[0]
    for j in range(1, width):
        total += x[j : j + n] @ taps[j]
    return total + model.biases[k]


def _runs(texts: list[np.ndarray]):
    """(owner, row, begins, ends, inner) of texts read some ``PART_WORDS`` at a time; ``inner`` marks ends that are not the text's."""
    parts, owner, inner = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), PART_WORDS):
            parts.append(t[max(a - PAD, 0) : a + PART_WORDS])
            owner.append(i)
            inner.append((a > 0, a + PART_WORDS < len(t)))  # no window reaches over an end that is not the text's
    inner = np.array(inner, int).reshape(-1, 2)
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b]) <= PART_WORDS):
            size += len(parts[b])
            b += 1
        yield owner[a:b], *_padded(parts[a:b]), inner[a:b]
        a = b


def _cuts(begins: np.ndarray, ends: np.ndarray, inner: np.ndarray, width: int) -> np.ndarray:
    """Where the windows of each part begin, and where those of no part do."""
    return np.stack([begins, ends], 1) - (width - 1) * np.stack([1 - inner[:, 0], inner[:, 1]], 1)


def pooled(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The greatest answer of every filter over each text; windows reach over both ends, so that none is without windows."""
    out = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
    for owner, row, begins, ends, inner in _runs(texts):
        x = _embedded(model, row)
        for k, width in enumerate(WIDTHS):
            z = np.maximum(_answers(model, x, k), 0)
            cuts = _cuts(begins, ends, inner, width).reshape(-1)
            best = np.maximum.reduceat(np.concatenate([z, np.zeros((1, FILTERS), z.dtype)]), np.minimum(cuts, len(z)))[::2]
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            for i, v in zip(owner, best, strict=True):
                out[i, at] = np.maximum(out[i, at], v)
    return out


def _winners(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """What ``pooled`` gives, and by width the words of the window that each filter answers most, (texts, FILTERS, width, 2)."""
    pool = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    words = [np.zeros((len(texts), FILTERS, width, 2), np.int64) for width in WIDTHS]
    for owner, row, begins, ends, inner in _runs(texts):
        x = _embedded(model, row)
        for k, width in enumerate(WIDTHS):
            z = _answers(model, x, k)
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            for i, (first, last) in zip(owner, _cuts(begins, ends, inner, width), strict=True):
                place = np.minimum(first + z[first:last].argmax(0) if last > first else np.full(FILTERS, first), len(z) - 1)
                value = z[place, np.arange(FILTERS)]
                better = np.flatnonzero(value > pool[i, at])
                pool[i, at][better] = value[better]
                words[k][i, better] = row[place[better][:, None] + np.arange(width)]
    return np.maximum(pool, 0), words


def logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    return (pooled(model, texts) @ model.weights + model.start).astype(np.float64)


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, value: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        """One step; with ``rows`` only these rows of value have a gradient."""
        self.t += 1
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * g
        self.v[at] = 0.999 * self.v[at] + 0.001 * g * g
        value[at] -= RATE * (self.m[at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[at] / (1 - 0.999**self.t)) + 1e-8)


def _seen(texts: list[np.ndarray]) -> np.ndarray:
    """How many texts hold each row of the embeddings."""
    seen = np.zeros(BUCKETS, np.int64)
    for t in texts:
        seen[np.unique(t)] += 1
    return seen


def _first_model(seen: np.ndarray, share: float, rng: np.random.Generator) -> tuple[Model, np.ndarray]:
    known = seen >= LEAST_DOCS
    known[0] = False
    embeddings = (rng.standard_normal((BUCKETS, DIM)) * 0.1 * known[:, None]).astype(np.float32)
    filters = [(rng.standard_normal((w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
    share = np.clip(share, 1e-3, 1 - 1e-3)
    weights = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
    return Model(embeddings, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weights, float(np.log(share / (1 - share)))), known


def _new_model(texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> tuple[Model, np.ndarray]:
    return _first_model(_seen(texts), float(y.mean()), rng)


def _passes(model: Model, known: np.ndarray, texts: list[np.ndarray], y: np.ndarray, count: int, rng: np.random.Generator) -> None:
    """Go through the texts ``count`` times in batches, by backpropagation; a text's gradient flows through the one window that each filter answers most."""
    start = np.array([model.start], np.float32)
    best = {n: _Adam(p.shape) for n, p in [("e", model.embeddings), ("u", model.weights), ("c", start)]}
    best |= {("w", k): _Adam(model.filters[k].shape) for k in range(len(WIDTHS))} | {("b", k): _Adam(FILTERS) for k in range(len(WIDTHS))}
    for _ in range(count):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            pool, won = _winners(model, [texts[i] for i in picked])
            kept = (rng.random(pool.shape) >= DROPOUT) / np.float32(1 - DROPOUT)
            p = 1 / (1 + np.exp(-np.clip((pool * kept) @ model.weights + start[0], -30, 30)))
            d = ((p - y[picked]) / len(picked)).astype(np.float32)
            to_pool = d[:, None] * model.weights[None] * kept * (pool > 0)
            words, grads, changes = [], [], []
            for k, width in enumerate(WIDTHS):
                g = to_pool[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                taps = model.filters[k].reshape(width, DIM, FILTERS)
                change = np.zeros_like(taps)
                for j in range(width):
                    spot = won[k][:, :, j].reshape(-1, 2)
                    change[j] = np.einsum("bfd,bf->df", _embedded(model, spot).reshape(len(picked), FILTERS, DIM), g)
                    words.append(spot)
                    grads.append((g[:, :, None] * taps[j].T[None]).reshape(-1, DIM))
                changes.append((change.reshape(width * DIM, FILTERS), g.sum(0)))
            for k, (change, shift) in enumerate(changes):
                best["w", k].step(model.filters[k], change)
                best["b", k].step(model.biases[k], shift)
            best["u"].step(model.weights, (pool * kept).T @ d)
            best["c"].step(start, np.array([d.sum()]))
            moved, spots = np.concatenate(grads), np.concatenate(words)
            live = np.flatnonzero(moved.any(1))
            rows, inverse = np.unique(spots[live], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inverse.reshape(-1), np.repeat(moved[live], 2, axis=0))
            rows, total = rows[known[rows]], total[known[rows]]
            best["e"].step(model.embeddings, total, rows)
        model.start = float(start[0])


def _packed(model: Model) -> list[np.ndarray]:
    """The model as blocks of numbers: all but the embeddings first, then these, ``BLOCK`` rows each."""
    dense = [*model.filters, *model.biases, model.weights, np.array([model.start], np.float32)]
    return [np.concatenate([x.reshape(-1) for x in dense]).astype(np.float32), *np.split(model.embeddings, BUCKETS // BLOCK)]


def _unpacked(blocks: list[np.ndarray]) -> Model:
    dense, sizes = blocks[0], [w * DIM * FILTERS for w in WIDTHS] + [FILTERS] * len(WIDTHS) + [len(WIDTHS) * FILTERS, 1]
    *filters, first, second, third, weights, start = np.split(dense.copy(), np.cumsum(sizes)[:-1])
    filters = [f.reshape(w * DIM, FILTERS) for f, w in zip(filters, WIDTHS, strict=True)]
    return Model(np.concatenate(blocks[1:]).reshape(BUCKETS, DIM), filters, [first, second, third], weights, float(start[0]))


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Slope and shift of the least log loss on held-back rows, ``n`` of each kind, found on a grid of slopes so that separable rows stay finite."""
    best = (np.inf, 1.0, 0.0)
    for slope in np.geomspace(0.1, 3.0, 24):
        shift = 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
            shift -= float(np.clip(((n * (p - y)).sum() + 0.1 * shift) / ((n * p * (1 - p)).sum() + 0.1), -2, 2))
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        best = min(best, (float(loss), float(slope), shift))
    _, model.slope, model.shift = best


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The score with the greatest F1 on these rows, ``n`` of each kind, halfway to the next lower one; 0.5 without both labels."""
    if len(np.unique(y)) < 2:
        return 0.5
    n = np.ones(len(y)) if n is None else n
    order = np.argsort(-p, kind="stable")
    ps, hits = p[order], np.cumsum((n * y)[order])
    last = np.append(ps[1:] != ps[:-1], True)
    f1 = np.where(last, 2 * hits / (np.cumsum(n[order]) + (n * y).sum()), -1)
    at = int(f1.argmax())
    return float((ps[at] + (ps[at + 1] if at + 1 < len(ps) else 0)) / 2)


def _fix_thresholds(model: Model, z: np.ndarray, y: np.ndarray, langs: np.ndarray, n: np.ndarray) -> None:
    """Calibrate on held-back rows and pick thresholds by language, each blended with that of all languages by its rows."""
    if len(np.unique(y)) < 2:
        return
    _calibrate(model, z, y, n)
    p = model.probabilities(z)
    model.threshold = best_threshold(p, y, n)
    for name in np.unique(langs):
        mine = langs == name
        known = float((n * y)[mine].sum())
        model.thresholds[str(name)] = (known * best_threshold(p[mine], y[mine], n[mine]) + PRIOR_ROWS * model.threshold) / (known + PRIOR_ROWS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _chunks(batches):
    """(chunk, texts, labels, languages, which are held back) of each chunk of rows in the order of doc_id; every fifth row is held back."""
    chunk, rows = None, []

    def whole():
        back = np.arange(len(rows)) % HELD_BACK == HELD_BACK - 1
        return chunk, [np.frombuffer(w, "<u2").reshape(-1, 2) for w, _, _ in rows], np.array([y for _, y, _ in rows], float), [lang or "" for _, _, lang in rows], back

    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "y", "lang")), strict=True):
            if at != chunk and rows:
                yield whole()
                rows = []
            chunk = at
            rows.append(row)
    if rows:
        yield whole()


def _picked(texts: list, mask: np.ndarray) -> list:
    return [t for t, m in zip(texts, mask, strict=True) if m]


def _known_words(table: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many rows to train on hold each row of the embeddings; how many of these rows there are, and how many labelled 1."""

    def count(batches):
        import pyarrow as pa

        for _, texts, y, _, back in _chunks(batches):
            seen = _seen(_picked(texts, ~back))
            at = np.flatnonzero(seen)
            names, values = [*at.tolist(), -1, -2], [*seen[at].tolist(), int((~back).sum()), int(y[~back].sum())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.int64())], names=["at", "n"])

    found = {r["at"]: r["n"] for r in table.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    rows, ones = found.pop(-1, 0), found.pop(-2, 0)
    seen = np.zeros(BUCKETS, np.int64)
    seen[list(found)] = list(found.values())
    return seen, rows, ones


def _round(table: DataFrame, model: Model, known: np.ndarray, number: int, passes: int) -> Model:
    """The mean of the models that each chunk's rows make of this one."""
    shared = table.sparkSession.sparkContext.broadcast((_packed(model), known))

    def learn(batches):
        import pyarrow as pa

        for chunk, texts, y, _, back in _chunks(batches):
            mine = _unpacked(shared.value[0])
            _passes(mine, shared.value[1], _picked(texts, ~back), y[~back], passes, np.random.default_rng([number, chunk]))
            for at, block in enumerate(_packed(mine)):
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "chunk": [chunk], "n": pa.array([int((~back).sum())], pa.int64()), "body": [block.tobytes()]})

    def mean(key, found):
        import pyarrow as pa

        old = shared.value[0][key[0].as_py()]
        total, weight = np.zeros(old.shape), np.zeros((len(old),) + (1,) * (old.ndim - 1))
        for i in np.argsort(found.column("chunk").to_numpy()):
            n, change = found.column("n")[i].as_py(), np.frombuffer(found.column("body")[i].as_buffer(), np.float32).reshape(old.shape) - old
            # what a chunk's rows do not hold is not held back by it
            weight += n * change.any(1, keepdims=True) if old.ndim > 1 else n
            total += n * change
        body = (old + total / np.maximum(weight, 1)).astype(np.float32).tobytes()
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "body": [body]})

    models = table.mapInArrow(learn, "at int, chunk long, n long, body binary")
    blocks = {r["at"]: bytes(r["body"]) for r in models.groupBy("at").applyInArrow(mean, "at int, body binary").collect()}
    shared.unpersist()
    return _unpacked([np.frombuffer(blocks[at], np.float32).reshape(old.shape) for at, old in enumerate(_packed(model))])


def _held_back(table: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, language, rows) of the held-back rows, counted by steps of a logit."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        for _, texts, y, langs, back in _chunks(batches):
            z = np.rint(np.clip(logits(shared.value, _picked(texts, back)), -50, 50) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(y[back].astype(np.int32)), pa.array(_picked(langs, back), pa.string())], names=["z", "y", "lang"])

    got = sorted(tuple(r) for r in table.mapInArrow(work, "z long, y int, lang string").groupBy("z", "y", "lang").count().collect())
    z, y, langs, n = zip(*got, strict=True) if got else ((),) * 4
    return np.array(z, float) / STEPS, np.array(y, float), np.array(langs, object), np.array(n, float)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on all labelled documents outside the held-out part.

    Labels other than 0 and 1 are ignored; a document with several labels counts as its largest, with several texts as its least.
    Texts are kept as the numbers of their words, a file per chunk in the order of doc_id, which every round reads again.
    """
    d, y = F.col("doc_id").cast("long"), F.col(label).cast("int")
    known = narrow(labels, doc_id=d, y=y).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = cut_lineage(known.groupBy("doc_id").agg(F.max("y").alias("y")))
    chunks = max(-(-known.count() // CHUNK_ROWS), 1)
    rows = narrow(docs, doc_id=d, text=F.coalesce(F.col("text"), F.lit("")), lang=F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string"))
    rows = rows.join(broadcast_if_small(known), "doc_id")

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                columns = [one.column("doc_id"), one.column("lang"), one.column("y"), pa.array([word_rows(one.column("text")[0].as_py()).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "y", "words"])

    found = rows.mapInArrow(words, "doc_id long, lang string, y int, words binary").groupBy("doc_id").agg(F.min(F.struct("words", "lang", "y")).alias("r"))
    dealt = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), "doc_id", "r.*")
    table = cut_lineage(dealt.repartitionById(chunks, F.col("chunk").cast("int")).sortWithinPartitions("chunk", "doc_id"))
    seen, count, ones = _known_words(table)
    model, mask = _first_model(seen, ones / count if count else 0.5, np.random.default_rng(7))
    if 0 < ones < count:
        for number in range(EPOCHS if chunks > 1 else 1):
            model = _round(table, model, mask, number, 1 if chunks > 1 else EPOCHS)
    _fix_thresholds(model, *_held_back(table, model))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, flagged`` per row of ``docs``.

    ``predicted`` is 1 from a score of 0.3 on, ``flagged`` from the threshold of the row's language on (that of all languages where
    it has none). NULL and empty texts have a score like others; repeated rows get equal scores; an empty table gives no rows; other
    columns are ignored.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                p = model.probabilities(logits(model, [word_rows(t) for t in part.column("text").to_pylist()]))
                limit = np.array([model.thresholds.get(name or "", model.threshold) for name in part.column("lang").to_pylist()], float)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.3).astype(np.int32)), pa.array(limit), pa.array(p >= limit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    d = F.col("doc_id").cast("long")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = narrow(docs, doc_id=d, held_out=held_out(d), lang=lang, text=F.coalesce(F.col("text"), F.lit("")))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")
