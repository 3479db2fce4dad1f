"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; a model is a lookup table per feature and per chosen pair of features. The tables are
learned by boosting shallow trees in turns, one feature after the other, then one pair after the other. A score is the sum
of one table entry per feature and pair, added for whole batches at once, then squeezed into 0 to 1.

The model is fitted on at most ``SAMPLE`` labelled rows, picked by a hash of doc_id; every row is scored from its whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import narrow
from wardline.llm.repeats import texts_of

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 240, 80, 0.1, 4
#: Pull of a leaf towards zero, in rows, and the least rows of a leaf.
RIDGE, LEAST_ROWS = 1.0, 5

FEATURES = (
    "log_words", "word_length", "distinct_words", "symbols", "punctuation", "digits", "capitals", "exclamations", "bars", "equal_neighbours", "repeated_lines",
    "words_per_line", "top_word", "distinct_triples", "beyond_ascii", "closed_lines", "long_words",
)


def _classes() -> np.ndarray:
    kinds = np.zeros((256, 7), np.float64)
    for i, chars in enumerate(("#*$%&|<>", ".,;:?'\"()-", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "|")):
        kinds[[ord(c) for c in chars], i] = 1
    kinds[0xC0:, 6] = 1  # first bytes of characters beyond ASCII
    return kinds


CLASSES = _classes()


def features(data: bytes) -> list[float]:
    """The feature values of one whole text, in the order of ``FEATURES``."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    symbols, points, digits, capitals, calls, bars, wide = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    closed = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        np.log(n), chars / n, len(counts) / n ** 0.8, symbols / n, points / n, digits / chars, capitals / n, calls / n, bars / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(counts.values()) / n, triples, wide / chars, closed / len(lines), sum(len(w) > 24 for w in words) / n,
    ]


@dataclass
class Model:
    """Cut points and tables; ``edges[f]`` cuts feature f into len + 1 bins, pairs use the coarser ``pair_edges``."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, (cut, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of all values and of those above the least, so that a feature that is mostly zero has bins, too."""
    places = np.arange(1, bins // 2) / (bins // 2)
    above = values[values > values.min()]
    return np.unique(np.concatenate([np.quantile(v, places, method="higher") for v in (values, above) if len(v)]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_ROWS) | (n.sum() - nl < LEAST_ROWS)] = -1
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Step of each bin by a tree that cuts the best part further until it has ``leaves``."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [_best_cut(g[a:b], h[a:b], n[a:b]) for a, b in parts]
        k = max(range(len(parts)), key=lambda i: cuts[i][0])
        if cuts[k][0] <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + cuts[k][1]), (a + cuts[k][1], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that cuts one feature, then either side along the other."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        G, H, N = (m.T if flip else m for m in (g, h, n))
        for cut in range(1, len(G)):
            step, gain = np.zeros_like(G), -_gain(G.sum(), H.sum())
            for rows in (slice(0, cut), slice(cut, len(G))):
                a, b, c = G[rows].sum(0), H[rows].sum(0), N[rows].sum(0)
                more, at = _best_cut(a, b, c)
                gain += _gain(a.sum(), b.sum()) + max(more, 0)
                for cols in (slice(0, at), slice(at, len(a))) if more > 0 else (slice(0, len(a)),):
                    step[rows, cols] = a[cols].sum() / (b[cols].sum() + RIDGE)
            if gain > best[0]:
                best = (gain, step.T if flip else step)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn a model from feature rows and labels 0/1; without both labels it is the constant share of label 1."""
    if not len(y):
        return Model(0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.start)
    model.edges = [_cuts(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.edges)]
    counts = [np.bincount(b, minlength=len(c) + 1) for b, c in zip(bins, model.edges, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.edges]
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            g, h = np.bincount(b, y - p, len(counts[f])), np.bincount(b, p * (1 - p), len(counts[f]))
            step = RATE * _tree(g, h, counts[f])
            model.tables[f] += step
            total += step[b]
    model.pair_edges = [_cuts(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.pair_edges)]
    sizes = [len(c) + 1 for c in model.pair_edges]

    def grid(a: int, b: int, weights: np.ndarray | None) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], weights, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]).astype(float)

    p = 1 / (1 + np.exp(-total))
    gains = []
    for a in range(len(sizes)):
        for b in range(a + 1, len(sizes)):
            gains.append((_pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b, None))[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b, None))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def featured(rows: DataFrame) -> DataFrame:
    """``doc_id`` and the feature values of ``text``."""

    def work(batches):
        import pyarrow as pa

        ids, values = [], []
        for batch, i, data in texts_of(batches):
            ids.append(batch.column("doc_id")[i].as_py())
            values.append(features(data))
            if len(ids) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])
                ids, values = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(work, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out part, the ones with the least hash of doc_id.

    Labels other than 0 and 1 are ignored; a document with several labels counts as its largest.
    """
    d, y = F.col("doc_id").cast("long"), F.col(label).cast("int")
    known = narrow(labels, doc_id=d, y=y).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = narrow(docs, doc_id=d, text=F.coalesce(F.col("text"), F.lit(""))).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    one = featured(rows).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(picked), "doc_id")
    got = sorted((r["doc_id"], r["y"], r["x"]) for r in one.collect())
    return fit(np.array([r[2] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    NULL and empty texts have all features 0 and a score like others; repeated rows get equal scores; an empty table gives no
    rows; other columns, the language and the source among them, are ignored.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(data) for _, _, data in texts_of([batch])]).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = F.col("doc_id").cast("long")
    rows = narrow(docs, doc_id=d, held_out=held_out(d), text=F.coalesce(F.col("text"), F.lit("")))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
