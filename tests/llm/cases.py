"""Small tables with the awkward rows every operator must bear, and plain Python versions of what operators compute."""

from __future__ import annotations

import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for working columns.
CLASHES = ["row", "text_key", "z", "node", "key", "spans", "given", "anchor", "place", "n_words", "kept", "root", "g", "_w", "had_text", "bands", "html", "sha"]


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def rows() -> list[tuple]:
    base, other, shared = passage(1, 300), passage(2, 260), passage(3, 60)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    far = " ".join(w if i % 9 else f"x{i}" for i, w in enumerate(words))
    texts = [
        (1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (10, f"{other} {shared}"), (11, f"{shared} {passage(4, 90)}"),
        (12, "a b " * 400), (13, passage(5, 9000) + " " + shared), (None, passage(6, 80)), (None, passage(6, 80)), (None, None), (14, passage(8, 40) + "\x00\x1c odd space"), (1, base), (15, "\n".join(["same line here"] * 30)),
    ]
    out = []
    for i, (d, t) in enumerate(texts):
        out.append((d, t, None if i % 5 == 4 else "en", None if i % 7 == 6 else f"s{i % 2}", None if t is None else len(t)))
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"kept-{c}").alias(c) for c in CLASHES if c not in df.columns])


def multiset(got) -> Counter:
    return Counter(tuple(r) for r in got)


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text, size: int = 5) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def weighted(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / sum((a | b).values())
