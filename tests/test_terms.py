"""Tables of denied terms against searching every term in every text."""

import pathlib
import random
import re

from wardline.operators.terms import match_terms


def brute(rows, terms):
    out = []
    for key, text in rows:
        for term in {t for t in terms if t and len(t) >= 2}:
            out += [(key, term, m.start(), len(term)) for m in re.finditer(re.escape(term), text or "")]
    return sorted(out)


def test_offsets_of_overlapping_terms(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé\U0001f600 ") for _ in range(n))
    terms = [word(rng.randint(1, 5)) for _ in range(120)] + ["aa", "aaa", "a", "", None, "aa", "\\Qx\\E", "no such"]
    rows = [(i, word(rng.randint(0, 200))) for i in range(60)] + [(100, None), (101, ""), (102, "aaaaaaa"), (102, "aaaaaaa"), (None, "x aa \\Qx\\E")]
    texts, table = spark.createDataFrame(rows, "key long, body string"), spark.createDataFrame([(t,) for t in terms], "term string")
    order = lambda found: sorted((tuple(r)[:4] for r in found.collect()), key=repr)
    want = sorted((x for k, t in rows for x in brute([(k, t)], terms)), key=repr)
    assert order(match_terms(texts, "body", ["key"], table)) == want
    assert order(match_terms(texts, "body", ["key"], table, part_chars=90)) == want
    assert match_terms(texts, "body", ["key"], table.limit(0)).collect() == []
    assert match_terms(texts.limit(0), "body", ["key"], table).columns == ["key", "term", "index", "length", "fp", "auth_id"]


def test_many_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('term', id, 'x') as term")
    texts = spark.range(2000).selectExpr("id as key", "concat('some term', id * 50, 'x and term', id * 50 + 1, 'y') as body")
    assert {(r.key, r.term) for r in match_terms(texts, "body", ["key"], terms).collect()} == {(k, f"term{50 * k}x") for k in range(2000)}


def worker_peak():
    """The largest memory that a Python worker of this machine has had, in MB."""
    peaks = [0]
    for p in pathlib.Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                peaks.append(int((p / "status").read_text().split("VmHWM:")[1].split()[0]) // 1024)
        except (OSError, IndexError):
            pass
    return max(peaks)


def test_long_text_with_many_matches(spark):
    # the text repeated for each match would be 4.5 GB
    texts = spark.range(1).selectExpr("id as key", "repeat('abcd ', 30000) as body")
    before = worker_peak()
    found = match_terms(texts, "body", ["key"], spark.createDataFrame([("abcd",)], "term string"))
    assert sorted(r["index"] for r in found.select("index").collect()) == list(range(0, 150_000, 5))
    assert worker_peak() <= max(before, 2000)
