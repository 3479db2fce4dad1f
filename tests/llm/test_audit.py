"""Filter interactions against applying every order to every document."""

import re
from collections import Counter
from itertools import permutations

import cases

from wardline.llm.interaction import interactions


def brute(rows, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    judged = []
    for d, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if d is not None and any(o is not None and o < d and (t or "") == text for o, t, *_ in rows) else set()
        judged.append((lang or "", d, fails))
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                mine = [(d, f) for p, d, f in judged if p == part]
                here = [d for d, f in mine if name in f and not f & before]
                out[part, "".join(order), step] = [
                    sum(not f & (before | {name}) for _, f in mine), len(here), sum(name in f and bool(f & before) for _, f in mine), sum(f == {name} for _, f in mine),
                    sum(d in good for d in here), sum(d in toxic for d in here),
                ]
                removed_by[part, name] += len(here)
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (9, 1, 0), (9, 0, 1), (12, None, None), (None, 1, 1), (15, 0, 0), (99, 1, 1)]


def test_every_order_on_awkward_rows(spark):
    rows = cases.rows() + [(20 + i, t, lang, None, 0) for i, (t, lang) in enumerate([("LOUD TEXT", "de"), ("a # b", None), ("", ""), ("cas cas " * 150, "de"), ("Cas cas " * 150, "de"), (None, "fr")])]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = interactions(cases.with_clashes(cases.table(spark, rows)), labels.withColumn("text", labels.doc_id.cast("string"))).collect()
    assert len(got) == len({r.part for r in got}) * 600
    assert {tuple(r) for r in got} == brute(rows, LABELS)


def test_a_text_that_most_rows_share(spark):
    rows = [(i, "copied text" if i % 3 else cases.passage(i, 210), "en", None, 0) for i in range(1500)]
    got = interactions(cases.table(spark, rows), spark.createDataFrame([(2, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int"))
    first = got.where("filter_order = 'EABCD' and step = 1").first()
    assert (first.removed, first.kept, first.good_lost, first.toxic_lost) == (999, 501, 1, 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(cases.table(spark, []), none).collect() == []
    assert interactions(cases.table(spark), none).where("good_lost + toxic_lost > 0").count() == 0
