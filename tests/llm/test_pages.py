"""WARC round trips and main text."""

import time
import gzip
import glob
import hashlib
import random
from base64 import b32encode

import cases
from pyspark.sql import functions as F

from wardline.llm import dom
from wardline.llm.extract import _Frame, fitted, learned, main_text, runs_of
from wardline.llm.warc import round_trip

SCHEMA = "page_id long, url string, html string"
ODD = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n日本</p>" * 40


def want(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    seen, out = set(), []
    for p, _, h in rows:
        data = (h or "").encode()
        owner = first.get(h or "")
        response = p == owner and (h or "") not in seen
        if response:
            seen.add(h or "")
        out.append((p, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else owner))
    return cases.multiset(out)


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ b\r\nx", ODD), (2, None, ODD), (9, "u", None), (7, "", ""), (3, "u", "short"), (3, "u", "short"), (None, "u", "short"), (None, "u", "alone"), (11, "u", "x" * 500 + "é" * 700)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("copies", "owner", "sha", "id", "none")})
    for chunk in (1 << 20, 97):
        folder = f"{tmp_path}/{chunk}"
        assert cases.multiset(round_trip(df, folder, chunk).collect()) == want(rows)
        data = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/*.gz"))
        assert data.count(b"WARC-Type: response\r\n") + data.count(b"WARC-Type: revisit\r\n") == len(rows)
        assert (b"WARC-Type: continuation" in data) == (chunk == 97)
    assert round_trip(spark.createDataFrame([], SCHEMA), f"{tmp_path}/empty").collect() == []


def test_equal_page_ids_with_different_payloads(spark, tmp_path):
    long = [k * 300 for k in ("é", "日", "x", "y")]
    rows = [(None, "u", long[0]), (None, "v", long[1]), (None, "u", long[0]), (None, "v", long[1]), (4, "u", long[2]), (4, "v", long[3]), (4, "u", long[2]), (4, "v", long[3]), (6, "u", long[3]), (8, "u", long[2])]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1 << 20, 97):
        folder = f"{tmp_path}/{chunk}"
        assert cases.multiset(round_trip(df, folder, chunk).collect()) == want(rows)
        heads = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/*.gz")).split(b"\r\n")
        ids = [h for h in heads if h.startswith(b"WARC-Record-ID: ")]
        assert len(ids) == len(set(ids))


def pages():
    text = lambda s, n: cases.passage(s, n)
    out = []
    for i in range(60):
        body = "".join(f"<p>{text(1000 * i + k, 20 + 7 * k)}</p>" for k in range(1, 5))
        out.append(
            f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>{text(i, 2)}</a></li><li><a href=/b>{text(i + 7, 1)}</a></li></ul></nav>"
            f"<div class='ad'>{text(i + 3, 6)}</div><article><h1>{text(i + 5, 6)}</h1>{body}</article><footer>&copy; {text(i + 9, 8)}</footer></body></html>"
        )
    return out


def test_main_text(spark):
    data = [(i, f"u{i}", h) for i, h in enumerate(pages())] + [(100, None, None), (101, "u", ""), (None, "u", pages()[0]), (102, "u", "<" * 50_000), (103, "u", "<a href='" * 20_000), (104, "u", "<div>" * 3_000 + "deep")]
    df = spark.createDataFrame(data, SCHEMA)
    trees = fitted(df)
    got = {r.page_id: r for r in main_text(df.withColumn("row", F.lit(1)), trees).collect()}
    assert len(got) == len(data)
    for i, page in enumerate(pages()):
        inner = page.split("<article>")[1].split("</article>")[0]
        blocks = [b for b in inner.replace("<h1>", "\n").replace("</h1>", "\n").replace("<p>", "\n").replace("</p>", "\n").split("\n") if b.strip()]
        assert got[i].text == "\n".join(blocks) and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == "" and got[None].text == got[0].text
    assert main_text(df.limit(0), trees).collect() == []


def test_frames_that_training_has_not_seen():
    trees, rng = learned(pages()), random.Random(77)
    short = [x.text for p in pages()[:20] for x in dom.parse(p) if x.tag == "#text"]
    right = 0
    for k in range(60):
        frame = _Frame(rng, [cases.passage(9000 + 10 * k + j, rng.randint(12, 60)) for j in range(4)], short)
        nodes = dom.parse(frame.html())
        chosen = dom.decode(nodes, trees.share(dom.features(nodes)))
        leaves = [x.text for x in nodes if x.tag == "#text"]
        right += chosen == [t for t, main in zip(leaves, frame.labels, strict=True) if main]
    assert right >= 48


def test_labels_of_ancestors_and_descendants_agree():
    nodes = dom.parse("<div><p>a</p><section><p>b</p><p>c</p></section></div>")
    import numpy as np

    share = np.full(len(nodes), 0.9)
    section = next(x for x in nodes if x.tag == "section")
    share[section.number] = 1e-5
    assert dom.decode(nodes, share) == ["a"]


def test_parser():
    texts = lambda h: [x.text for x in dom.parse(h) if x.tag == "#text"]
    assert texts("<p>a <b>b</b>c<br>d &amp;&nbsp;&#233; <p>next<ul><li>x<li>y</ul>tail<!-- no --><script>if(a<b){'</p>'}</script>") == ["a bc d & é", "next", "x", "y", "tail"]
    assert texts("<a title='>'>q</a> 1 < 2 <img alt=\">\"> z") == ["q 1 < 2 z"]
    assert texts("") == [] and texts("<script>never closed") == []


def test_parts_left_open_do_not_swallow_the_page():
    texts = lambda h: [x.text for x in dom.parse(h) if x.tag == "#text"]
    assert texts("<html><head><meta charset=u><title>x</title><link rel=r><body><article><p>a</article>") == ["a"]
    assert texts("<head><title>x</title><style>s</style><p>a") == ["a"] and texts("<head><title>x</title></head><p>a") == ["a"]
    for tag in ("button", "select", "textarea", "svg", "canvas", "object", "video", "title", "iframe"):
        assert texts(f"<div><{tag}>no</div><article><p>a</p></article>") == ["a"], tag
        assert texts(f"<div><{tag}>no</div><p>a</p><{tag}>no</{tag}><p>b</p>") == ["a", "b"], tag
        assert texts(f"<p>a</p><{tag}>no</{tag}><p>b</p>") == ["a", "b"], tag
    assert texts("<svg><svg/><svg>no</svg>no</svg><p>a</p>") == ["a"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds") == ["so x=2 holds"]
    assert texts("<svg" * 20_000 + ">" + "<svg>no" * 20_000 + "<p>a") == ["a"]


def test_siblings_are_counted_by_tag_at_every_number():
    nodes = dom.parse("<div>" + "<p>a</p>" * 300 + "<ul></ul></div>")
    alike = dom.features(nodes)[:, 9]
    assert {x.tag: alike[x.number] for x in nodes if x.tag in ("p", "ul")} == {"p": 300, "ul": 1}


def test_long_pages_fill_frames(spark):
    long = "<p>" + "</p><p>".join(cases.passage(k, 60) for k in range(400)) + "</p>"
    assert len(long) > 60_000
    runs = runs_of(long)
    assert 30_000 < sum(map(len, runs)) <= 60_000 and cases.passage(0, 60) in runs and len(runs_of("<p>" + "a " * 80_000)[0]) == 60_000
    longs = [long.replace("<p>", f"<p>{k} ") for k in range(8)]
    trees = fitted(spark.createDataFrame([(k, "u", h) for k, h in enumerate(longs)], SCHEMA))
    nodes = dom.parse(pages()[0])
    assert set(cases.passage(5, 6).split()) <= set(" ".join(dom.decode(nodes, trees.share(dom.features(nodes)))).split())


def test_tags_that_match_nothing_cost_one_step_each():
    start = time.monotonic()
    for page in ("<div>" * 60_000 + "</x>" * 60_000 + "t", "<div>" * 60_000 + "<li></li>" * 30_000, "<ul>" + "<div>" * 40_000 + "<li>" * 40_000):
        assert len(dom.parse(page)) > 60_000
    assert time.monotonic() - start < 30
    names = [(x.tag, x.depth) for x in dom.parse("<ul><li>a<div><p>b<li>c</ul></x></li>d")]
    assert names == [("#root", 0), ("ul", 1), ("li", 2), ("#text", 3), ("div", 3), ("p", 4), ("#text", 5), ("li", 2), ("#text", 3), ("#text", 1)]
