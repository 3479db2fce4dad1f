"""Main text of web pages: boosted trees over the nodes of the page's tree, decoded so that ancestors and descendants agree.

No table says what the main text of a page is, so the trees learn from pages whose labels are known by construction: the texts of a bounded
sample of the given pages (long runs as articles, the others as surroundings) are set into page frames drawn at random, with
and without telling element names and class words, with menus, sidebars, notices, adverts, forms and reader comments around and between.
"""

from __future__ import annotations

import random
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import dom
from wardline.llm.boost import Trees, train
from wardline.llm.common import narrow

#: Pages whose texts the frames are filled with, and frames made of each.
SAMPLE, FRAMES = 200, 5
#: Characters of a sampled page's runs that are kept, so that the sample has a bound in bytes, too.
SAMPLE_CHARS = 60_000


class _Frame:
    """One made-up page and, per run of text in page order, whether it is main text."""

    def __init__(self, rng: random.Random, article: list[str], other: list[str]):
        self.rng, self.article, self.other = rng, article, other
        self.plain = rng.random() < 0.15
        self.parts: list[str] = []
        self.labels: list[bool] = []

    def run(self, tag: str, text: str, main: bool) -> str:
        self.labels.append(main)
        return f"<{tag}>{text}</{tag}>" if tag else text

    def box(self, names: list[str], words: list[str], inner: str) -> str:
        rng = self.rng
        name = "div" if self.plain else rng.choice(names)
        word = rng.choice(words)
        word = rng.choice((word, f"{word}-{rng.randint(1, 9)}", f"site-{word}", f"{word} x{rng.randint(1, 99)}", word.title()))
        kind = "" if self.plain or (name not in ("div", "section", "ul", "p") and rng.random() < 0.5) else f' {rng.choice(("class", "class", "id"))}="{word}"'
        return f"<{name}{kind}>{inner}</{name}>"

    def some(self, low: int, high: int) -> str:
        words = self.rng.choice(self.other).split()
        start = self.rng.randrange(len(words))
        return " ".join(words[start : start + self.rng.randint(low, high)])

    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(3, 9)))
        return self.box(["nav", "div", "ul"], ["menu", "nav", "navigation", "navbar", "breadcrumb"], f"<ul>{items}</ul>")

    def link(self) -> str:
        self.labels.append(False)
        return f'<a href="/{self.rng.randint(1, 999)}">{self.some(1, 3)}</a>'

    def advert(self) -> str:
        return self.box(["div", "aside"], ["ad", "ads", "advert", "sponsor", "promo", "banner"], self.run(self.rng.choice(["p", "div", "", ""]), self.some(2, 30), False))

    def notice(self) -> str:
        return self.box(["div", "section"], ["cookie", "consent", "notice", "alert", "newsletter", "subscribe", "popup"], self.run("p", self.some(5, 40), False))

    def form(self) -> str:
        return self.box(["form"], ["form", "search", "login", "signup"], self.run("div", self.some(1, 6), False) + "<input name=q>")

    def sidebar(self) -> str:
        inner = self.run("h3", self.some(1, 4), False) + "".join(self.run("p", self.some(4, 30), False) for _ in range(self.rng.randint(0, 2))) + "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(0, 6))) + "</ul>"
        return self.box(["aside", "div", "section"], ["sidebar", "related", "widget", "recommended", "social"], inner)

    def comments(self) -> str:
        one = lambda: self.box(["div", "li", "article"], ["comment", "reply"], self.run("p", self.some(4, 60), False))
        return self.box(["section", "div"], ["comments", "discussion", "responses", "respond"], self.run("h3", self.some(1, 3), False) + "".join(one() for _ in range(self.rng.randint(1, 6))))

    def main(self) -> str:
        rng, inner = self.rng, ""
        for k, text in enumerate(self.article):
            if k and rng.random() < 0.06 and not self.plain:
                inner += rng.choice((self.advert, self.notice, self.sidebar))()
            tag = "h1" if k == 0 and rng.random() < 0.7 else "p"
            if k and rng.random() < 0.08:
                tag = rng.choice(("h2", "blockquote", "pre", "li", "div"))
            body = self.run(tag, text, True)
            inner += f"<ul>{body}</ul>" if tag == "li" else body
        return self.box(["article", "article", "main", "div", "section"], ["content", "post", "article", "entry", "story", "main", "body"], inner)

    def html(self) -> str:
        rng = self.rng
        maybe = lambda part, share: part() if rng.random() < share else ""
        page = maybe(lambda: self.box(["header", "div"], ["header", "masthead", "top"], self.run("h1", self.some(1, 4), False)), 0.4)
        page += maybe(self.menu, 0.8) + maybe(self.notice, 0.25) + maybe(self.advert, 0.5) + maybe(self.form, 0.25) + maybe(self.sidebar, 0.25)
        page += self.main()
        page += ("" if self.plain else maybe(self.comments, 0.4)) + maybe(self.sidebar, 0.4) + maybe(self.advert, 0.3) + maybe(self.form, 0.2)
        page += self.box(["footer", "div"], ["footer", "copyright", "legal"], self.run(rng.choice(("", "", "p", "div")), rng.choice(("&copy; ", "")) + self.some(1, 60), False)) if rng.random() < 0.85 else ""
        if rng.random() < 0.4:
            page = f"<div>{page}</div>"
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>"


def runs_of(page: str, chars: int = SAMPLE_CHARS) -> list[str]:
    """The runs of text of a page; of one with more than ``chars`` characters of text, some from all over it, cut where they have so many."""
    runs = [x.text for x in dom.parse(page) if x.tag == "#text"]
    out: list[str] = []
    for text in runs[:: max(1, ceil(sum(map(len, runs)) / chars))]:
        if chars <= 0:
            break
        out.append(text[:chars])
        chars -= len(text)
    return out


def learned(pages: list[str], seed: int = 7, frames: int = FRAMES) -> Trees:
    """Train on frames filled with the texts of ``pages``."""
    return learned_from_runs([runs_of(p) for p in pages], seed, frames)


def learned_from_runs(pages: list[list[str]], seed: int = 7, frames: int = FRAMES) -> Trees:
    """Train on frames filled with the runs of text of each page."""
    import html

    rng = random.Random(seed)
    runs = [[html.escape(t, quote=False) for t in p] for p in pages]
    long = [[t for t in r if len(t) >= 60] for r in runs]
    short = [t for r in runs for t in r if t.split()] or ["a"]
    rows, labels = [np.zeros((0, dom.FEATURES))], [np.zeros(0)]
    for mine in long:
        for _ in range(frames if mine else 0):
            article = list(mine)
            if rng.random() < 0.5:
                article.insert(0, " ".join(article[0].split()[:10]))
            if rng.random() < 0.4:
                article = [t if rng.random() < 0.7 else " ".join(t.split()[: rng.randint(2, 15)]) for t in article]
            if rng.random() < 0.25:
                article = [" ".join(t.split()[: rng.randint(1, 20)]) for t in article[: rng.randint(1, 3)]]
            frame = _Frame(rng, article, short)
            nodes = dom.parse(frame.html())
            inside = np.zeros(len(nodes), bool)
            leaves = [x for x in nodes if x.tag == "#text"]
            if len(leaves) != len(frame.labels):
                continue
            for x, main in zip(leaves, frame.labels, strict=True):
                while main and x is not None and not inside[x.number]:
                    inside[x.number] = True
                    x = x.parent
            rows.append(dom.features(nodes))
            labels.append(inside.astype(float))
    return train(np.concatenate(rows), np.concatenate(labels))


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for the table: at most ``sample`` of its distinct pages, those with the least hash of the page, fill the frames."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                runs = pa.array([runs_of(batch.column("html")[i].as_py())], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(i, 1), runs], names=["h", "runs"])

    rows = narrow(pages, html=F.col("html")).where(F.length("html") > 0)
    keys = rows.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(sample)
    picked = rows.withColumn("h", F.xxhash64("html")).join(F.broadcast(keys), "h").groupBy("h").agg(F.min("html").alias("html"))
    return learned_from_runs([r["runs"] for r in picked.mapInArrow(work, "h long, runs array<string>").orderBy("h").collect()])


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``, from the whole page.

    Character references are decoded, white space in a block is one space, blocks follow each other in page order, one per
    line. NULL and empty pages and pages without main text give an empty text; repeated rows give equal rows; a block is in on a
    tie only if its probability is above one half; an empty table gives no rows; other columns are ignored.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                trees_of = [dom.parse(p) if p else [] for p in part.column("html").to_pylist()]
                share = trees.share(np.concatenate([np.zeros((0, dom.FEATURES)), *[dom.features(n) for n in trees_of if n]]))
                texts, at = [], 0
                for nodes in trees_of:
                    texts.append("\n".join(dom.decode(nodes, share[at : at + len(nodes)])) if nodes else "")
                    at += len(nodes)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = narrow(pages, page_id=F.col("page_id").cast("long"), url=F.col("url"), html=F.col("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
