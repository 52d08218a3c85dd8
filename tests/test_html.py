"""Elements at any depth, against a plain reading with a stack of open tags."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storyledger.functions import html as H
from storyledger.operators.pages import article_text, plain_text, with_page_signals

TAG = re.compile(r"<(/?)([a-z][a-z0-9-]*)((?:\s[^<>]*)?)>")


def spans(page):
    """(start, stop, name, tag) of every closed element, by start; an end tag closes the last open tag of its name."""
    open_tags, found = {}, []
    for m in TAG.finditer(page):
        own = open_tags.setdefault(m[2], [])
        if not m[1]:
            own.append(m)
        elif own:
            first = own.pop()
            found.append((first.start(), m.end(), m[2], first[0]))
    return sorted(found)


def plain_elements(page, name):
    return [page[a:b] for a, b, n, _ in spans(page) if n == name]


def plain_without(page, names):
    out, at = "", 0
    for a, b, n, _ in spans(page):
        if n in names and a >= at:
            out, at = out + page[at:a], b
    return out + page[at:]


def plain_with(page, word):
    ends = {a: b for a, b, _, _ in spans(page)}
    hits = [m for m in TAG.finditer(page) if not m[1] and f'class="{word}' in m[3]]
    return [page[m.start() : ends.get(m.start(), m.end())] for m in hits]


def random_page(rng):
    names = rng.choices(["div", "p", "div-x", "nav", "a", "br"], k=rng.randint(1, 3))
    parts = []
    for _ in range(rng.randint(0, 40)):
        name = rng.choice(names)
        parts.append(rng.choice([f"<{name}>", f'<{name} class="by">', f"</{name}>", f"</{name}>", "text é", " < 3 "]))
    return "".join(parts)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    rows = [random_page(rng) for _ in range(600)]
    return spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, html string").repartition(8)


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randint(-9, 9) for _ in range(n)] for n in [0, 1, 2, 15, 16, 17, 18, 100, 1000, 5001]]
    frame = spark.createDataFrame([(x,) for x in lists], "v array<int>")
    for row in frame.select("v", H.running(F.col("v")).alias("s")).collect():
        total, want = 0, []
        for x in row.v:
            total += x
            want.append(total)
        assert row.s == want


def test_elements_of_any_markup(pages):
    page = F.col("html")
    got = pages.select(
        "html", H.elements(page, "div").alias("divs"), H.without_elements(page, ("nav", "div")).alias("rest"),
        H.longest_element(page, "div").alias("longest"), H.elements_with(page, r"(?<=\s)class=\"by").alias("marked"),
    ).collect()
    for r in got:
        divs = plain_elements(r.html, "div")
        assert r.divs == divs
        assert r.longest == max(divs, key=len, default="")
        assert r.rest == plain_without(r.html, ("nav", "div"))
        assert r.marked == plain_with(r.html, "by")


@pytest.mark.parametrize("depth", [0, 1, 3, 25, 1000])
def test_depth_does_not_matter(spark, depth):
    def wrapped(name, text):
        return f"<{name}>" * depth + text + f"</{name}>" * depth

    words = "The board set out its reasons in some detail today. " * 12
    page = (
        f'<html><body>{wrapped("nav", "menu")}<div class="byline">{wrapped("div", "By Ann Lee")}</div>'
        f'<blockquote>{wrapped("blockquote", "said so")}</blockquote><article>{wrapped("article", f"<p>{words}</p>")}</article>'
        f"<footer>{wrapped('footer', 'end')}</footer></body></html>"
    )
    frame = spark.createDataFrame([("https://n.example/a", page)], "url string, html string")
    row = with_page_signals(frame).select("page_byline", "quotes", article_text(F.col("html")).alias("text"), plain_text(F.col("html")).alias("plain")).first()
    assert row.page_byline == "By Ann Lee"
    assert row.quotes == ["said so"] * (depth + 1)
    assert row.text == words.strip()
    assert row.plain.startswith("menu" * (depth == 0) + "By Ann Lee") and row.plain.endswith(words.strip())
