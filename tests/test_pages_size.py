"""Readers of pages cost a page's size; and short texts are those of the plain way."""

from __future__ import annotations

import random
import time

from granary.sources import dom, pages


def test_short_texts_are_the_plain_ones():
    rng = random.Random(6)
    for _ in range(300):
        html = "".join(rng.choice(["<div>", "</div>", "<b class=date>", "</b>", " x", "y ", "\n\t", "2024-02-05", "<a href=/n>", "</a>", "long " * 9, "<p>", " "]) for _ in range(30))
        root = dom.parse(html)
        texts, linked = dom.short_texts(root, 80), dom.below(root, "a")
        for n in root.nodes():
            plain = n.text()
            assert texts[id(n)] == (plain if len(plain) < 80 else None), html
            assert (id(n) in linked) == n.inside("a")


def test_hostile_pages():
    began = time.perf_counter()
    many = "<div>" + "".join(f"<a href='/news/{i}.html'>A title of news {i}</a> " for i in range(3000)) + "</div>"
    assert len(pages.listing("https://x.cn/", many)) == 120
    some = "<div>" + "<a href='/x'>s</a>" * 3000 + "".join(f"<a href='/news/{i}.html'>A title of news {i}</a> " for i in range(3000)) + "</div>"
    assert len(pages.listing("https://x.cn/", some, most=3000)) == 3000
    deep = "<div class=date>" * 4000 + "2024-02-05" + "</div>" * 4000
    assert pages.metadata(deep, "https://x.cn/")[3] == ["2024-02-05"] * 4000
    assert time.perf_counter() - began < 6
