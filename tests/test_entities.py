"""Character references against the standard library."""

from __future__ import annotations

import random
from html import unescape
from html.entities import html5

from pyspark.sql import functions as F

from granary.functions import text as T


def both(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return {r.i: r.u for r in df.select("i", T.unescaped("t").alias("u")).collect()}


def test_every_name_is_decoded(spark):
    texts = [f"&{n}" for n in html5] + [f"x&{n.rstrip(';')} y" for n in html5] + [f"&{n}abc" for n in html5 if not n.endswith(";")]
    got = both(spark, texts)
    assert [t for i, t in enumerate(texts) if got[i] != unescape(t)] == []


def test_numbers_and_odd_texts(spark):
    numbers = [0, 1, 8, 9, 10, 11, 12, 13, 14, 31, 32, 65, 127, 128, 129, 130, 150, 159, 160, 173, 8217, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFE, 0x10FFFF, 0x110000, 99999999, 10**12]
    texts = [f for n in numbers for f in (f"&#{n};", f"a&#{n}b", f"&#x{n:x};", f"&#X{n:X} ", f"&#00{n};")]
    texts += ["", None, "&", "&&", "&;", "&#;", "&#x;", "&amp;lt;", "a & b", "&nosuch;", "&notit;", "&notin;", "&amp", "&AMP;x", "R&D", "&eacute;t&eacute", "&#8217;s", "1&lt2", "&é;", "x" * 50 + "&copy2024&reg;&hellip;" * 40, "&" + "a" * 40 + ";", "&lt;b&gt;&nbsp;&quot;"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["&", "#", "x", ";", "amp", "lt", "not", "in", "1", "8", "é", " ", "copy"]) for _ in range(12)) for _ in range(2000)]
    got = both(spark, texts)
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != unescape(t or "")] == []


def test_titles_and_summaries(spark):
    df = spark.createDataFrame([("Caf&eacute;&#8217;s &unknown; <b>AT&amp;T</b>&nbsp;",)], "t string")
    row = df.select(T.clean_title("t").alias("a"), T.summary("t").alias("b"), T.clean_text("t").alias("c"), F.lit(1)).first()
    assert row.a == "Café’s  <b>AT&T</b> ".strip(" ") or row.a == "Café’s  <b>AT&T</b>"
    assert row.b == "Café’s AT&T" and row.c == "Café’s &unknown; <b>AT&T</b>"
