"""Text functions as column expressions: cleaning, matching, keys and hashes.

All are total: null is taken as empty text unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import ANNOUNCEMENT_WORDS, NEGATIONS, NOTICE_TERMS

SPACE = "(?U)\\s+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: A character reference: decimal, hexadecimal, or a name of up to 32 characters.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def _listed(words: Iterable[str]) -> Column:
    """A constant list that travels as one text."""
    return F.split(F.lit("\x01".join(words)), "\x01", -1)


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference. Numbers 128 to 159 mean the Windows alphabet; what is no character gives none, or U+FFFD."""
    hexadecimal = F.rlike(reference, F.lit("^&#[xX]"))
    digits = F.regexp_replace(F.regexp_replace(reference, "^&#[xX]?0*", ""), ";$", "")
    number = F.when(digits == "", F.lit(0)).when(F.length(digits) > 8, F.lit(1 << 30)).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)).cast("long")
    windows = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
    known = F.map_from_arrays(_listed(map(str, windows)), _listed(windows.values()))

    def letter(n: Column) -> Column:
        own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        # noncharacters and controls but tab, line feed and form feed
        none = n.between(1, 8) | n.between(14, 31) | (n == 11) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | ((n.bitwiseAND(0xFFFE) == 0xFFFE) & (n <= 0x10FFFF))
        return F.when(n.between(0x80, 0x9F) | n.isin(0, 13), F.element_at(known, n.cast("string"))).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(none, "").otherwise(own)

    return _let(number, letter)


def _named(reference: Column) -> Column:
    """What a named reference stands for: the whole name, else the longest name at its start that needs no semicolon, else itself."""
    names = F.map_from_arrays(_listed(f"&{n}" for n in html5), _listed(html5.values()))
    bare = _listed(f"&{n}" for n in sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))

    def start(r: Column) -> Column:
        longest = F.get(F.filter(bare, lambda n: F.startswith(r, n)), F.lit(0))
        return F.coalesce(F.try_element_at(names, r), _let(longest, lambda n: F.concat(F.try_element_at(names, n), F.substr(r, F.length(n) + 1))), r)

    return start(reference)


def unescaped(c: Column | str) -> Column:
    """Character references decoded as browsers do, by the whole table of HTML5; texts without an ampersand cost one search."""

    def decoded(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        plain = F.transform(found, lambda r: F.when(F.startswith(r, F.lit("&#")), _numbered(r)).otherwise(_named(r)))
        between = F.split(t, REFERENCE, -1)
        return F.array_join(F.transform(F.arrays_zip(between.alias("before"), F.concat(plain, F.array(F.lit(""))).alias("letter")), lambda x: F.concat(x["before"], x["letter"])), "")

    return F.when(F.contains(text(c), F.lit("&")), _let(text(c), decoded)).otherwise(text(c))


def clean_text(c: Column | str) -> Column:
    """Entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(c), SPACE, " "))


def clean_title(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(unescaped(c), "(?U)&\\w+;", ""), "(?U)^\\s+|\\s+$", "")


def summary(c: Column | str, most: int = 200) -> Column:
    """Markup and entities out, white space collapsed; cut at the last full stop that leaves half of ``most``."""
    whole = F.trim(F.regexp_replace(F.regexp_replace(unescaped(F.regexp_replace(text(c), "<[^>]+>", "")), "(?U)&\\w+;", ""), SPACE, " "))
    cut = F.substring(whole, 1, most)
    stop = F.regexp_extract(cut, "^([\\s\\S]*)。", 1)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.when(F.length(stop) >= most // 2, stop).otherwise(cut), F.lit("...")))


def compact(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(text(c), SPACE, ""))


def signature(c: Column | str) -> Column:
    """SHA-256 of the compact text; empty for empty."""
    return F.when(text(c) == "", "").otherwise(F.sha2(compact(c).cast("binary"), 256))


def identity(title: Column | str) -> Column:
    """Title without announcement words and anything but digits, a-z and Chinese characters."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(title)), "|".join(ANNOUNCEMENT_WORDS), ""), "[^0-9a-z\u4e00-\u9fff]+", "")


def project_key(title: Column | str, owner: Column | str, city: Column | str) -> Column:
    raw = F.concat_ws("|", text(title), text(owner), text(city))
    return F.substring(F.sha1(identity(raw).cast("binary")), 1, 20)


def material_hash(stage: Column, budget: Column, deadline: Column, scope: Column, version: Column) -> Column:
    """Fingerprint of what makes a project worth reporting again."""
    parts = F.to_json(F.struct(budget.alias("budget"), deadline.alias("deadline"), version.alias("notice_version"), stage.alias("stage"), F.array_sort(F.array_distinct(scope)).alias("technical_scope")))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 24)


def has(c: Column, word: str) -> Column:
    """ASCII words need no letter beside them, others match anywhere. ``c`` is lower case."""
    if word.isascii():
        return c.rlike("(^|[^a-z])" + re.escape(word) + "([^a-z]|$)")
    return F.contains(c, F.lit(word))


#: Lists up to this length become a chain of comparisons; longer ones an array that is walked, which keeps plans small.
CHAIN = 6


def _let(c: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _found(c: Column, words: Iterable[str]) -> Column:
    """array<string> of the words that ``c`` contains, in list order."""
    every = F.array(*map(F.lit, words))
    return _let(c, lambda t: F.filter(every, lambda w: F.contains(t, w)))


def any_of(c: Column, words: Iterable[str], bounded: bool = False) -> Column:
    words = tuple(dict.fromkeys(words))
    if bounded:
        ascii_words = [re.escape(w) for w in words if w.isascii()]
        rest = any_of(c, [w for w in words if not w.isascii()])
        return rest | c.rlike(f"(^|[^a-z])({'|'.join(ascii_words)})([^a-z]|$)") if ascii_words else rest
    if len(words) > CHAIN:
        every = F.array(*map(F.lit, words))
        return _let(c, lambda t: F.exists(every, lambda w: F.contains(t, w)))
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def count_of(c: Column, words: Iterable[str], bounded: bool = False) -> Column:
    """How many distinct words occur."""
    words = tuple(dict.fromkeys(words))
    alone = [w for w in words if bounded and w.isascii()]
    rest = [w for w in words if w not in alone]
    total = F.size(_found(c, rest)) if len(rest) > CHAIN else reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in rest], F.lit(0))
    return reduce(lambda a, b: a + b, [has(c, w).cast("int") for w in alone], total)


def matches(c: Column, words: Iterable[str]) -> Column:
    """The words that occur, in list order."""
    return _found(c, tuple(words))


def first_of(c: Column, words: Iterable[str]) -> Column:
    return F.coalesce(F.get(_found(c, tuple(words)), F.lit(0)), F.lit(""))


def unnegated(c: Column, words: Iterable[str]) -> Column:
    """The words with an occurrence that no negation precedes within 12 characters."""

    def pattern(w: str) -> str:  # the word is found first, then what stands before it is looked at
        before = "|".join(f"{n}\\s{{0,{12 - len(n)}}}" for n in NEGATIONS)
        return f"(?U){re.escape(w)}(?<!(?:{before}){re.escape(w)})"

    every = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(pattern(w)).alias("p")) for w in words])
    return _let(c, lambda t: F.transform(F.filter(F.filter(every, lambda e: F.contains(t, e["w"])), lambda e: F.rlike(t, e["p"])), lambda e: e["w"]))


def plain(c: Column | str, most: int) -> Column:
    """One line without markdown characters, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text(c), "[\\r\\n]+", " "), "[`*_#>\\[\\]]", ""))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def marked(c: Column | str, most: int) -> Column:
    """One line without markdown characters, ``most`` characters and an ellipsis if there were more."""
    flat = F.regexp_replace(F.regexp_replace(text(c), "[\\r\\n]+", " "), "[\\\\`*_\\[\\]()<>#]", "")
    return F.concat(F.substring(flat, 1, most), F.when(F.length(flat) > most, "…").otherwise(""))


def notice_version(title: Column | str, published: Column | str, url: Column) -> Column:
    """What tells a re-tender or clarification from the notice before it; empty for first notices. ``url`` is the address to fetch."""
    told = any_of(text(title), NOTICE_TERMS)
    return F.when(told, F.substring(signature(F.concat_ws("|", text(title), text(published), text(url))), 1, 24)).otherwise("")


def redacted(c: Column | str) -> Column:
    """Values of key-like query parameters masked."""
    return F.regexp_replace(text(c), "(?i)\\b(api[_-]?key|key|access_token|token|secret|sign)=([^&\\s\"']+)", "$1=***")
