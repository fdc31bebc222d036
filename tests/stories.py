"""A run of articles in which stories lie in several sources under different addresses."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

NOW = 1709251200.0
SCHEMA = "_ord long, title string, summary string, url string, source_name string, source_kind string, source_group string, skill_name string, region_scope string, published_ts double, content string, image_url string"


def rows(n=150, seed=3):
    rng = random.Random(seed)
    stories = ["from " + " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(2, 6))) + " with robots" for _ in range(n // 2)]
    out = []
    for i in range(n):
        title = rng.choice(stories)
        if rng.random() < 0.4:
            at = rng.randrange(5, len(title) - 12)
            title = title[:at] + rng.choice("xyz7") + title[at + 1 :]
        source = f"src{rng.randint(0, 9)}"
        ts = 0.0 if i % 17 == 0 else NOW - rng.randint(0, 12) * 86400.0
        out.append((i, title, "x" * rng.randint(0, 90), f"https://www.{source}.example.com/a/{i}", source, rng.choice(["official", "vendor", "aggregator", ""]), "", source, "", ts, title, ""))
    return out


def plain(title):
    return re.sub(r"[\W_]+", "", title.lower())


def leaders(found):
    """All pairs, as the reference does it; titles here hold no events, versions or identifiers."""
    order = sorted(found, key=lambda r: (r.source_kind not in ("official", "vendor", "organizer"), r.source_domain == "toutiao.com", not r.published_ts, -r.quality_score, r._ord))
    kept = []
    for r in order:
        t = plain(r.title)
        if not any(r.url == k.url or (len(t) >= 14 and re.findall(r"\d+", t) == re.findall(r"\d+", plain(k.title)) and SequenceMatcher(None, t, plain(k.title)).ratio() >= 0.90) for k in kept):
            kept.append(r)
    return kept
