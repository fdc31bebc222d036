"""History titles are looked up by two characters that like ones share: the same best match as the plain loop, and no comparison with all where characters are many."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from granary.operators import research as R

LETTERS = ["abcd", "abcdefgh仓储", "".join(chr(0x4E00 + i) for i in range(300)), "".join(chr(0x20000 + i) for i in range(3000))]
SIZES = [[1, 2, 3, 4], [8, 9, 12, 16], [1, 5, 14, 30], [30, 70]]


def _rows(rng, letters, sizes):
    title = lambda: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
    when = lambda: rng.choice([0.0, 1e6 + rng.randint(0, 9) * 43_200.0])
    posts = [(i, title(), when(), f"u{i}") for i in range(rng.choice([3, 100]))]
    part = lambda t: "".join(c for c in t if rng.random() > rng.choice([0.1, 0.4, 0.6])) or "x"
    some = lambda: rng.choice(posts)[1]
    targets = [(i, rng.choice([title(), part(some()), "".join(rng.sample(x := some(), len(x))), part(some()) + title()]), when()) for i in range(60)]
    return targets, posts


@pytest.mark.parametrize("seed", range(16))
def test_lookup_finds_what_the_plain_loop_finds(seed, monkeypatch):
    rng = random.Random(seed)
    targets, posts = _rows(rng, LETTERS[seed % 4], SIZES[seed // 4])
    least, want = rng.choice([0.62, 0.62, 0.9, 0.1]), []
    for o, t, ts in targets:
        best, found = 0.0, ()
        for at, h, hts, u in posts:
            gap = abs(ts - hts) if ts > 0 and hts > 0 else 1e9
            score = SequenceMatcher(None, t, h).ratio()
            score += 0.2 if gap <= 86400 else 0.1 if gap <= 3 * 86400 else 0.0
            if score > best:
                best, found = score, (o, score, at, u)
        want += [found] * (best >= least)
    monkeypatch.setattr(R, "PAIRS", rng.choice([1 << 5, 1 << 8, 1 << 22]))
    got = R._closest(pd.DataFrame(targets, columns=["_ord", "t", "ts"]), pd.DataFrame(rng.sample(posts, len(posts)), columns=["position", "h", "hts", "url"]), least)
    assert sorted(got) == sorted(want)


def test_titles_of_many_characters_are_not_compared_with_all(monkeypatch):
    rng = random.Random(5)
    titles = ["".join(rng.choice(LETTERS[3]) for _ in range(12)) for _ in range(3000)]
    monkeypatch.setattr(R._Letters, "shared", lambda *_: pytest.fail("compared with all"))
    posts = pd.DataFrame({"position": np.arange(3000), "h": [t + "七八" for t in titles], "hts": 1e6, "url": titles})
    got = list(R._closest(pd.DataFrame({"_ord": np.arange(3000), "t": [t + "一二三" for t in titles], "ts": 1e6}), posts, 0.62))
    assert [(o, u) for o, _, _, u in got] == list(enumerate(titles))
