"""Small corpora with the awkward cases: nulls, empty and very long texts, ties, copies, other columns."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, blob int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with near and exact copies, shared passages, nulls, blanks and one very long text."""
    rng = random.Random(5)
    rows = []
    for i in range(0, 120, 3):
        text = prose(rng, rng.randint(1, 120))
        rows.append((i, text))
        words = text.split()
        if len(words) > 4:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i + 1, " ".join(words)))
        rows.append((i + 2, text if i % 2 else prose(rng, 30) + "\nLicensed under the shared license of everyone, all of it.\n"))
    base = prose(rng, 150, 100_000).split()
    for i in range(200, 260):  # many near copies, most of them a word or two apart
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "Einzig"), (304, "einzig"), (305, "ÄÖ ä x  two  spaces\n\n end"), (306, prose(rng, 20_000)), (307, rows[-1][1]), (308, "a b"), (309, "A B")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "clash", 1) for i, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
