"""Held-out accuracy, located sentences, and rows that cannot be learned from."""

from __future__ import annotations

import random

import numpy as np
import pytest

from granary.llm import toxicity as X

BAD = ["grobian", "lump", "scheusal"]


def sentence(rng, bad=False):
    words = [f"w{rng.randint(0, 300)}x" for _ in range(rng.randint(4, 12))]
    if bad:
        words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "e", "en", "ish"])
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    rows = []
    for i in range(900):
        toxic, n = i % 7 == 0, rng.randint(2, 30)
        where = rng.randrange(n) if toxic else -1
        rows.append((i, " ".join(sentence(rng, k == where) for k in range(n)), int(toxic), where))
    return rows


@pytest.fixture(scope="module")
def model(spark, made):
    df = spark.createDataFrame([r[:3] for r in made if r[0] % 3 != 1], "doc_id long, text string, toxic int")
    return X.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_held_out(spark, made, model):
    got = {r.doc_id: r for r in X.scored(spark.createDataFrame([r[:2] for r in made], "doc_id long, text string"), model).collect()}
    held = [r for r in made if r[0] % 3 == 1]
    assert np.mean([(got[r[0]].score >= 0.7) == r[2] for r in held]) >= 0.97
    found = [got[r[0]].worst_sentence == r[3] for r in held if r[2]]
    assert np.mean(found) >= 0.9


def test_sentences_are_located(spark, made, model):
    bad = [r for r in made if r[2]]
    rows = X.offending_sentences(spark.createDataFrame([r[:2] for r in bad], "doc_id long, text string"), model, 0.5).collect()
    right = {(r[0], r[3]) for r in bad}
    assert len({(r.doc_id, r.number) for r in rows} & right) >= 0.9 * len(right)
    assert all(any(b in r.sentence for b in BAD) for r in rows if (r.doc_id, r.number) in right)


def test_awkward_rows(spark, model, docs, corpus, nothing):
    rows = {r.doc_id: r.score for r in X.scored(docs, model).collect()}
    assert len(rows) == len(corpus) and rows[300] == rows[301] == rows[302] == min(rows.values())
    assert all(0 <= s <= 1 for s in rows.values())
    assert X.scored(nothing, model).count() == 0


@pytest.mark.parametrize("labels", [[], [(0, 1), (3, 1)], [(0, 0), (3, None), (None, 1)]])
def test_one_kind_of_label_or_none(spark, docs, labels):
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {round(r.score, 6) for r in X.scored(docs, model).collect()}
    assert len(scores) == 1 and (scores.pop() > 0.99) == bool(labels and labels[0][1])


def test_training_reads_whole_texts(spark):
    """Every toxic sentence lies past 3,000 words of its document."""
    rng = random.Random(12)
    rows = []
    for i in range(240):
        text = [sentence(rng) for _ in range(520)]
        rows.append((i, " ".join([*text, sentence(rng, True)] if i % 3 == 0 else text), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {f for b in BAD for f in X.features(b)[1:2]} & set(model.weights)
    got = {r.doc_id: r for r in X.scored(df, model).collect()}
    assert np.mean([got[i].worst_sentence == 520 for i, _, y in rows if y]) >= 0.9
