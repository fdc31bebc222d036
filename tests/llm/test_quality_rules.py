"""Counts against plain Python and SQL; verdicts on junk and clean groups."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from granary.llm import quality_rules as Q
from granary.llm.common import shared_folder

def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))

SPACE = "[\x20\x09-\x0d]+"


def plain(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(inside)


def texts():
    rng = random.Random(8)
    out = [None, "", " ", "a", "a b c d e", "a b c d e a b c d e", "x " * 300, "\n".join(["same line"] * 4 + ["", " \t", "same line "]), "😀 ## $%&|<>*", "a b c", prose(rng, 20_000, 9)]
    return out + ["\n".join(prose(rng, rng.randint(0, 12), 3) for _ in range(rng.randint(0, 9))) for _ in range(60)]


def test_counts(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.with_counts(df).collect()}
    for i, t in enumerate(rows):
        assert got[i] == plain(t), repr((t or "")[:80])


def test_base_sql_says_the_same(spark):
    rows = [t for t in texts() if t is None or len(t) < 5000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    ours = {r.doc_id: (*[r[c] for c in Q.COUNTS], r.f) for r in Q.with_counts(df).withColumn("f", Q.base_failed()).collect()}
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": range(len(rows)), "text": pa.array(rows, pa.string())}))
    found = c.execute(Q.BASE_SQL)
    head = [d[0] for d in found.description]
    for r in found.fetchall():
        r = dict(zip(head, r))
        if r["doc_id"] in ours and rows[r["doc_id"]] is not None:
            assert ours[r["doc_id"]] == tuple(r[x] for x in [*Q.COUNTS, "base_failed"])


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        text = prose(rng, rng.randint(30, 90), 5000)
        if i % 9 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, ["en", None][i % 2], ["hot", "hot", "s", None][i % 4]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.filtered(df, shared_folder(spark)).collect()}
    assert kept == {i for i in range(900) if i % 9}


def test_awkward_rows(spark, docs, corpus, nothing):
    rows = Q.judged(docs, shared_folder(spark)).collect()
    assert len(rows) == len(corpus) and not any(r.kept for r in rows if r.doc_id in (300, 301, 302))
    assert Q.judged(nothing, shared_folder(spark)).count() == 0
    assert Q.filtered(docs, shared_folder(spark)).columns == docs.columns


def test_sketches_decide(spark):
    """Symbols at a third of the letters are ordinary in one source; a twelfth is junk in another."""
    rng = random.Random(10)
    rows, junk = [], set()
    for i in range(1250):
        words = prose(rng, rng.randint(30, 90), 5000).split()
        if i % 5 == 0:
            words = [w + "#" * rng.randint(1, 2) for w in words]
        elif i % 25 == 1:
            junk.add(i)
            words = [w + "##" if k % 5 == 0 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en", "code" if i % 5 == 0 else "plain"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Q.judged(df, shared_folder(spark)).where("not kept").collect()
    assert {r.doc_id for r in got} == junk and all("symbol_rate" in r.reasons for r in got)


def test_verdicts_follow_exact_quantiles(spark):
    """Thresholds from sketches lie between those that exact quantiles a few ranks off would give."""
    rng = random.Random(17)
    rows = []
    for i in range(2400):
        lang, source = ("en", "fr")[i % 2], f"s{i % 6}" if i % 50 else "rare"
        words = [("w" if i % 6 else "longerword") + str(rng.randint(0, 900)) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([0] * 12 + [1, 2, 5, 20, 60])):
            words[rng.randrange(len(words))] += "#"
        rows.append((i, " ".join(words).upper() if rng.random() < 0.02 else " ".join(words), lang, source))
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shared_folder(spark)).collect()}

    def rates(r):
        log = lambda a, b: np.log((a + 1) / (b + 1))
        return {"symbol_rate": log(r.n_symbols, r.word_chars), "dup_line_rate": log(r.n_dup_lines, r.n_words), "upper_rate": log(r.n_upper, r.word_chars), "mean_word": log(r.word_chars, r.n_words)}

    values = {i: rates(r) for i, r in got.items()}
    off, decided = 0.03, 0

    def spread(ids, m):
        """(lowest, highest) fence and middle that ranks ``off`` the true ones allow."""
        x = np.sort([values[i][m] for i in ids])
        q = lambda p: x[int(np.clip(round(p * (len(x) - 1)), 0, len(x) - 1))]
        low, high = q(0.75 - off) + Q.FENCE * (q(0.75 - off) - q(0.25 + off)), q(0.75 + off) + Q.FENCE * (q(0.75 + off) - q(0.25 - off))
        return len(x), np.array([low, high]), np.array([q(0.5 - off), q(0.5 + off)])

    for lang, source in {r[2:] for r in rows}:
        mine = [i for i, _, *key in rows if key == [lang, source]]
        every, ours = [i for i, *_ in rows], [i for i, _, x, _ in rows if x == lang]
        limits = {}
        for m in Q.MEASURES:
            (_, af, am), (ln, lf, lm), (gn, gf, gm) = (spread(ids, m) for ids in (every, ours, mine))
            drawn = lambda n, own, toward: (n**2 * own + Q.PRIOR**2 * toward) / (n**2 + Q.PRIOR**2)
            wide, middle = drawn(ln, lf, af), drawn(ln, lm, am)
            own, own_middle = drawn(gn, gf, wide), drawn(gn, gm, middle)
            moved = np.maximum(own_middle - middle[::-1], 0)
            limits[m] = np.minimum(own, wide + moved)
        for i in mine:
            if got[i].base_failed:
                assert not got[i].kept
            elif all(values[i][m] < limits[m][0] for m in Q.MEASURES):
                assert got[i].kept
                decided += 1
            elif any(values[i][m] > limits[m][1] for m in Q.MEASURES):
                assert not got[i].kept and got[i].reasons
                decided += 1
    assert decided > 2300 and sum(not r.kept for r in got.values()) > 50
