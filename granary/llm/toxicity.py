"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A document is a bag of sentences. A word's features are itself and its first four, five and six letters, so
that inflected forms share what they have in common. Features that are not told apart from chance by document
labels (``LEAST_Z``) are left out. A sentence with any feature left scores the logistic of a bias plus the weights
of its distinct words, others score 0; the document is toxic if any sentence is: 1 - prod(1 - score). The
document's log-loss is minimised by gradient steps that flow through the noisy-or to each sentence, so weights
settle on the words that set toxic sentences apart. Only document labels are seen, and afterwards the
sentences that raise a score are named (``offending_sentences``).

Training takes at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` other labelled documents, the first by a
hash of their ids: a bound of the fit only. Their texts are read whole, twice: once to count features in Spark, once for
the instances that hold a telling one, which alone reach the driver. Scoring covers all rows and whole texts. The score is calibrated on the training bags by a logistic of the log-odds, with the sampling
weighed back.

Nulls: a null or empty text has no sentence with a feature and gets the lowest score there is; a null
label does not train. Without both kinds of labels every score is the share of toxic labels, or near 0 without
labels. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

BUCKETS = 1 << 20
TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 4_000
#: Features kept at most, standard deviations from chance and documents that each needs.
FEATURES, LEAST_Z, LEAST_DOCS = 4_000, 5.0, 5
EPOCHS, RATE, DECAY = 150, 0.1, 1e-5
#: Log-odds are held within this.
ODDS = 12.0
#: Sentences end at these, and after SENTENCE_WORDS words at the latest.
SENTENCE_WORDS = 60
_END = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_WORD = re.compile(r"\w+")
_KEEP = 200_000


def sentences(text: str | None) -> list[str]:
    return [s for s in _END.split(text or "") if s] or [""]


def instances(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """Sentence numbers and their distinct words; long sentences come in parts."""
    for n, s in enumerate(sentences(text)):
        found = _WORD.findall(s.lower())
        for i in range(0, max(1, len(found)), SENTENCE_WORDS):
            yield n, list(dict.fromkeys(found[i : i + SENTENCE_WORDS]))


def features(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS for x in (word, *(f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) >= n))]


class _Features(dict):
    def __missing__(self, word: str) -> list[int]:
        value = features(word)
        if len(self) < _KEEP:
            self[word] = value
        return value


def bag(text: str | None, known: dict[str, list[int]], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's words, those in ``used`` if given, and the number of the instance each lies in."""
    ids, owner = [], []
    for n, (_, found) in enumerate(instances(text)):
        for word in found:
            ids += known[word]
        owner += [n] * (len(ids) - len(owner))
    ids, owner = np.array(ids, "<i4"), np.array(owner, "<i4")
    if used is None:
        return ids, owner
    kept = np.isin(ids, used)
    return ids[kept], owner[kept]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    slope: float
    offset: float

    def of_odds(self, odds: float) -> float:
        return float(_logistic(np.array(self.offset + self.slope * np.clip(odds, -ODDS, ODDS))))


class Scorer:
    """A model with a bounded memory of words' weights."""

    def __init__(self, model: Model):
        self.model, self._words = model, {}

    def weight(self, word: str) -> float | None:
        """Sum of the weights of a word's features; None if the model has none of them."""
        if word in self._words:
            return self._words[word]
        found = [self.model.weights[f] for f in features(word) if f in self.model.weights]
        value = sum(found) if found else None
        if len(self._words) < _KEEP:
            self._words[word] = value
        return value

    def sentence_scores(self, text: str | None) -> list[tuple[int, float]]:
        """Number and score of each sentence with any of the model's features."""
        lowered = (text or "").lower()
        if not any(self.weight(w) is not None for w in set(_WORD.findall(lowered))):
            return []
        out: dict[int, float] = {}
        for n, words in instances(text):
            found = [x for w in words if (x := self.weight(w)) is not None]
            if found:
                out[n] = max(out.get(n, 0.0), float(_logistic(np.array(self.model.bias + sum(found)))))
        return list(out.items())

    def score(self, each: list[tuple[int, float]]) -> float:
        return self.model.of_odds(_bag_odds(np.array([p for _, p in each])))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(none: np.ndarray) -> np.ndarray:
    """Log-odds of the noisy-or, from the log of the chance of no toxic sentence."""
    none = np.minimum(none, -1e-6)
    return np.clip(np.log(-np.expm1(none)) - none, -ODDS, ODDS)


def _bag_odds(p: np.ndarray) -> float:
    return float(_odds(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def telling(counted: DataFrame, n: int, share: float) -> np.ndarray:
    """Features (feature, docs, toxic) whose share of toxic documents is furthest from chance, of ``n`` documents."""
    docs = F.col("docs")
    z = F.abs((F.col("toxic") - docs * share) / F.sqrt(docs * (share * (1 - share)) + 1))
    found = counted.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (docs >= LEAST_DOCS))
    return np.sort(np.array([r["feature"] for r in found.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()], np.int64))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, toxic_share: float, used: np.ndarray) -> Model:
    """Gradient descent with per-weight step sizes on the noisy-or log-loss."""
    if not len(labels) or labels.min() == labels.max():
        share = np.clip(toxic_share, 1e-9, 1 - 1e-9) if len(labels) else 1e-9
        return Model({}, 0.0, 0.0, float(np.log(share / (1 - share))))
    word = np.searchsorted(used, np.concatenate([ids for ids, _ in bags]))
    place = np.concatenate([(d << 32) + owner for d, (_, owner) in enumerate(bags)])
    places, sent = np.unique(place, return_inverse=True)  # sentences that hold a feature
    doc = places >> 32
    y = labels.astype(float)
    weigh = np.where(y == 1, toxic_share / max(y.mean(), 1e-9), (1 - toxic_share) / max(1 - y.mean(), 1e-9))
    w, b, m, v, mb, vb = np.zeros(len(used)), -4.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        p = _logistic(b + np.bincount(sent, w[word], len(doc)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags))
        q = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - q) / q for a toxic one
        grad = weigh[doc] * np.where(y[doc] == 1, -p * (1 - q[doc]) / q[doc], p)
        gw, gb = np.bincount(word, grad[sent], len(used)) / len(bags) + DECAY * w, grad.sum() / len(bags)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-6)
        b -= RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-6)
    p = _logistic(b + np.bincount(sent, w[word], len(doc)))
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
    slope, offset = calibrated(_odds(none), y, weigh)
    return Model(dict(zip(used.tolist(), w.tolist())), float(b), slope, offset)


def calibrated(odds: np.ndarray, y: np.ndarray, weigh: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic of log-odds, by Newton's method with a little shrinkage."""
    x = np.stack([odds, np.ones(len(odds))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _logistic(x @ beta)
        g = x.T @ (weigh * (p - y)) + 1e-3 * (beta - [1, 0])
        h = (x * (weigh * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model:
    """Fit on bounded samples of ``labels`` (doc_id, toxic), which the caller has restricted to training rows."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).union(known.where("toxic = 0").orderBy(*order).limit(clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Features(), np.zeros((2, BUCKETS), np.int32)
        for part in slices(batches):
            for text, y in zip(part[1].to_pylist(), part[2].to_pylist()):
                distinct = np.unique(bag(text, known)[0])
                total[0, distinct] += 1
                total[1, distinct] += y
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(x[at], pa.int64()) for x in total)], ["feature", "docs", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    counted = texts.mapInArrow(count, "feature long, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    used = telling(counted, n, sizes.get(1, 0) / n) if len(sizes) == 2 else np.zeros(0, np.int64)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for part in slices(batches):
            found = [bag(t, known, used) for t in part[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[0], part[2], *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], ["doc_id", "toxic", "words", "owner"])

    rows = texts.mapInArrow(bags, "doc_id long, toxic int, words binary, owner binary").orderBy("doc_id").toArrow().to_pylist()
    held = [(np.frombuffer(r["words"], "<i4"), np.frombuffer(r["owner"], "<i4").astype(np.int64)) for r in rows]
    total = sum(counts.values())
    return fit(held, np.array([r["toxic"] for r in rows]), counts.get(1, 0) / total if total else 0.0, used)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, with the worst sentence's number and score (null without any)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            out = []
            for text in part[1].to_pylist():
                each = scorer.sentence_scores(text)
                out.append((scorer.score(each), *max(each, key=lambda x: x[1], default=(None, None))))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([part[0], pa.array(a, pa.float64()), pa.array(b, pa.int32()), pa.array(c, pa.float64())], ["doc_id", "score", "worst_sentence", "worst_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, worst_sentence int, worst_score double")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Sentences whose own score reaches ``least``: doc_id, number, sentence, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            out = []
            for doc_id, text in zip(part[0].to_pylist(), part[1].to_pylist()):
                found = sentences(text)
                out += [(doc_id, n, found[n], p) for n, p in scorer.sentence_scores(text) if p >= least]
            a, b, c, d = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.float64())], ["doc_id", "number", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(locate, "doc_id long, number int, sentence string, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst_sentence", "worst_score")
