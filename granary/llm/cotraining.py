"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees shares of word shapes (case, digits, marks), how many words and lines of the text are distinct, and
word lengths; the metadata view sees source, language, size and line layout. Each view has its own logistic
classifier. In each of ``ROUNDS`` rounds a view scores every unlabelled document and gives the most confident ones, a
``SHARE`` of all (``GIVEN`` at least) in the classes' labelled proportion, with pseudo-labels to the other view,
never to itself. Afterwards each view's log-odds are calibrated on labelled documents that no round trained on, a
logistic of both is fitted there, and its output scores every document.

Views are computed once, from whole texts, and stored as sparse rows. A round is a rule (a view's weights and the
odds from which it is confident), so rows keep no state. Confidence is counted in bins of 0.01 of log-odds, and
rows of one bin are given together. All given rows enter the fit, however many: they are written with their labels, and each step of the
fit is a pass over them that gives sums of losses and gradients, one number a feature. Both views step together, from the
weights of the round before, by limited-memory quasi-Newton steps. Given rows weigh ``PSEUDO`` times the labelled rows in all, whatever the
size of the corpus. Only the labelled rows are a sample: at most ``LABELLED``, the first by a hash of their ids. Scoring covers all rows and
whole texts.

Nulls: a null text is an empty text; null language and source are values of their own; null labels do not train.
Without both kinds of labels every score is the share of good labels, or 1 without labels. Repeated rows score
alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table
from .tokens import slices
from .toxicity import calibrated

LABELLED = 6_000
ROUNDS, GIVEN, SHARE = 4, 400, 1 / 15
#: Weight of all given rows beside all labelled ones; passes over the given rows in a round; steps that a fit remembers.
PSEUDO, PASSES, MEMORY = 1.5, 12, 6
#: Log-odds are held within BOUND and counted in bins; the outer ones are confident (chance below 0.1 or above 0.9).
BOUND, BIN = 30, 0.01
BINS = round(2 * BOUND / BIN) + 1
_LOW, _HIGH = int((BOUND - np.log(9)) / BIN) - 1, int((BOUND + np.log(9)) / BIN) + 1
#: Width of the views; the content view's last places hold measures, the others shape shares.
CONTENT, MEASURED, METADATA = 512, 16, 256
_RUN = re.compile(r"(.)\1+")
_KEEP = 200_000
_INPUT = ["doc_id", "text", "lang", "source"]


def shape(word: str) -> str:
    """Case, digit and mark pattern of a word, with runs shortened."""
    marks = "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "o" if c.isalpha() else c for c in word[:40])
    return _RUN.sub(r"\1\1", marks)


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(shape(word).encode()) % (CONTENT - MEASURED)
        if len(self) < _KEEP:
            self[word] = value
        return value


def content_view(text: str, shapes: dict[str, int]) -> np.ndarray:
    words = text.split()
    n = len(words)
    out = np.zeros(CONTENT, np.float32)
    if n:
        out[: CONTENT - MEASURED] = np.sqrt(np.bincount(np.fromiter(map(shapes.__getitem__, words), np.int64, n), minlength=CONTENT - MEASURED) / n)
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words)) / n if n else 1.0
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    mean = (len(text) - text.count(" ") - text.count("\n")) / n if n else 0.0
    measures = [1.0, distinct, pairs, pairs < 0.5, pairs < 0.8, len(set(lines)) / len(lines) if lines else 1.0, min(mean / 10, 3), n < 10, n < 30]
    out[CONTENT - MEASURED : CONTENT - MEASURED + len(measures)] = measures
    return out


def metadata_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(METADATA, np.float32)
    lines = text.count("\n") + 1
    for x in (f"lang {lang}", f"source {source}", f"size {len(text).bit_length()}", f"lines {lines.bit_length()}", f"width {(len(text) // lines).bit_length()}"):
        out[1 + xxhash.xxh3_64_intdigest(x.encode()) % (METADATA - 1)] = 1
    out[0] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights of a shrunken logistic regression, by accelerated gradient descent."""
    scale = np.sqrt((x**2).mean(0)) + 1e-2
    z = (x / scale).astype(np.float32)
    rate = 4.0 / (np.linalg.norm(z, axis=1) ** 2).mean()
    w, ahead = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - rate * (z.T @ (weight * (p - y)) + shrink * ahead)
        ahead = new + (k - 1) / (k + 2) * (new - w)
        w = new
    return (w / scale).astype(np.float64)


@dataclass
class Model:
    """``content`` and ``metadata`` weights, their calibrations (slope, offset), and the weights of both odds."""

    content: np.ndarray
    metadata: np.ndarray
    calibrations: tuple[tuple[float, float], tuple[float, float]]
    both: np.ndarray

    def odds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of a good document, by content, by metadata, and combined."""
        (s0, o0), (s1, o1) = self.calibrations
        x = np.clip(a @ self.content, -30, 30) * s0 + o0
        y = np.clip(b @ self.metadata, -30, 30) * s1 + o1
        return x, y, self.both[0] * x + self.both[1] * y + self.both[2]


@dataclass
class Rule:
    """What a view teaches the other in a round: 0 up to the bin ``low``, 1 from ``high`` on."""

    view: int
    weights: np.ndarray
    low: int
    high: int


def _bins(odds: np.ndarray) -> np.ndarray:
    return ((np.clip(odds, -BOUND, BOUND) + BOUND) / BIN).astype(np.int64)


def taught(odds, n: int, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Both views' pseudo-labels (-1: none) of ``n`` rows; ``odds(view, weights)`` gives log-odds. Earlier rules come first."""
    out = np.full(n, -1), np.full(n, -1)
    for rule in rules:
        to, at = out[1 - rule.view], _bins(odds(rule.view, rule.weights))
        free = to < 0
        to[free & (at <= rule.low)], to[free & (at >= rule.high)] = 0, 1
    return out


def confidence(odds, n: int, rules: list[Rule], weights: list[np.ndarray]) -> np.ndarray:  # noqa: ANN001
    """(view, bin): how many rows that a view has not yet taught the other fall into a bin."""
    labels = taught(odds, n, rules)
    return np.stack([np.bincount(_bins(odds(v, weights[v]))[labels[1 - v] < 0], minlength=BINS) for v in (0, 1)])


def _pass(odds, back, labels: list[np.ndarray], weights: list[np.ndarray] | None) -> np.ndarray:  # noqa: ANN001
    """Sums over rows that have a label, view after view: their number, then losses and gradients, or squares of the features.

    ``odds(view, weights)`` gives log-odds, ``back(view, c, square)`` the sums of the rows' features, or of their squares, times ``c``.
    """
    out = []
    for v in (0, 1):
        given = labels[v] >= 0
        if weights is None:
            out += [[given.sum(), 0.0], back(v, given.astype(float), True)]
            continue
        x, y = odds(v, weights[v]), np.maximum(labels[v], 0)
        out += [[given.sum(), np.logaddexp(0, np.where(y > 0, -x, x))[given].sum()], back(v, np.where(given, 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y, 0.0), False)]
    return np.concatenate(out)


def _parted(sums: np.ndarray, sizes: list[int]) -> list[tuple[float, float, np.ndarray]]:
    """(number, loss, features) of each view."""
    out, at = [], 0
    for n in sizes:
        out.append((float(sums[at]), float(sums[at + 1]), sums[at + 2 : at + 2 + n]))
        at += 2 + n
    return out


class _Held:
    """Unlabelled rows held in memory."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.views = a, b

    def _odds(self, view: int, weights: np.ndarray) -> np.ndarray:
        return self.views[view] @ weights

    def _back(self, view: int, c: np.ndarray, square: bool) -> np.ndarray:
        return c @ (self.views[view].astype(np.float64) ** (2 if square else 1))

    def confidence(self, rules: list[Rule], weights: list[np.ndarray]) -> np.ndarray:
        return confidence(self._odds, len(self.views[0]), rules, weights)

    def teach(self, rules: list[Rule]):  # noqa: ANN201
        """A function of both views' weights that gives the sums over all rows that the rules have labelled."""
        labels = taught(self._odds, len(self.views[0]), rules)
        return lambda weights=None: _pass(self._odds, self._back, list(labels), weights)


class _Stored:
    """Unlabelled rows in a table of sparse views (doc_id, at, value)."""

    def __init__(self, rows: DataFrame, folder: str = ""):
        self.rows, self.folder, self.rounds = rows, folder, 0

    def confidence(self, rules: list[Rule], weights: list[np.ndarray]) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, BINS), np.int64)
            for part in batches:
                total += confidence(_sparse_odds(part), part.num_rows, rules, weights)
            view, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(at, pa.int32()), pa.array(total[view, at], pa.int64())], ["view", "bin", "n"])

        found = self.rows.mapInArrow(count, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((2, BINS), np.int64)
        out[found["view"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
        return out

    def teach(self, rules: list[Rule]):  # noqa: ANN201
        """``_Held.teach`` over a table: the labelled rows are written once, each call is a pass over them."""

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                y = taught(_sparse_odds(part), part.num_rows, rules)
                out = pa.RecordBatch.from_arrays([part["at"], part["value"], *(pa.array(x.astype(np.int32)) for x in y)], ["at", "value", "y0", "y1"])
                yield out.filter(pa.array((y[0] >= 0) | (y[1] >= 0)))

        self.rounds += 1
        given = stored(self.rows.mapInArrow(label, "at array<int>, value array<float>, y0 int, y1 int"), self.folder or shared_folder(self.rows.sparkSession), f"given-{self.rounds}")

        def sums(weights: list[np.ndarray] | None = None) -> np.ndarray:
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(4 + CONTENT + METADATA)
                for part in batches:
                    total += _pass(_sparse_odds(part), _sparse_back(part), [part[c].to_numpy() for c in ("y0", "y1")], weights)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

            found = given.mapInArrow(add, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
            out = np.zeros(4 + CONTENT + METADATA)
            out[found["i"].to_numpy()] = found["x"].to_numpy()
            return out

        return sums


def _sparse_back(part: pa.RecordBatch):  # noqa: ANN202
    at, value = part["at"].flatten().to_numpy(), part["value"].flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(part.num_rows), part["at"].value_lengths().to_numpy())

    def back(view: int, c: np.ndarray, square: bool) -> np.ndarray:
        whole = np.bincount(at, c[row] * (value**2 if square else value), CONTENT + METADATA)
        return whole[:CONTENT] if view == 0 else whole[CONTENT:]

    return back


class _Descent:
    """Limited-memory quasi-Newton steps toward a minimum: ``at`` is where to look next, ``tell`` takes what was found there."""

    def __init__(self, start: np.ndarray, curvature: float):
        self.at = self.best = start
        self.loss, self.slope, self.step, self.size = np.inf, None, None, 1.0
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        self.curvature = curvature

    def _direction(self) -> np.ndarray:
        q, parts = self.slope.copy(), []
        for s, y in reversed(self.known):
            a = (s @ q) / (y @ s)
            parts.append(a)
            q -= a * y
        q *= (self.known[-1][0] @ self.known[-1][1]) / (self.known[-1][1] @ self.known[-1][1]) if self.known else 1 / self.curvature
        for (s, y), a in zip(self.known, reversed(parts)):
            q += s * (a - (y @ q) / (y @ s))
        return -q

    def tell(self, loss: float, slope: np.ndarray) -> None:
        if self.slope is not None and loss > self.loss + 1e-4 * self.size * (self.slope @ self.step):
            self.size /= 4  # too far
        else:
            if self.slope is not None:
                s, y = self.at - self.best, slope - self.slope
                if s @ y > 1e-12:
                    self.known = [*self.known, (s, y)][-MEMORY:]
            self.best, self.loss, self.slope, self.size = self.at, loss, slope, 1.0
            self.step = self._direction()
        self.at = self.best + self.size * self.step


def refitted(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, given, weights: list[np.ndarray], shrink: float = 1e-3) -> list[np.ndarray]:  # noqa: ANN001
    """Both views' weights, fitted to the labelled rows and to all given ones, from ``weights`` on."""
    sizes = [x.shape[1] for x in views]
    squares = _parted(given(), sizes)
    n = len(y)
    share = [PSEUDO * n / k if k else 0.0 for k, _, _ in squares]
    whole = [n + w * k for w, (k, _, _) in zip(share, squares)]
    scales = [np.sqrt(((x.astype(np.float64) ** 2).sum(0) + w * q) / t) + 1e-2 for x, w, (_, _, q), t in zip(views, share, squares, whole)]
    runs = [_Descent(w * s, 0.25 * len(w)) for w, s in zip(weights, scales)]
    for _ in range(PASSES):
        tried = [r.at / s for r, s in zip(runs, scales)]
        for v, (_, loss, slope) in enumerate(_parted(given(tried), sizes)):
            x = views[v].astype(np.float64) @ tried[v]
            own = np.logaddexp(0, np.where(y > 0, -x, x)).sum()
            back = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y) @ views[v].astype(np.float64)
            at = runs[v].at
            runs[v].tell((own + share[v] * loss) / whole[v] + shrink / 2 * (at @ at), (back + share[v] * slope) / whole[v] / scales[v] + shrink * at)
    return [r.best / s for r, s in zip(runs, scales)]


def _sparse_odds(part: pa.RecordBatch):  # noqa: ANN202
    at, value, n = part["at"].flatten().to_numpy(), part["value"].flatten().to_numpy(), part.num_rows
    row = np.repeat(np.arange(n), part["at"].value_lengths().to_numpy())

    def odds(view: int, weights: np.ndarray) -> np.ndarray:
        whole = np.concatenate([weights, np.zeros(METADATA)] if view == 0 else [np.zeros(CONTENT), weights])
        return np.bincount(row, whole[at] * value, n)

    return odds


def _dense(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((found.num_rows, CONTENT + METADATA), np.float32)
    for i, (at, value) in enumerate(zip(found["at"].to_pylist(), found["value"].to_pylist())):
        out[i, at] = value
    return out[:, :CONTENT], out[:, CONTENT:]


def cotrain(a: np.ndarray, b: np.ndarray, labels: np.ndarray, pool: _Held | _Stored | None = None) -> Model:
    """``a`` and ``b``: the two views of the same rows; labels 0, 1, or -1 where unknown. ``pool``: the unlabelled rows, if not these."""
    pool = pool or _Held(a[labels < 0], b[labels < 0])
    a, b, labels = a[labels >= 0], b[labels >= 0], labels[labels >= 0]
    known = np.arange(len(labels))
    share = float(labels.mean()) if len(known) else 1.0
    if not 0 < share < 1:
        odds = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
        return Model(np.zeros(a.shape[1]), np.zeros(b.shape[1]), ((1.0, 0.0), (1.0, 0.0)), np.array([0, 0, odds]))
    held, first = known[::3], np.setdiff1d(known, known[::3])
    if len(np.unique(labels[held])) < 2 or len(np.unique(labels[first])) < 2:
        held = first = known
    views = (a, b)
    rules: list[Rule] = []
    weights = [logistic(x[first], labels[first], np.ones(len(first))) for x in views]
    for turn in range(ROUNDS):
        counts = pool.confidence(rules, weights)
        if not turn:
            give = max(GIVEN, round(SHARE * int(counts[0].sum())))
        for v in (0, 1):
            n = int(counts[v].sum())
            bad = min(round(give * (1 - share)), n // 2)
            good = min(give - bad, n - bad)
            up, down = np.cumsum(counts[v]), np.cumsum(counts[v][::-1])
            low = min(int(np.searchsorted(up, bad)), _LOW) if bad else -1
            high = max(BINS - 1 - int(np.searchsorted(down, good)), _HIGH) if good else BINS
            rules.append(Rule(v, weights[v].copy(), low, high))
        weights = refitted((a[first], b[first]), labels[first].astype(np.float64), pool.teach(rules), weights)
    y, even = labels[held].astype(float), np.ones(len(held))
    odds = [np.clip(views[v][held] @ weights[v], -30, 30) for v in (0, 1)]
    fitted = tuple(calibrated(o, y, even) for o in odds)
    x = np.stack([*(s * o + c for o, (s, c) in zip(odds, fitted)), np.ones(len(held))], 1)
    both = logistic(x, y, even, shrink=1e-4, steps=500)
    return Model(weights[0], weights[1], fitted, both)


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    shapes = _Shapes()
    for part in slices(batches):
        texts = [t or "" for t in part["text"].to_pylist()]
        a = np.stack([content_view(t, shapes) for t in texts])
        b = np.stack([metadata_view(t, *x) for t, x in zip(texts, zip(part["lang"].to_pylist(), part["source"].to_pylist()))])
        yield part, a, b


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, a, b in _views(batches):
            whole = np.concatenate([a, b], 1)
            row, at = np.nonzero(whole)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(whole)))]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), whole[row, at]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *lists], ["doc_id", "at", "value"])

    sparse = _documents(docs).where("doc_id is not null").mapInArrow(views, "doc_id long, at array<int>, value array<float>")
    folder = shared_folder(docs.sparkSession)
    rows = stored(sparse.join(known, "doc_id", "left"), folder, "views")
    chosen = rows.where("quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toArrow().sort_by("doc_id")
    pool = _Stored(rows.where("quality is null").select("doc_id", "at", "value"), folder)
    return cotrain(*_dense(chosen), chosen["quality"].to_numpy().astype(np.int64), pool)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (chance of a good document) and both views' chances, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, a, b in _views(batches):
            chances = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in shared.value.odds(a, b)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c) for c in chances)], ["doc_id", "content", "metadata", "score"])

    return _documents(docs).mapInArrow(score, "doc_id long, content double, metadata double, score double")


def filtered(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.log(least / (1 - least))
        for part, a, b in _views(batches):
            yield part.filter(pa.array(shared.value.odds(a, b)[2] >= edge))

    return docs.mapInArrow(keep, docs.schema)


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
