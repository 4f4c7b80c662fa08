"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, and single, paired and repeated word shapes (letter case and the
marks around a word).  Each indicator is scaled by the log ratio of its class counts; a linear
model with hinge loss is then fitted by dual coordinate descent, mixed with the plain naive Bayes
direction, and its margin is turned into a probability by a logistic curve.

Learning uses a bounded sample of labelled rows (``TRAIN_ROWS`` of each class, see
``common.labelled_sample``); scoring covers every row and every whole text in one narrow pass.

Null or empty texts are scored by the bias alone; texts of any length are read whole.  Without labels of both classes every score
is the labelled share of class 1 (one half without labels).  A document that is labelled both ways counts as class 1, a repeated
row as often as it occurs.  Repeated rows and texts that tie get equal scores; other columns pass through, ``quality_score`` is replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.llm import common

#: The bound of the training sample, for each class.
TRAIN_ROWS = 4_000
WORD_SLOTS = SHAPE_SLOTS = 1 << 16
SLOTS = WORD_SLOTS + SHAPE_SLOTS
COST, EPOCHS, MIX, SMOOTH = 0.05, 12, 0.5, 1.0
MEMO_WORDS = 100_000


def slot(kind: str, gram: str, slots: int) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x00{gram}".encode("utf-8", "surrogatepass")) % slots


def shape(word: str) -> str:
    """Runs of capitals, letters and digits as one sign each; other marks as they are, runs shortened."""
    marks = []
    for c in word:
        m = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if marks[-2:] != [m, m] if m not in "9Xx" else marks[-1:] != [m]:
            marks.append(m)
    return "".join(marks[:12])


class Grams(dict):
    """Word to (slot of the word, shape); emptied at MEMO_WORDS."""

    def __missing__(self, word: str) -> tuple[int, str]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = (slot("w", word.lower(), WORD_SLOTS), sys.intern(shape(word)))
        return found


class Pairs(dict):
    """Shape n-gram to slot."""

    def __missing__(self, gram) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[gram] = found = WORD_SLOTS + slot("s", " ".join(gram), SHAPE_SLOTS)
        return found


_GRAMS, _PAIRS = Grams(), Pairs()


def forget() -> None:
    """At the end of a task: a worker that goes on with other stages keeps nothing."""
    _GRAMS.clear()
    _PAIRS.clear()


def features(text: str | None) -> np.ndarray:
    """Sorted slots of the n-grams that a text has."""
    found = [_GRAMS[w] for w in (text or "").split()]
    shapes = [s for _, s in found]
    slots = {w for w, _ in found}
    slots.update([_PAIRS[g] for g in set(zip(shapes))])
    slots.update([_PAIRS[g] for g in set(zip(shapes, shapes[1:]))])
    return np.array(sorted(slots), dtype=np.int32)


class Model:
    """Weights of each slot, bias and the logistic curve over margins."""

    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights, bias, curve

    def margin(self, slots: np.ndarray) -> float:
        # the same length for every text, so long texts have no larger margins
        return float(self.weights[slots].sum() / np.sqrt(len(slots)) + self.bias) if len(slots) else self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed targets and a small ridge."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        m = np.array([[np.dot(h, margin * margin) + 1e-3, np.dot(h, margin)], [np.dot(h, margin), h.sum() + 1e-3]])
        step = np.linalg.solve(m, np.array([np.dot(g, margin) + 1e-3 * a, g.sum() + 1e-3 * b]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent: one multiplier a row, kept between 0 and its cost."""
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    xs = [values[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([np.dot(x, x) + 1 for x in xs])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r, x = rows[i], xs[i]
            gap = y[i] * (np.dot(w[r], x) + bias) - 1
            new = min(max(alpha[i] - gap / square[i], 0.0), cost[i])
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[r] += d * x
                bias += d
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, bias


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    n1 = int(label.sum())
    if not n1 or n1 == len(label):
        share = n1 / len(label) if len(label) else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SLOTS, np.float32), 0.0, (0.0, float(np.log(p / (1 - p)))))
    up, down = np.full(SLOTS, SMOOTH), np.full(SLOTS, SMOOTH)
    for r, y in zip(rows, label, strict=True):
        (up if y else down)[r] += 1
    ratio = np.log(up / (n1 + 2 * SMOOTH)) - np.log(down / (len(label) - n1 + 2 * SMOOTH))
    ratio[(up == SMOOTH) & (down == SMOOTH)] = 0
    cost = np.where(label == 1, COST * len(label) / (2 * n1), COST * len(label) / (2 * (len(label) - n1)))
    w, bias = descend(rows, ratio, np.where(label == 1, 1.0, -1.0), cost)
    even = np.abs(w).mean()
    model = Model((((1 - MIX) * even + MIX * w) * ratio).astype(np.float32), float(MIX * bias), (1.0, 0.0))
    model.curve = logistic_curve(np.array([model.margin(r) for r in rows]), label)
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = TRAIN_ROWS) -> Model:
    """Features on the executors, the fit in one task over the bounded sample; the model is 0.5 MB."""
    sample = common.labelled_sample(docs, labels, target, per_class)

    def slots_of(batches):
        for batch in common.small(batches):
            rows = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "slots", "y"])
        forget()

    def learn(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fit([np.frombuffer(r[1], np.int32) for r in rows], np.array([r[2] for r in rows], dtype=int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    grams = sample.mapInArrow(slots_of, f"doc_id {kind}, slots binary, y int")
    return pickle.loads(grams.repartition(1).mapInArrow(learn, "model binary").first()[0])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``quality_score`` (a column of that name in ``docs`` is replaced)."""
    docs = docs.drop("quality_score")
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in common.small(batches):
            found = m.score(np.array([m.margin(features(t)) for t in batch.column(place).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "quality_score"])
        forget()

    return docs.mapInArrow(run, schema)
