"""Seeded mini-batch training of the linear model: Adam over class-weighted cross entropy, with a bound on the gradient's norm.

A step is one pass over a batch's rows: each task adds up its rows' gradients, and one row a task, as long as the parameters, comes to the driver, which
takes the step.  Which batch a row is in follows from seed, epoch and id alone, so a run is the same on any partitioning.  After every
epoch the validation rows are scored; training ends when macro F1 hasn't grown for ``patience`` epochs, and the best epoch's
parameters are kept.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators import metrics
from tidebook.sources import shared

CLASSES = 3


@dataclasses.dataclass(frozen=True)
class Settings:
    epochs: int = 20
    batches: int = 8
    rate: float = 1e-3
    decay: float = 0.0
    norm: float = 1.0
    patience: int = 5
    weighted: bool = True
    seed: int = 0


@dataclasses.dataclass
class Adam:
    """The optimiser's state over one array of parameters."""

    parameters: np.ndarray
    rate: float = 1e-3
    decay: float = 0.0
    norm: float = 1.0

    def __post_init__(self):
        self.first, self.second, self.steps = np.zeros_like(self.parameters), np.zeros_like(self.parameters), 0

    def step(self, gradient: np.ndarray) -> None:
        size = np.sqrt((gradient**2).sum())
        gradient = gradient * min(1.0, self.norm / (size + 1e-6)) + self.decay * self.parameters
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        self.parameters = self.parameters - self.rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)


def gradients(x: np.ndarray, y: np.ndarray, parameters: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(sum of weighted gradients, sum of weighted losses, sum of weights) of rows; the last column of ``parameters`` is the bias."""
    logits = x @ parameters[:, :-1].T + parameters[:, -1]
    logits = logits - logits.max(1, keepdims=True)
    log_p = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    w = weights[y]
    loss = -(w * log_p[np.arange(len(y)), y]).sum()
    delta = np.exp(log_p)
    delta[np.arange(len(y)), y] -= 1
    delta *= w[:, None]
    return np.concatenate([delta.T @ x, delta.sum(0)[:, None]], axis=1), float(loss), float(w.sum())


def in_batch(id_column: str, epoch: int, settings: Settings):
    """The batch of a row in an epoch."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(settings.seed), F.lit(epoch), F.col(id_column).cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(settings.batches))


def one_step(rows: DataFrame, parameters: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Gradient, loss and weight of the rows (x, y), added up task by task."""
    model = rows.sparkSession.sparkContext.broadcast((parameters, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, w = model.value
        total, loss, weight = np.zeros_like(theta), 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                g, own_loss, own_weight = gradients(x, batch.column(1).to_numpy(zero_copy_only=False), theta, w)
                total, loss, weight = total + g, loss + own_loss, weight + own_weight
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([loss]), pa.array([weight])], names=["g", "loss", "weight"])

    parts = rows.mapInArrow(run, "g array<double>, loss double, weight double")
    cells = parts.select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
    sums = parts.agg(F.sum("loss").alias("loss"), F.sum("weight").alias("weight"))
    found = cells.crossJoin(F.broadcast(sums)).collect()  # a row for each parameter
    out = np.zeros(parameters.size)
    for r in found:
        out[r["i"]] = r["g"]
    return out.reshape(parameters.shape), found[0]["loss"] if found else 0.0, found[0]["weight"] if found else 0.0


def predict(rows: DataFrame, parameters: np.ndarray) -> DataFrame:
    """Adds ``p``, the likeliest class of ``x``."""
    logits = [sum((F.col("x")[j] * float(v) for j, v in enumerate(row[:-1])), F.lit(float(row[-1]))) for row in parameters]
    best = F.greatest(*logits)
    return rows.withColumn("p", F.when(logits[0] == best, 0).when(logits[1] == best, 1).otherwise(2))


def train(fit: DataFrame, validation: DataFrame, columns: list[str], settings: Settings | None = None, id_column: str = "seq", label: str = "y") -> tuple[np.ndarray, DataFrame]:
    """(parameters (classes, columns + 1) of the best epoch, table of epoch, loss, macro_f1, best_epoch, stopped).

    Both sides are written once, since every step reads them.
    """
    settings, spark = settings or Settings(), fit.sparkSession
    path = shared.new_folder(spark)
    for name, rows in (("fit", fit), ("validation", validation)):
        rows.select(F.col(id_column).alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col(label).cast("int").alias("y")).write.parquet(f"{path}/{name}")
    ready, held = spark.read.parquet(f"{path}/fit"), spark.read.parquet(f"{path}/validation")
    weights = np.ones(CLASSES)
    if settings.weighted:
        counts = {r["y"]: r["n"] for r in ready.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
        weights = np.array([sum(counts.values()) / (CLASSES * max(counts.get(c, 1), 1)) for c in range(CLASSES)])
    optimiser = Adam(np.zeros((CLASSES, len(columns) + 1)), settings.rate, settings.decay, settings.norm)
    best, kept, history = -1.0, optimiser.parameters, []
    for epoch in range(1, settings.epochs + 1):
        losses = weighed = 0.0
        for b in range(settings.batches):
            g, loss, weight = one_step(ready.where(in_batch("id", epoch, settings) == b).select("x", "y"), optimiser.parameters, weights)
            if weight:
                optimiser.step(g / weight)
            losses, weighed = losses + loss, weighed + weight
        scored = predict(held, optimiser.parameters).withColumn("fold", F.lit(0))
        summary = metrics.summary(metrics.class_scores(metrics.confusion(scored.select("fold", "y", "p"), keys=["fold"]), ["fold"]), ["fold"]).collect()
        f1 = summary[0]["macro_f1"] if summary else 0.0
        history.append((epoch, losses / weighed if weighed else 0.0, float(f1)))
        if f1 > best:
            best, kept = f1, optimiser.parameters
        if epoch - max(history, key=lambda h: (h[2], -h[0]))[0] >= settings.patience:
            break
    rounds = spark.createDataFrame([(0, *h, -h[2]) for h in history], "run int, epoch int, loss double, macro_f1 double, _worse double")
    return kept, metrics.best_so_far(rounds, ["run"], "epoch", "_worse", settings.patience).select("epoch", "loss", "macro_f1", "best_epoch", "stopped")
