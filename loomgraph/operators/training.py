"""Training of a triple scorer: gradients summed over partitions, Adam, early stopping, restart.

Samples are dealt to batches by a hash of their id, once: the rows are written to the
shared folder in a folder for each batch, so that a step reads its own rows and nothing else. A
step is one job: each task sums the gradient of its rows into one vector, these are added
in a tree of about the square root of their number, and the driver adds what is left (vectors
of the size of the model, never rows) and takes the optimiser's step. The order of batches is
drawn anew each epoch. After each epoch the weights, the optimiser's moments and the counters are
a part of a table, from which a stopped run goes on.

The loss of a batch is the mean over its samples of the mean over their rows of
the cross entropy of logits and soft labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import metrics, ranking
from loomgraph.operators.models import Perceptron, score_rows
from loomgraph.sources import storage

KEY = "sample_id"


@dataclass
class Adam:
    """Adam; decay is added to the gradient, or taken from the weights where it is decoupled (AdamW)."""

    rate: float = 1e-3
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    decay: float = 0.0
    decoupled: bool = False
    step: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))
    second: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def update(self, weights: np.ndarray, slope: np.ndarray) -> np.ndarray:
        if not len(self.first):
            self.first, self.second = np.zeros_like(weights), np.zeros_like(weights)
        self.step += 1
        if self.decoupled:
            weights = weights * (1 - self.rate * self.decay)
        else:
            slope = slope + self.decay * weights
        a, b = self.betas
        self.first = a * self.first + (1 - a) * slope
        self.second = b * self.second + (1 - b) * slope**2
        return weights - self.rate * (self.first / (1 - a**self.step)) / (np.sqrt(self.second / (1 - b**self.step)) + self.eps)


def flat(model: Perceptron) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in model.layers for x in layer])


def shaped(weights: np.ndarray, widths: tuple[int, ...]) -> Perceptron:
    layers, at = [], 0
    for a, b in zip(widths, widths[1:], strict=False):
        layers.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return Perceptron(layers)


def slope(model: Perceptron, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient (flat) and value of the weighted sum of cross entropies of rows."""
    inputs = []
    for k, (w, b) in enumerate(model.layers):
        inputs.append(x)
        x = x @ w + b
        if k + 1 < len(model.layers):
            x = np.maximum(x, 0)
    logit = x[:, 0]
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
    back = (weight * (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - label))[:, None]
    parts: list[np.ndarray] = []
    for (w, _), own in zip(model.layers[::-1], inputs[::-1], strict=True):
        parts = [(own.T @ back).ravel(), back.sum(axis=0), *parts]
        back = (back @ w.T) * (own > 0)  # an input of a later layer is what a ReLU let through
    return np.concatenate(parts), loss


_SUM = "slot int, slope binary, loss double"


def _added(rows: Iterator[tuple[bytes, float]], size: int) -> tuple[np.ndarray, float]:
    total, loss = np.zeros(size), 0.0
    for raw, own in rows:
        total += np.frombuffer(raw)
        loss += own
    return total, loss


def batch_slope(rows: DataFrame, model: Perceptron, samples: int) -> tuple[np.ndarray, float]:
    """Gradient and loss of rows (features, label, weight) of a batch of so many samples."""
    widths = (model.width, *(len(b) for _, b in model.layers))
    weights = flat(model)
    slots = max(1, int(rows.sparkSession.sparkContext.defaultParallelism ** 0.5))

    def of_rows(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        own, total, loss = shaped(weights, widths), np.zeros(len(weights)), 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                g, v = slope(own, x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
                total, loss = total + g, loss + v
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([total.tobytes()]), pa.array([loss])], ["slot", "slope", "loss"])

    def of_slots(batches: Iterator[pa.RecordBatch]):
        total, loss = _added((x for b in batches for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), len(weights))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()]), pa.array([loss])], ["slot", "slope", "loss"])

    sums = rows.select("features", "label", "weight").mapInArrow(of_rows, _SUM)
    if slots > 1:
        sums = sums.repartition(slots, "slot").mapInArrow(of_slots, _SUM)
    total, loss = _added(((bytes(r["slope"]), r["loss"]) for r in sums.collect()), len(weights))  # about a square root of the partitions, a model each
    return total / samples, loss / samples


def dealt(rows: DataFrame, batches: int, folder: str) -> tuple[DataFrame, dict[int, int]]:
    """rows (sample_id, features, label) with weight 1 / rows of their sample, stored by batch; and the samples of each batch."""
    own = rows.groupBy(KEY).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    batch = F.pmod(F.xxhash64(KEY), F.lit(batches)).cast("int")
    stored = rows.join(own, KEY).select(KEY, F.transform("features", lambda x: x.cast("double")).alias("features"), F.col("label").cast("double").alias("label"), "weight", batch.alias("batch"))
    done = f"{folder}/dealt"
    if not storage.finished_parts(rows.sparkSession, done):
        stored.write.mode("overwrite").partitionBy("batch").parquet(f"{done}/part=000000")
    out = rows.sparkSession.read.schema(stored.schema).parquet(f"{done}/part=000000")
    return out, {r["batch"]: r["n"] for r in own.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n")).collect()}


_CHECKPOINT = "epoch int, weights binary, first binary, second binary, step long, best binary, best_epoch int, best_metric double, patient int, loss double, metric double"


@dataclass
class Trained:
    model: Perceptron  # of the best epoch
    history: DataFrame  # epoch, loss, metric, best_metric, best_epoch and patient of every epoch
    stopped_early: bool


def train_scorer(
    rows: DataFrame, evaluate: Callable[[Perceptron], float], widths: tuple[int, ...], optimizer: Adam, epochs: int, patience: int = 10, batches: int = 1,
    folder: str | None = None, seed: int = 42, evaluate_first: bool = False, start: Perceptron | None = None,
) -> Trained:
    """Trains on rows (sample_id, features, label) until the metric has not grown for ``patience`` epochs.

    evaluate_first: the metric of an epoch is of the weights before it, as the first stage has it, not
    after it. A folder of an earlier call goes on after its last whole epoch.
    """
    spark = rows.sparkSession
    folder = (folder or storage.new_folder(spark, "training")).rstrip("/")
    table, samples = dealt(rows, batches, folder)
    if not samples:
        raise ValueError("there is nothing to train on")
    weights = flat(start or Perceptron.seeded(widths, seed))
    best, best_epoch, best_metric, patient = weights, -1, -np.inf, 0
    parts = storage.finished_parts(spark, f"{folder}/epochs")
    if parts:
        r = spark.read.schema(_CHECKPOINT).parquet(parts[-1]).first()
        weights, best = np.frombuffer(bytes(r["weights"])), np.frombuffer(bytes(r["best"]))
        optimizer.step, optimizer.first, optimizer.second = r["step"], np.frombuffer(bytes(r["first"])), np.frombuffer(bytes(r["second"]))
        best_epoch, best_metric, patient = r["best_epoch"], r["best_metric"], r["patient"]
    for epoch in range(len(parts), epochs):
        if patient >= patience:
            break
        metric = evaluate(shaped(weights, widths)) if evaluate_first else None
        seen, total = weights, 0.0
        for b in np.random.default_rng((seed, epoch)).permutation(sorted(samples)).tolist():
            g, loss = batch_slope(table.where(F.col("batch") == b), shaped(weights, widths), samples[b])
            weights = optimizer.update(weights, g)
            total += loss / len(samples)
        if not evaluate_first:
            metric, seen = evaluate(shaped(weights, widths)), weights
        if metric > best_metric:
            best, best_epoch, best_metric, patient = seen, epoch, metric, 0
        else:
            patient += 1
        row = (epoch, weights.tobytes(), optimizer.first.tobytes(), optimizer.second.tobytes(), optimizer.step, best.tobytes(), best_epoch, float(best_metric), patient, total, float(metric))
        storage.write_part(spark.createDataFrame([row], _CHECKPOINT).coalesce(1), f"{folder}/epochs", epoch)
    parts = storage.finished_parts(spark, f"{folder}/epochs")
    history = spark.read.schema(_CHECKPOINT).parquet(*parts).select("epoch", "loss", "metric", "best_metric", "best_epoch", "patient")
    return Trained(shaped(best, widths), history, patient >= patience)


def by_rerank_metric(rows: DataFrame, answers: DataFrame, mode: str = "answer_recall", k: int = 200, beta: float = 0.5) -> Callable[[Perceptron], float]:
    """The metric that picks a checkpoint: of rows (sample_id, triple_id, head, relation, tail, features, label, is_shortest) ranked by a model.

    What no model changes is counted once. Rows that lie by sample are cut to the k best of each before they travel to be ranked.
    """
    totals = storage.checkpointed(metrics.rerank_totals(rows))
    answers = storage.checkpointed(answers)

    def of(model: Perceptron) -> float:
        best = ranking.best_by_score(score_rows(rows, "features", model), k, "logit")
        found = metrics.target_metric(metrics.rerank_metrics(best, answers, (k,), totals), mode, k, beta).first()
        return float(found["target"] or 0.0) if found else 0.0

    return of
