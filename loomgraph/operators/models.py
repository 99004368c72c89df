"""Scoring with injected weights, and losses as expressions. Training itself is outside the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.scores import bce_with_logits, sigmoid

KEY = "sample_id"


def encode_texts(rows: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], out: str = "vec") -> DataFrame:
    """rows with a unit vector of each text from an injected encoder, batch by batch; a null text gives a null vector."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            if known:
                x = np.asarray(encoder([texts[i] for i in known]), dtype=np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                for i, v in zip(known, x / np.where(norm > 0, norm, 1), strict=True):
                    vectors[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, out])

    return rows.mapInArrow(run, _with(rows, out, "array<double>"))


def _with(rows: DataFrame, name: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def hashing_encoder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a text encoder: signed counts of hashed words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                x[i, h % width] += 1 if h >> 31 else -1
        return x

    return encode


class Perceptron:
    """Linear layers with ReLU between; weights are (matrix, bias) pairs."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    @property
    def width(self) -> int:
        return self.layers[0][0].shape[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return x[:, 0]

    @staticmethod
    def seeded(widths: tuple[int, ...], seed: int = 42) -> Perceptron:
        rng = np.random.default_rng(seed)
        return Perceptron([(rng.standard_normal((a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(widths, widths[1:], strict=False)])


def score_rows(rows: DataFrame, features: str, model: Perceptron, out: str = "logit") -> DataFrame:
    """rows with the model's logit of a feature array; the width is checked."""
    at = rows.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != batch.num_rows * model.width:
                raise ValueError(f"features must be {model.width} wide")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(flat.reshape(-1, model.width)))], [*batch.schema.names, out])

    return rows.mapInArrow(run, _with(rows, out, "double"))


def triple_inputs(question: Column, head: Column, relation: Column, tail: Column) -> Column:
    """Features of a triple: question, head, relation and tail vectors one after the other."""
    return F.concat(question, head, relation, tail)


# losses: one row a sample, of rows (sample_id, logit, label or touch, ...)


def soft_bce(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(KEY).agg(F.avg(bce_with_logits(F.col("logit"), F.col(label))).alias("loss"))


def answer_touch_bce(rows: DataFrame, answers: DataFrame, cap: float = 50.0, boost: float = 0.0) -> DataFrame:
    """BCE of touch with a positive weight min(negatives / positives, cap), 0 without positives; more answers weigh more."""
    n, pos = F.count(F.lit(1)).over(W.partitionBy(KEY)), F.sum("touch").over(W.partitionBy(KEY))
    ratio = (n - pos) / F.greatest(pos, F.lit(1e-6))
    weight = F.when(ratio < 1e-6, 1.0).otherwise(F.least(ratio, F.lit(cap)))
    rows = rows.withColumn("pos", pos).withColumn("weight", weight)
    out = rows.groupBy(KEY).agg(F.avg(bce_with_logits(F.col("logit"), F.col("touch"), F.col("weight"))).alias("loss"), F.max("pos").alias("pos"))
    count = answers.groupBy(KEY).agg(F.count(F.lit(1)).alias("m"))
    more = F.lit(1.0) + boost * F.greatest(F.coalesce("m", F.lit(1)) - 1, F.lit(0))
    return out.join(count, KEY, "left").select(KEY, F.when(F.col("pos") < 0.5, 0.0).otherwise(F.col("loss") * more).alias("loss"))


def _touching(rows: DataFrame, answers: DataFrame) -> DataFrame:
    ends = rows.select(*[c for c in rows.columns if c not in ("head", "relation", "tail")], F.explode(F.array_distinct(F.array("head", "tail"))).alias("answer"))
    return ends.join(answers.select(KEY, "answer").distinct().hint("shuffle_hash"), [KEY, "answer"])


def min_answer_coverage(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Sum over answers of softplus(-greatest logit of the triples that touch it); answers without triples are skipped."""
    best = _touching(rows, answers).groupBy(KEY, "answer").agg(F.max("logit").alias("x"))
    total = best.groupBy(KEY).agg(F.sum(bce_with_logits(F.col("x"), F.lit(1.0))).alias("loss"))
    return rows.select(KEY).distinct().join(total, KEY, "left").select(KEY, F.coalesce("loss", F.lit(0.0)).alias("loss"))


def soft_ranks(rows: DataFrame, tau: float = 1.0, descending: bool = False) -> DataFrame:
    """(sample_id, logit, soft_rank, n) of each distinct logit of a sample: 1 + the sum over its n rows of the sigmoid of the difference.

    Equal logits count by their number; the differences are taken in pieces, so
    memory is linear in a sample.
    """
    counts = rows.groupBy(KEY, "logit").agg(F.count(F.lit(1)).alias("m"))
    sign = 1.0 if descending else -1.0

    def run(table: pa.Table) -> pa.Table:
        x, m = table["logit"].to_numpy(), table["m"].to_numpy().astype(np.float64)
        step = max(1, (1 << 20) // max(1, len(x)))
        with np.errstate(over="ignore"):
            ranks = [(m / (1 + np.exp(-sign * (x - x[i : i + step, None]) / tau))).sum(axis=1) for i in range(0, len(x), step)]
        return pa.table({KEY: table[KEY], "logit": table["logit"], "soft_rank": pa.array(1 + np.concatenate(ranks)), "n": pa.array(np.full(len(x), int(m.sum())))})

    kind = rows.schema[KEY].dataType.simpleString()
    return counts.where(F.col("logit").isNotNull()).groupBy(KEY).applyInArrow(run, f"{KEY} {kind}, logit double, soft_rank double, n long")


def listwise_surrogate(rows: DataFrame, answers: DataFrame, k: int = 200, tau: float = 1.0, cap: float = 50.0, cover_weight: float = 0.5, descending: bool = False) -> DataFrame:
    """Soft-rank loss: P(in top k) from pairwise sigmoids, weighted BCE on touch, and coverage of answers.

    As defined, a higher score has a larger soft rank; descending turns that.
    """
    p = sigmoid((F.least(F.lit(float(k)), F.col("n").cast("double")) + 0.5 - F.col("soft_rank")) / tau)
    out = rows.join(soft_ranks(rows, tau, descending).hint("shuffle_hash"), [KEY, "logit"]).withColumn("p", p)
    log = lambda v: F.ln(F.greatest(v, F.lit(1e-6)))
    # rows that touch an answer have one weight a sample, the others 1: two sums, and no pass over a sample's rows to tell them the weight
    cost, touched = -(F.col("touch") * log(F.col("p")) + (1 - F.col("touch")) * log(1 - F.col("p"))), F.col("touch") > 0.5
    total = lambda c: F.coalesce(F.sum(F.when(c, cost)), F.lit(0.0))
    sums = out.groupBy(KEY).agg(total(touched).alias("_on"), total(~touched).alias("_off"), F.count(cost).alias("_m"), F.max("n").alias("n"), F.sum("touch").alias("pos"))
    weight = F.least((F.col("n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1e-6)), F.lit(cap))
    edge = sums.select(KEY, ((weight * F.col("_on") + F.col("_off")) / F.col("_m")).alias("edge"), "pos")
    miss = _touching(out, answers).groupBy(KEY, "answer").agg(F.product(1 - F.col("p")).alias("q"))
    cover = miss.groupBy(KEY).agg(F.avg(-log(1 - F.col("q"))).alias("cover"))
    return edge.join(cover, KEY, "left").select(KEY, F.when(F.col("pos") < 0.5, 0.0).otherwise(F.col("edge") + cover_weight * F.coalesce("cover", F.lit(0.0))).alias("loss"))


def pairwise_logistic(examples: DataFrame, logits: DataFrame | None = None) -> DataFrame:
    """Mean of log(1 + exp(negative - positive)) over a sample's positive and negative examples (at most max_pos x max_neg pairs).

    logits: of the examples, where they have no column logit of their own.
    """
    rows = examples if logits is None else examples.join(logits.select(KEY, "triple_id", "logit"), [KEY, "triple_id"])
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("logit")))
    sides = rows.groupBy(KEY).agg(of("pos").alias("p"), of("neg").alias("n"))
    pairs = sides.select(KEY, F.explode("p").alias("p"), "n").select(KEY, "p", F.explode("n").alias("n"))
    return pairs.groupBy(KEY).agg(F.avg(F.ln(1 + F.exp(F.col("n.logit") - F.col("p.logit")))).alias("loss"))
