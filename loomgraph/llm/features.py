"""Hashed character n-grams of distinct words, linear machines, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import LOWER, remainder, span_hashes

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8 bytes."""
    out = LOWER[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def word_ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, orders: tuple[int, ...], bits: int):
    """Buckets of the byte n-grams of each word between two marks, and the index of their word."""
    length = ends - starts
    base = np.cumsum(length + 2) - (length + 2)
    padded = np.full(int((length + 2).sum()), ord("^"), dtype=np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    padded[np.repeat(base + 1, length) + inside] = data[np.repeat(starts, length) + inside]
    padded[base + length + 1] = ord("$")
    grams, owners = [], []
    for n in orders:
        count = np.maximum(length + 3 - n, 0)
        owner = np.repeat(np.arange(len(length), dtype=np.int32), count)
        at = np.repeat(base, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        grams.append((span_hashes(padded, at, at + n) >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(owner)
    return np.concatenate(grams), np.concatenate(owners)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Starts and ends of one occurrence of each distinct word, and the word of each occurrence."""
    _, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[at], ends[at], inverse


def linear_machine(x: np.ndarray, positive: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, dual coordinate ascent)."""
    y = np.where(positive, 1.0, -1.0)
    kernel = (x @ x.T).astype(np.float64) + 1.0
    alpha, f, ridge = np.zeros(len(y)), np.zeros(len(y)), 1 / (2 * c)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)):
            step = max(alpha[i] - (y[i] * f[i] - 1 + alpha[i] * ridge) / (kernel[i, i] + ridge), 0.0) - alpha[i]
            if step:
                alpha[i] += step
                f += step * y[i] * kernel[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return (alpha * y) @ x, float((alpha * y).sum())


def bounded_sample(rows: DataFrame, id_col: str, by: str, per_class: int, folds: int = 5, fold: int = 0) -> tuple[list, dict]:
    """Ids and classes of at most per_class rows of each class outside the held-out fold, by the order of a hash of the id; all sizes.

    A hash threshold from the class sizes bounds what comes to the driver.
    """
    rows = rows.where(F.col(by).isNotNull() & (remainder(id_col, folds) != fold)).select(F.col(id_col).alias("id"), F.col(by).alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        share = min(1.0, (per_class + 4 * per_class**0.5) / n)
        keep = keep | ((F.col("y") == F.lit(y)) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)))
    got = rows.where(keep).select("id", "y", F.xxhash64("id").alias("h")).collect()
    out, seen = [], dict.fromkeys(sizes, 0)
    for r in sorted(got, key=lambda r: (str(r["y"]), r["h"], r["id"])):
        if seen[r["y"]] < per_class:
            seen[r["y"]] += 1
            out.append((r["id"], r["y"]))
    return out, sizes
