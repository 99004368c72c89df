"""Hard negatives against brute force: odd rows, shared vectors, ties, small chunks, clustered and random vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import hard_negatives
from pyspark.sql import functions as F

DDL = "vec_id long, embedding array<double>, label int, item string, best string, x string"


def made():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.2 * rng.normal(size=8)).round(3).tolist(), int(k % 4)) for k in range(240)]
    rows += [(300 + k, centres[1].round(2).tolist(), 1) for k in range(150)]  # a vector that many share
    rows += [(500 + k, centres[1].round(2).tolist(), 2) for k in range(30)]
    rows += [(600 + k, [float(v) for v in rng.integers(-2, 3, 8)], int(k % 3)) for k in range(120)]  # ties
    rows += [(800, None, 1), (810, [None] * 8, 1), (820, [float("nan")] * 8, 1), (830, [float("inf")] * 8, 1), (840, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(850, [], 1), (860, [1.5, 2.5], 1), (870, [0.0] * 8, 2), (880, [40.0] * 8, 3), (890, [-1.0] * 8, 1), rows[20], rows[20]]
    return rows


def brute(rows, every, positives=5, negatives=5, low=80, scale=256):
    fine = {}
    for k, v, y in rows:
        if k is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[k] = (np.array([math.floor(scale * x) for x in v] + [0] * (8 - len(v)), dtype=object), y)
    out = set()
    for a, (q, y) in fine.items():
        if a % every:
            continue
        score = {k: int(q @ x) for k, (x, _) in fine.items()}
        order = sorted((k for k in fine if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if fine[k][1] == y][:positives]:
            hard = [k for k in order if fine[k][1] != y and low * score[p] <= 100 * score[k] <= 100 * score[p]][:negatives]
            out |= {(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(hard)}
    return out


def got(table, every, **other):
    rows = hard_negatives.hard_negatives(table, F.col("vec_id") % every == 0, **other).collect()
    out = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in made()], DDL).repartition(3)


def test_equals_brute_force(table):
    want = brute(made(), 10)
    assert len(want) > 500 and got(table, 10) == want
    assert got(table, 10, chunk=7, sample=40) == want  # many cells, an index fitted on a few rows


def test_other_parameters(table):
    assert got(table, 30, positives=2, negatives=7, low=20, scale=10.0) == brute(made(), 30, 2, 7, 20, 10)


def test_searches_skip_far_keys(spark):
    """Well apart clusters: a query's keys are few, and the answers whole."""
    rng = np.random.default_rng(2)
    x = np.repeat(50 * rng.normal(size=(12, 8)), 40, axis=0) + rng.normal(size=(480, 8))
    x = 50 * x / np.sqrt((x * x).sum(axis=1))[:, None]
    rows = [(k, v.tolist(), int(k % 5)) for k, v in enumerate(x)]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DDL)
    index = hard_negatives.build_index(hard_negatives.usable_rows(table, "vec_id", "embedding", F.col("label").cast("long"), 256.0), 6, chunk=16)
    assert index.chunks.agg(F.sum(F.size("ids"))).first()[0] == 480
    stored = index.chunks.select("cell", "low", "high", "ids").collect()
    assert all(len(r["ids"]) <= 16 and r["low"] <= r["high"] for r in stored)
    run, _ = hard_negatives._packs(index, 256 * 5.0, -1.0)
    q = hard_negatives.packed(np.floor(256 * x[:1]))
    one = pa.RecordBatch.from_pydict({"item": [1], "x": [q], "label": [0], "same": [True], "floor": [0], "ceiling": [0], "bar": [0]})
    assert 0 < len(list(run([one]))) < len(index.cell) / 3
    assert got(table, 20) == brute(rows, 20)


def test_text_labels_and_empty_tables(spark, table):
    named = table.withColumn("label", F.concat(F.lit("l"), F.col("label")))
    assert got(named, 10) == brute(made(), 10)
    assert got(table.where("false"), 10) == set()
    assert got(table.where("vec_id % 10 <> 0"), 10) == set()
    assert got(table.where("label = 1"), 10) == set()
