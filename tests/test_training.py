"""Training against a plain numpy run of the same order: weights, patience, restart, and the checkpoint of the best metric."""

import itertools
import math
import zlib

import numpy as np
import pytest
from loomgraph.operators import graph, metrics, ranking, training
from loomgraph.operators.models import Perceptron, score_rows
from loomgraph.plans.answers import scorer_rows, soft_rows
from loomgraph.sources import storage
from loomgraph.sources.views import Views
from pyspark.sql import functions as F

WIDTHS = (3, 5, 4, 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    return [(int(s), rng.normal(size=3).tolist(), float(rng.choice([0.0, 0.3, 0.7, 1.0]))) for s in rng.integers(0, 12, 150)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "sample_id long, features array<double>, label double").repartition(5)


def batch_of(spark, ids, batches):
    table = spark.createDataFrame([(i,) for i in ids], "sample_id long")
    return {r["sample_id"]: r["b"] for r in table.select("sample_id", F.pmod(F.xxhash64("sample_id"), F.lit(batches)).cast("int").alias("b")).collect()}


def loss_of(model, own):
    """Mean over samples of the mean over rows, one row at a time."""
    per = {}
    for s, x, y in own:
        z = float(model(np.array([x]))[0])
        per.setdefault(s, []).append(math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z)
    return float(np.mean([np.mean(v) for v in per.values()]))


def numeric(weights, own, step=1e-6):
    out = np.zeros_like(weights)
    for k in range(len(weights)):
        w = weights.copy()
        w[k] += step
        up = loss_of(training.shaped(w, WIDTHS), own)
        w[k] -= 2 * step
        out[k] = (up - loss_of(training.shaped(w, WIDTHS), own)) / (2 * step)
    return out


def plain(data, of, weights, epochs, rate, decay, decoupled, seed=42):
    """The same steps with gradients of whole batches in numpy, and Adam written out."""
    m, v, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for epoch in range(epochs):
        for b in np.random.default_rng((seed, epoch)).permutation(sorted(set(of.values()))).tolist():
            own = [r for r in data if of[r[0]] == b]
            n = {s: sum(r[0] == s for r in own) for s, _, _ in own}
            g, _ = training.slope(training.shaped(weights, WIDTHS), np.array([r[1] for r in own]), np.array([r[2] for r in own]), np.array([1 / n[r[0]] / len(n) for r in own]))
            step += 1
            g = g if decoupled else g + decay * weights
            weights = weights * (1 - rate * decay) if decoupled else weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights = weights - rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def test_slope_equals_differences(data):
    weights = training.flat(Perceptron.seeded(WIDTHS, 3))
    model = training.shaped(weights + 0.1 * np.random.default_rng(0).normal(size=len(weights)), WIDTHS)
    n = {s: sum(r[0] == s for r in data) for s, _, _ in data}
    g, loss = training.slope(model, np.array([r[1] for r in data]), np.array([r[2] for r in data]), np.array([1 / n[r[0]] / len(n) for r in data]))
    assert loss == pytest.approx(loss_of(model, data))
    assert g == pytest.approx(numeric(training.flat(model), data), abs=1e-6)


@pytest.mark.parametrize("decoupled", [False, True])
def test_weights_equal_a_numpy_run(spark, rows, data, decoupled):
    of = batch_of(spark, {s for s, _, _ in data}, 3)
    grows = itertools.count()
    got = training.train_scorer(rows, lambda m: next(grows), WIDTHS, training.Adam(rate=0.05, decay=0.01, decoupled=decoupled), epochs=3, batches=3)
    assert [r["best_epoch"] for r in got.history.orderBy("epoch").collect()] == [0, 1, 2] and not got.stopped_early
    want = plain(data, of, training.flat(Perceptron.seeded(WIDTHS, 42)), 3, 0.05, 0.01, decoupled)
    assert training.flat(got.model) == pytest.approx(want, abs=1e-10)


def test_patience_best_epoch_and_restart(spark, rows, data, tmp_path):
    said = iter([0.2, 0.5, 0.5, 0.4, 0.9, 0.9])
    asked = []

    def evaluate(model):
        asked.append(training.flat(model))
        return next(said)

    run = lambda epochs: training.train_scorer(rows, evaluate, WIDTHS, training.Adam(rate=0.05), epochs, patience=2, batches=2, folder=f"{tmp_path}/t")
    first = run(2)
    assert not first.stopped_early and len(asked) == 2
    again = run(10)  # goes on after the last whole epoch
    assert again.stopped_early and len(asked) == 4
    history = [tuple(r) for r in again.history.orderBy("epoch").select("epoch", "metric", "best_metric", "best_epoch", "patient").collect()]
    assert history == [(0, 0.2, 0.2, 0, 0), (1, 0.5, 0.5, 1, 0), (2, 0.5, 0.5, 1, 1), (3, 0.4, 0.5, 1, 2)]
    assert (training.flat(again.model) == asked[1]).all()
    whole = training.train_scorer(rows, lambda m: 0.0, WIDTHS, training.Adam(rate=0.05), 4, batches=2)
    assert run(10).stopped_early and len(asked) == 4
    # the same weights as in one go
    of = batch_of(spark, {s for s, _, _ in data}, 2)
    assert asked[3] == pytest.approx(plain(data, of, training.flat(Perceptron.seeded(WIDTHS, 42)), 4, 0.05, 0.0, False), abs=1e-10)
    assert whole.history.count() == 4


def test_the_metric_of_the_weights_before_an_epoch(rows):
    seen = []

    def evaluate(model):
        seen.append(training.flat(model))
        return float(len(seen) == 1)

    got = training.train_scorer(rows, evaluate, WIDTHS, training.Adam(), 3, evaluate_first=True)
    start = training.flat(Perceptron.seeded(WIDTHS, 42))
    assert (seen[0] == start).all() and (training.flat(got.model) == start).all() and not (seen[1] == start).all()
    with pytest.raises(ValueError, match="nothing to train on"):
        training.train_scorer(rows.where("false"), evaluate, WIDTHS, training.Adam(), 1)


def test_rank_metric_of_a_model(spark):
    rows = [(1, k, f"h{k}", "r", f"t{k}", [float(zlib.crc32(bytes([k])) % 100), float(k), 0.0], float(k == 3), k == 3) for k in range(10)]
    table = spark.createDataFrame(rows, "sample_id long, triple_id int, head string, relation string, tail string, features array<double>, label double, is_shortest boolean")
    answers = spark.createDataFrame([(1, "t3"), (1, "t9")], "sample_id long, answer string")
    up = Perceptron([(np.array([[0.0], [1.0], [0.0]]), np.zeros(1))])
    down = Perceptron([(np.array([[0.0], [-1.0], [0.0]]), np.zeros(1))])
    of = training.by_rerank_metric(table, answers, "answer_recall", 5)
    assert (of(up), of(down)) == (0.5, 0.5) and training.by_rerank_metric(table, answers, "full_cov", 7)(up) == 1.0


def test_scorer_rows_lie_by_sample_and_equal_joined_ones(spark, data_dir):
    v = Views(spark, data_dir)
    with storage.in_place(spark):
        rows = scorer_rows(v)
        plan = rows.groupBy("sample_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    plain = graph.structural_features(soft_rows(v))
    shares = ("h_out", "t_out", "h_in", "t_in", "h_mentions", "t_mentions", "relation_count", "pair_repeats")
    want = plain.select("sample_id", "triple_id", "head", "relation", "tail", F.array(1 / (1 + F.exp(-F.col("logit"))), *shares).alias("features"), "label", F.lit(False).alias("is_shortest"))
    assert rows.columns == want.columns and rows.count() == want.count() and rows.exceptAll(want).isEmpty()


def test_rows_are_cut_to_the_best_before_they_are_dealt(spark):
    rows = spark.createDataFrame([(k % 3 if k else None, k, "h" if k % 4 else "a", "r", f"t{k}", [float(k % 7), 1.0], float(k % 5 == 0), k % 11 == 0) for k in range(200)], "sample_id long, triple_id int, head string, relation string, tail string, features array<double>, label double, is_shortest boolean")
    answers = spark.createDataFrame([(0, "a"), (0, "t9"), (1, "t190"), (2, None), (5, "a")], "sample_id long, answer string")
    model = Perceptron([(np.array([[1.0], [0.5]]), np.zeros(1))])
    scored = score_rows(rows.repartition(3), "features", model)
    best = ranking.best_by_score(scored, 9, "logit")
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    whole = ranking.rank_by_score(scored, "logit")
    assert sorted(map(str, best.collect())) == sorted(map(str, whole.where("rank < 9").collect()))
    want = metrics.rerank_metrics(whole, answers, (4, 9)).orderBy("k").collect()
    got = metrics.rerank_metrics(best, answers, (4, 9), metrics.rerank_totals(rows)).orderBy("k").collect()
    assert [list(r) for r in got] == [pytest.approx(list(r)) for r in want]
    for mode in metrics.TARGET_METRICS:
        assert training.by_rerank_metric(rows, answers, mode, 9, 0.3)(model) == pytest.approx(metrics.target_metric(metrics.rerank_metrics(whole, answers, (9,)), mode, 9, 0.3).first()["target"])
