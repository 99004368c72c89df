"""Buckets are joined where they lie; the edges equal their SQL."""

import math

import pytest

from loomgraph.operators import graph, joins, metrics, ranking
from loomgraph.operators.rollouts import Rollouts
from loomgraph.plans import QUERIES
from loomgraph.plans.answers import listed, ranked_rows, soft_rows
from loomgraph.sources import storage
from loomgraph.sources.views import Views


def test_edges_equal_their_sql(spark, data_dir):
    v = Views(spark, data_dir)
    own, sql = v.edges, v.view("kg_edge")
    assert own.columns == sql.columns and own.count() == sql.count() and own.exceptAll(sql).isEmpty() and sql.exceptAll(own).isEmpty()


def test_beside_equals_a_left_join(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (2, "a", 4), (None, "a", 5)], "sample_id long, head string, n int")
    table = spark.createDataFrame([(1, "a", 0.5, None), (1, None, 0.7, "x"), (None, "a", 0.9, "y"), (3, "c", 1.0, "z")], "sample_id long, head string, v double, w string")
    got = joins.beside(rows, table, "head")
    want = rows.join(table, ["sample_id", "head"], "left")
    assert sorted(map(str, got.select("n", "v", "w").collect())) == sorted(map(str, want.select("n", "v", "w").collect()))


def test_metrics_read_their_rows_once(spark):
    rows = spark.createDataFrame([(1, k, "h", "r", f"t{k}", k, float(k == 1), k == 2) for k in range(5)], "sample_id long, triple_id int, head string, relation string, tail string, rank int, label double, is_shortest boolean")
    answers = spark.createDataFrame([(1, "t2")], "sample_id long, answer string")
    few, many = (metrics.rerank_metrics(rows, answers, k)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for k in ((1,), (1, 2, 3)))
    assert few == many


def test_buckets_are_joined_where_they_lie(spark):
    rows = spark.range(200).selectExpr("id % 7 AS sample_id", "concat('n', id % 11) AS src", "id AS dst", "array(id * 0.5, 1.0) AS features")
    kept = storage.stored(rows)
    assert kept.dtypes == rows.dtypes and sorted(kept.collect()) == sorted(rows.collect()) and any(x.endswith(".parquet") for x in kept.inputFiles())
    table = storage.bucketed(rows, "sample_id", "src", parts=3)
    assert sorted(table.collect()) == sorted(rows.collect())
    few = rows.select("sample_id", "src").distinct().hint("merge")
    plan = table.join(few, ["sample_id", "src"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Bucketed: true" in plan and table.join(few, ["sample_id", "src"]).count() == 200


def test_structure_is_joined_once_an_end(spark, data_dir):
    v = Views(spark, data_dir)
    plan = graph.structural_features(v.view("kg_edge"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3
    edges = spark.createDataFrame([(1, 0, "A", "r", "A"), (1, 1, "A", "r", "B"), (1, 2, "A", "s", "B"), (1, 3, None, "s", "C")], "sample_id long, triple_id int, head string, relation string, tail string")
    got = {r["triple_id"]: r for r in graph.structural_features(edges).collect()}
    share = lambda n, most: math.log(1 + n) / math.log(1 + most)
    assert [got[1][c] for c in ("h_out", "t_out", "h_in", "t_in")] == pytest.approx([1, 0, share(1, 2), 1])
    assert [got[0]["h_mentions"], got[1]["t_mentions"], got[3]["h_out"], got[1]["pair_repeats"], got[0]["pair_repeats"]] == pytest.approx([1, share(2, 4), 0, 1, 0])


def test_pairwise_loss_makes_its_edges_once(spark, data_dir):
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [l_partkey")
    assert made(QUERIES["m9_pairwise"](spark, data_dir)) == made(Views(spark, data_dir).edges) == 1


def test_truths_make_their_candidates_once(spark, data_dir):
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [l_partkey")
    assert made(QUERIES["s4_stop_gate"](spark, data_dir)) == 1
    cands = spark.createDataFrame([(1, 2, "A", "r", "B"), (1, 1, "B", "r", "C"), (2, 1, "A", "r", "B")], "sample_id long, idx int, head string, relation string, tail string")
    gold = spark.createDataFrame([(1, "A", "r", "B"), (1, "A", "r", "B"), (2, "X", "r", "B")], "sample_id long, head string, relation string, tail string")
    got = {r["sample_id"]: ([c["idx"] for c in r["candidates"]], r["support"]) for r in listed(cands, gold).collect()}
    assert got == {1: ([1, 2], [2]), 2: ([1], None)}


def test_rollouts_make_their_samples_once(spark):
    made = spark.createDataFrame([(1, "q", [(1, "A", "r", "B")], ["A"])], "sample_id long, question string, candidates array<struct<idx:int,head:string,relation:string,tail:string>>, topics array<string>")
    run = Rollouts(made.repartition(3, "sample_id"), lambda asked, draws: ["STOP"] * len(asked))
    states = spark.createDataFrame([(1, [], 0)], "sample_id long, chosen array<int>, draw long")
    assert "RepartitionByExpression" not in run._asked(states)._jdf.queryExecution().optimizedPlan().toString()
    assert [r["done_reason"] for r in run.run().collect()] == ["stop"]


def test_rerank_metrics_read_rows_once_and_count_samples_without_rows_or_answers(spark):
    rows = [(1, "a", "r", "b", 0, 1.0, True), (1, "b", "r", "c", 1, 0.0, False), (1, "c", "r", None, 2, 0.3, False), (2, "x", "r", "y", 0, 0.0, False), (3, "u", "r", "w", 0, 0.7, False)]
    rows = spark.createDataFrame(rows, "sample_id long, head string, relation string, tail string, rank int, label double, is_shortest boolean")
    answers = spark.createDataFrame([(1, "b"), (1, "b"), (1, "c"), (1, None), (1, "z"), (3, "w"), (4, "q"), (None, "q")], "sample_id long, answer string")
    out = metrics.rerank_metrics(rows, answers, (1, 2, 9))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # rows and answers
    got = {r["k"]: [r[c] for c in ("positive_recall", "shortest_recall", "mean_label", "answer_recall", "full_cov")] for r in out.collect()}
    # answers: sample 1 has b, c, null and z; 3 has w; 4 and the null sample have no rows
    assert got[1] == pytest.approx([0.75, 1, 1.7 / 3, (1 / 4 + 1) / 4, 1 / 4])
    assert got[2] == pytest.approx([0.75, 1, (0.5 + 0.7) / 3, (2 / 4 + 1) / 4, 1 / 4])
    assert got[9] == pytest.approx([1, 1, (1.3 / 3 + 0.7) / 3, (2 / 4 + 1) / 4, 1 / 4])
    assert metrics.rerank_metrics(rows.where("false"), answers).count() == 0
    none = metrics.rerank_metrics(rows, answers.where("false"), (9,)).first()
    assert none["answer_recall"] is None and none["full_cov"] is None and none["positive_recall"] == 1


def test_reranked_triples_are_dealt_once_and_ranked_as_their_ids_rank_them(spark, data_dir):
    v = Views(spark, data_dir)
    with storage.in_place(spark):
        rows = ranked_rows(v)
        plan = metrics.rerank_metrics(rows, v.answers)._jdf.queryExecution()
        deals = [x for x in plan.executedPlan().toString().splitlines() if "Exchange hashpartitioning(sample_id" in x and "ENSURE_REQUIREMENTS" in x]
    assert plan.optimizedPlan().toString().count("RepartitionByExpression [l_partkey") == 1
    # the sets of labels and of answers are made before these are dealt; no join deals anything
    assert len(deals) == 2
    one = ["sample_id", "head", "relation", "tail", "rank", "label"]
    want = ranking.rank_by_score(soft_rows(v), "logit").select(*one)
    assert rows.count() == want.count() and rows.select(*one).exceptAll(want).isEmpty()
