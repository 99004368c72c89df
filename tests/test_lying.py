"""Tables that lie by sample are joined by sample and node where they lie."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, models, prompts, ranking
from loomgraph.plans import QUERIES
from loomgraph.plans.flows import path_trajectories, retrieve
from loomgraph.sources import storage


def moved(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_tables_that_lie_are_joined_without_a_shuffle(spark):
    rows = spark.range(300).selectExpr("id % 7 AS sample_id", "concat('n', id % 11) AS node", "id AS n")
    one, name = storage.laid(rows.repartition(3, "sample_id"), "sample_id", 3)
    two, _ = storage.laid(rows.where("n < 50").repartition(3, "sample_id"), "sample_id", 3)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with storage.in_place(spark):
        met = one.join(two.select("sample_id", "node").hint("merge"), ["sample_id", "node"], "left_semi")
        assert moved(met) == moved(met.distinct()) == 0 and met.count() == sum(k % 77 < 50 for k in range(300))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    grown, _ = storage.laid(one.where("n < 10"), "sample_id", 3, onto=name)
    assert grown.count() == 310


def test_distances_in_place_equal_distances(spark):
    draw = random.Random(3)
    edges = spark.createDataFrame([(s, k, f"N{draw.randrange(40)}", "r", f"N{draw.randrange(40)}") for s in range(9) for k in range(60)], "sample_id long, triple_id int, head string, relation string, tail string")
    topics = spark.createDataFrame([(s, n) for s in range(9) for n in ("N0", "N1", None)] + [(77, "N0")], "sample_id long, node string")
    lying, starts = edges.repartition(5, "sample_id"), topics.repartition(5, "sample_id")
    for depth in (None, 2, 0):
        for links in (graph.undirected, lambda e: graph.both_ways(graph.directed(e))):
            got, want = graph.distances_in_place(links(lying), starts, 5, depth), graph.distances(links(edges), topics, depth)
            assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    ends = ["topic_to_head", "topic_to_tail", "head_to_topic", "tail_to_topic"]
    got, want = (rows.select("sample_id", "triple_id", *ends) for rows in (graph.directional_distances(lying, starts, parts=5, lies=True), graph.directional_distances(edges, topics)))
    assert sorted(got.collect()) == sorted(want.collect())
    scored = edges.selectExpr("*", "1 / (1 + triple_id) AS score")
    got, want = retrieve(scored.repartition(5, "sample_id"), starts, 30, parts=5), retrieve(scored, topics, 30)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["d3_d4_hops", "d8_directions", "m11_retrieval"])
def test_edges_are_made_once(spark, data_dir, name):
    out = QUERIES[name](spark, data_dir)
    assert moved(out) == 0 and out.count() > 0


def test_path_trajectories_in_place_equal_those_elsewhere(spark):
    ddl = "sample_id long, triple_id int, head string, relation string, tail string"
    edges = spark.createDataFrame([(s, k, f"H{k % 5}", "r", f"T{k % 4}") for s in range(6) for k in range(14)] + [(6, 0, "x", "r", "y")], ddl)
    # samples 1 and 3 lack a triple that is written over a slot, 6 has too few slots, 7 has no candidates
    lacking = {1: ("N", "r", "M"), 3: ("N", "r", "L")}
    rows = [(s, p, place, *triple) for s in range(6) for p, triples in enumerate(([("H0", "r", "T0"), ("H1", "r", "T1")], [lacking.get(s, ("H2", "r", "T2")), ("H0", "r", "T0")])) for place, triple in enumerate(triples)]
    rows += [(6, 0, 0, "a", "r", "b"), (6, 0, 1, "c", "r", "d"), (7, 0, 0, "a", "r", "b")]
    paths = spark.createDataFrame(rows, "sample_id long, path int, place int, head string, relation string, tail string")
    got, want = path_trajectories(edges.repartition(3, "sample_id"), paths.repartition(3, "sample_id"), 8, 10, parts=3), path_trajectories(edges, paths, 8, 10)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("sample_id in (1, 3)").count() == 4 and got.where("sample_id > 5").isEmpty()


def test_sample_in_place_equals_the_sample_elsewhere(spark):
    rows = spark.createDataFrame([(s, k, f"H{k}", "r", f"T{k % 6}") for s in range(5) for k in range(30)], "sample_id long, triple_id int, head string, relation string, tail string")
    without = spark.createDataFrame([(s, f"{s}") for s in range(5)], "sample_id long, answer string")
    lying, _ = storage.laid(rows.repartition(3, "sample_id"), "sample_id", 3)
    with storage.in_place(spark):
        out = ranking.seeded_sample(lying, 7, 1, without=without, parts=3)
        assert moved(out) == 0
        got = sorted(out.select(*rows.columns, "place").collect())
    assert got == sorted(ranking.seeded_sample(rows, 7, 1, without=without).select(*rows.columns, "place").collect()) and len(got) == 35


def test_listwise_loss_has_no_pass_over_a_sample(spark):
    rows = spark.createDataFrame([(1, 0, "a", "b", 0.5, 1.0), (1, 1, "b", "c", -1.0, 0.0), (1, 2, "c", "a", 0.5, 1.0), (1, 3, "c", "d", 2.0, 0.0), (2, 0, "a", "b", 1.0, 0.0)], "sample_id long, triple_id int, head string, tail string, logit double, touch double")
    answers = spark.createDataFrame([(1, "a"), (2, "z")], "sample_id long, answer string")
    out = models.listwise_surrogate(rows, answers, 2)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    x = [0.5, -1.0, 0.5, 2.0]
    s = lambda v: 1 / (1 + math.exp(-v))
    p = [s(2.5 - 1 - sum(s(a - b) for b in x)) for a in x]
    edge = -(math.log(p[0]) + math.log(p[2]) + math.log(1 - p[1]) + math.log(1 - p[3])) / 4  # two rows touch and two don't: weight 1
    cover = -math.log(1 - (1 - p[0]) * (1 - p[2]))
    got = {r["sample_id"]: r["loss"] for r in out.collect()}
    assert got == pytest.approx({1: edge + 0.5 * cover, 2: 0.0})


def test_generation_makes_its_prompts_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = spark.range(6).select("id", F.udf(seen)(F.concat(F.lit("p"), (F.col("id") % 2).cast("string"))).alias("q"))
    got = prompts.generate_twice(rows, "q", prompts.echo_generator)
    assert got.count() == 6 and made.value == 6


@pytest.mark.parametrize("name", ["g9_path_trajectories", "g8_random_sample", "m8_listwise"])
def test_rows_of_a_sample_are_joined_where_they_lie(spark, data_dir, name):
    out = QUERIES[name](spark, data_dir)
    assert moved(out) == 0 and out.count() > 0
