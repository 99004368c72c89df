"""Hand-derived values on seven edges, topic A, answer C."""

import random
from collections import deque

import pytest
from loomgraph.operators import graph, ranking
from loomgraph.plans.flows import retrieve, trajectories, union_mapping
from loomgraph.sources import storage
from pyspark.sql import functions as F

EDGES = [(0, "A", "r1", "B", 0.9), (1, "B", "r2", "C", 0.8), (2, "A", "r3", "B", 0.8), (3, "C", "r4", "D", 0.3), (4, "D", "r5", "A", 0.2), (5, "E", "r6", "F", 0.1), (6, "B", "r2", "C", 0.7)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, *e) for e in EDGES], "sample_id long, triple_id int, head string, relation string, tail string, score double").cache()


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame([(1, "A")], "sample_id long, node string")


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(1, "C")], "sample_id long, node string")


def by_id(rows, *columns):
    return {r["triple_id"]: tuple(r[c] for c in columns) for r in rows.collect()}


def test_directional_distances(edges, topics):
    got = by_id(graph.directional_distances(edges, topics), "topic_to_head", "topic_to_tail", "head_to_topic", "tail_to_topic")
    assert got == {0: (0, 1, 0, 3), 1: (1, 2, 3, 2), 2: (0, 1, 0, 3), 3: (2, 3, 2, 1), 4: (3, 0, 1, 0), 5: (6, 6, 6, 6), 6: (1, 2, 3, 2)}


def test_hops(edges, topics):
    found = graph.distances(graph.undirected(edges), topics, 4)
    assert [by_id(graph.with_hop(edges, found), "hop")[k][0] for k in range(7)] == [1, 2, 1, 2, 1, None, 2]


def test_distances_without_depth_settle(edges, topics):
    got = {(r["node"], r["distance"]) for r in graph.distances(graph.directed(edges), topics).collect()}
    assert got == {("A", 0), ("B", 1), ("C", 2), ("D", 3)}


def test_source_outside_the_graph_has_distance_zero(spark, edges):
    lone = spark.createDataFrame([(1, "Z")], "sample_id long, node string")
    assert [(r["node"], r["distance"]) for r in graph.distances(graph.directed(edges), lone, 3).collect()] == [("Z", 0)]


def test_shortest_paths(edges, topics, answers):
    assert set(by_id(graph.shortest_path_triples(edges, topics, answers, 4))) == {0, 1, 2, 3, 4, 6}
    weak = by_id(graph.weak_labels(edges, topics, answers, 4), "label")
    assert {k for k, (x,) in weak.items() if x == 1} == {2, 3, 4, 6}
    assert graph.max_path_length(edges, topics, answers, 4).first()["max_path_length"] == 2


def test_propagation(edges, topics):
    got = {r["node"]: r for r in graph.propagate(edges, topics, 2, 1).collect()}
    assert {n: (r["f1_n"], r["f1_t"]) for n, r in got.items()} == {"A": (1, 0), "B": (0, 1), "C": (1, 0), "D": (1, 0), "E": (0, 0), "F": (1, 0)}
    assert {n: (r["f2_n"], r["f2_t"]) for n, r in got.items()} == {"A": (1, 0), "B": (1, 0), "C": (0, 1), "D": (1, 0), "E": (0, 0), "F": (0, 0)}
    assert {n: (r["b1_n"], r["b1_t"]) for n, r in got.items()} == {"A": (1, 0), "B": (1, 0), "C": (1, 0), "D": (0, 1), "E": (1, 0), "F": (0, 0)}


def test_structure(edges):
    names = ("h_out", "h_in", "t_out", "t_in", "h_mentions", "t_mentions", "relation_count", "pair_repeats")
    got = by_id(graph.structural_features(edges), *names)
    assert sorted(got[0]) == pytest.approx(sorted((1, 0.63093, 1, 1, 0.861353, 1, 0.63093, 1)), abs=1e-5)
    assert sorted(got[5]) == pytest.approx(sorted((0.63093, 0, 0, 0.63093, 0.430677, 0.430677, 0.63093, 0)), abs=1e-5)


def test_component_ratio(edges):
    assert graph.component_ratio(edges.where("triple_id in (0, 1, 5)")).first()["ratio"] == pytest.approx(0.6)
    assert graph.connectivity([]) == 0.0


def test_top_distinct(edges):
    assert set(by_id(ranking.top_distinct(edges, 3))) == {0, 1, 2}
    assert set(by_id(ranking.top_distinct(edges, 4))) == {0, 1, 2, 3}


def test_rank_share(edges):
    got = sorted((r["rank"], round(r["rank_norm"], 6)) for r in ranking.rank_share(ranking.rank_by_score(edges)).collect())
    assert [x for _, x in got] == [1, 0.833333, 0.666667, 0.5, 0.333333, 0.166667, 0]


def test_reachable_answers_falls_back_to_retained_paths(spark, edges):
    away = spark.createDataFrame([(1, "Z")], "sample_id long, node string")
    known = spark.createDataFrame([(1, "C"), (1, "X")], "sample_id long, answer string")
    retained = spark.createDataFrame([(1, "C")], "sample_id long, answer string")
    assert [r["answer"] for r in graph.reachable_answers(edges, away, known, retained).collect()] == ["C"]


def test_prefix_budget_stops_at_first_overflow(spark):
    paths = {0: "ab", 1: "", 2: "abcdef", 3: "bc", 4: "de", 5: "a"}
    rows = [(1, p, x, "r", x) for p, xs in paths.items() for x in xs]
    got = ranking.prefix_budget(spark.createDataFrame(rows, "sample_id long, path int, head string, relation string, tail string"), 3).collect()
    assert sorted(r["path"] for r in got) == [0, 3] and {r["reason"] for r in got} == {"prefix_paths_within_budget"}


def test_injection_needs_slots(spark):
    ddl = "sample_id long, idx int, head string, relation string, tail string"
    candidates = spark.createDataFrame([(1, 1, "a", "r", "b"), (1, 2, "c", "r", "d"), (2, 1, "a", "r", "b")], ddl)
    gold = spark.createDataFrame([(1, "c", "r", "d"), (1, "x", "r", "y"), (2, "x", "r", "y"), (2, "z", "r", "y")], "sample_id long, head string, relation string, tail string")
    got = {(r["sample_id"], r["idx"]): (r["head"], r["ok"]) for r in ranking.inject_gold(candidates, gold).collect()}
    assert got == {(1, 1): ("x", True), (1, 2): ("c", True), (2, 1): ("a", False)}


def chain(spark, n):
    ddl = "sample_id long, triple_id int, head string, relation string, tail string, score double"
    return spark.createDataFrame([(1, k, f"N{k}", "r", f"N{k + 1}", 1 - k / 100) for k in range(n)], ddl), *[spark.createDataFrame([(1, x)], "sample_id long, node string") for x in ("N0", f"N{n}")]


def test_paths_have_no_depth_of_their_own(spark):
    edges, start, end = chain(spark, 6)
    found = graph.path_edges(edges, spark.createDataFrame([(1, "N0", "N6")], "sample_id long, source string, target string"))
    assert {(r["head"], r["length"]) for r in found.collect()} == {(f"N{k}", 6) for k in range(6)}
    assert graph.max_path_length(edges, start, end).first()["max_path_length"] == 6
    assert {r["label"] for r in graph.weak_labels(edges, start, end).collect()} == {1.0}
    assert set(by_id(graph.shortest_path_triples(edges, start, end))) == set(range(6))
    assert by_id(retrieve(edges, start), "hop") == {k: (k + 1,) for k in range(6)}


def test_closure_has_no_depth_of_its_own(spark):
    edges, start, end = chain(spark, 18)
    answers = end.withColumnRenamed("node", "answer")
    assert [r["answer"] for r in graph.reachable_answers(edges, start, answers, answers.where("false")).collect()] == ["N18"]


def test_trajectories_keep_answers_far_from_the_topic(spark):
    rows = [(1, k, f"N{k}", "r", f"N{k + 1}") for k in range(9)]
    edges = spark.createDataFrame(rows, "sample_id long, triple_id int, head string, relation string, tail string")
    paths = edges.select("sample_id", F.lit(0).alias("path"), F.col("triple_id").alias("place"), "head", "relation", "tail")
    start, answers = spark.createDataFrame([(1, "N0")], "sample_id long, node string"), spark.createDataFrame([(1, "N9")], "sample_id long, answer string")
    assert trajectories(edges, paths, answers, start).first()["answers"] == ["N9"]


def test_many_sources_of_one_sample(spark):
    """More sources than a number holds: every distance of every source, against a search from each."""
    rnd = random.Random(4)
    pairs = {(rnd.randrange(90), rnd.randrange(90)) for _ in range(160)}
    links = spark.createDataFrame([(s, f"n{a}", f"n{b}") for s in (1, 2) for a, b in pairs if s == 1 or a % 2], "sample_id long, src string, dst string")
    sources = spark.createDataFrame([(s, f"n{k}") for s in (1, 2) for k in range(0, 90, s)] + [(2, None), (3, "alone")], "sample_id long, node string")
    got = {(r["sample_id"], r["source"], r["node"]): r["distance"] for r in graph.distances(links, sources, by_source=True).collect()}
    want = {(3, "alone", "alone"): 0}
    for s in (1, 2):
        ahead = {}
        for a, b in pairs:
            if s == 1 or a % 2:
                ahead.setdefault(a, []).append(b)
        for k in range(0, 90, s):
            far, queue = {k: 0}, deque([k])
            while queue:
                x = queue.popleft()
                for y in ahead.get(x, ()):
                    if y not in far:
                        far[y] = far[x] + 1
                        queue.append(y)
            want |= {(s, f"n{k}", f"n{y}"): d for y, d in far.items()}
    assert got == want
    capped = {k: r for k, r in want.items() if r <= 2}
    assert {(r["sample_id"], r["source"], r["node"]): r["distance"] for r in graph.distances(links, sources, 2, by_source=True).collect()} == capped


def test_a_long_chain_and_a_round_of_constant_size(spark, tmp_path):
    n = 60
    edges = spark.createDataFrame([(1, f"c{k:03}", "r", f"c{k + 1:03}", k) for k in range(n)], "sample_id long, head string, relation string, tail string, triple_id int")
    topic = spark.createDataFrame([(1, "c000")], "sample_id long, node string")
    got = {r["node"]: r["distance"] for r in graph.distances(graph.directed(edges), topic).collect()}
    assert got == {f"c{k:03}": k for k in range(n + 1)}
    plans = []
    for parts in (2, 2 * graph.COMPACT):
        rows = spark.createDataFrame([(1, 0, "c000", 1, 0)], "sample_id long, word int, node string, bits long, distance int")
        paths = [storage.write_part(rows, f"{tmp_path}/p{parts}", k) for k in range(parts)]
        plan = graph.reached(rows.drop("distance"), graph.directed(edges), spark.read.parquet(*paths), ["sample_id"])._jdf.queryExecution().executedPlan().toString()
        plans.append((plan.count("Join"), plan.count("HashAggregate"), plan.count("FileScan")))
    assert plans[0] == plans[1] and plans[0][0] == 2


def test_components_of_all_samples_together(spark):
    rows = [(1, "a", "b"), (1, "c", "b"), (1, "d", "e"), (1, "f", "f"), (2, "a", "z"), (2, "z", "y"), (3, None, "q")]
    table = spark.createDataFrame(rows, "sample_id long, head string, tail string")
    got = {(r["sample_id"], r["node"]): r["component"] for r in graph.components(table).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (1, "e"): "d", (1, "f"): "f", (2, "a"): "a", (2, "z"): "a", (2, "y"): "a"}
    assert {r["sample_id"]: r["ratio"] for r in graph.component_ratio(table).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    # a star, a long path and a ring, of one sample
    wide = spark.range(20_000).selectExpr("1L AS sample_id", "concat('n', if(id < 8000, 0, id)) AS head", "concat('n', if(id < 19000, id + 1, 8000)) AS tail")
    ratio = graph.component_ratio(wide).first()["ratio"]
    pairs = [(r["head"], r["tail"]) for r in wide.collect()]
    assert ratio == pytest.approx(graph.connectivity(pairs)) and "Python" not in graph.components(table)._jdf.queryExecution().executedPlan().toString()


def test_union_mapping_says_why_a_sample_is_left_out(spark):
    rows = [(s, k, f"h{k}", "r", f"t{k}") for s in range(1, 7) for k in range(4)]
    edges = spark.createDataFrame(rows, "sample_id long, triple_id int, head string, relation string, tail string")
    # 1: one triple is not among the candidates; 2: no paths; 3: one path, too long; 4: too few slots; 5: a triple twice in a path; 6: the second path overflows
    told = {1: [["h1", "t1"], ["z", "t9"]], 3: [[f"x{k}" for k in range(8)]], 4: [["q1", "q2", "q3", "q4", "q5"]], 5: [["h0", "h0"]], 6: [["h3", "h2"], ["a", "b", "c", "d", "e"], ["h1"]]}
    paths = [(s, p, place, h, "r", h.replace("h", "t")) for s, own in told.items() for p, heads in enumerate(own) for place, h in enumerate(heads)]
    table = spark.createDataFrame(paths, "sample_id long, path int, place int, head string, relation string, tail string")
    topics = spark.createDataFrame([(s, "h3") for s in range(1, 7)], "sample_id long, node string")
    answers = spark.createDataFrame([(s, "t3") for s in range(1, 7)], "sample_id long, answer string")
    got = {r["sample_id"]: r for r in union_mapping(edges, table, answers, topics, k=4, budget=6).collect()}
    reasons = {k: r["reason"] for k, r in got.items()}
    assert reasons == {1: None, 2: "empty_gold_union", 3: "no_prefix_fits_within_budget", 4: "insufficient_non_gold_slots_for_replacement", 5: "path_triple_mapping_failed:path_index=0", 6: None}
    assert got[1]["gold_indices"] == [1, 2, 3, 4] and [tuple(p) for p in got[1]["per_path"]] == [(0, [2, 1]), (1, [4, 3])]
    assert got[6]["budget_reason"] == "prefix_paths_within_budget" and [tuple(p) for p in got[6]["per_path"]] == [(0, [4, 3])] and got[6]["answers"] == ["t3"]
    assert got[5]["gold_indices"] is None and not got[5]["valid"]


def test_ways_are_searched_back_from_their_ends(spark, monkeypatch):
    """Random graphs against brute force; links are stored once, and no search leaves what leads to an end."""
    rng, rows, asked, wanted = random.Random(3), [], [], []
    for k in range(6):
        pairs = [(f"N{rng.randrange(9)}", f"N{rng.randrange(9)}") for _ in range(14)] + [(f"X{j}", f"X{j + 1}") for j in range(40)]
        rows += [(k, n, h, "r", t) for n, (h, t) in enumerate(pairs)]
        asked += [(k, f"N{n}") for n in (0, 1)] + [(k, "lone")]
        wanted += [(k, f"N{n}") for n in (1, 2, 3)] + [(k, "lone")]
    edges = spark.createDataFrame(rows, "sample_id long, triple_id int, head string, relation string, tail string")
    topics, answers = (spark.createDataFrame(x, "sample_id long, node string") for x in (asked, wanted))
    inf, every, last, longest = 99, set(), set(), {}
    for k in range(6):
        own = [r for r in rows if r[0] == k]
        nodes = sorted({e for r in own for e in (r[2], r[4])})
        d = {(a, b): 0 if a == b else inf for a in nodes for b in nodes}
        for _ in nodes:
            for _, _, h, _, t in own:
                for a in nodes:
                    d[a, t] = min(d[a, t], d[a, h] + 1)
        for q in (n for s, n in asked if s == k and n in nodes):
            for a in (n for s, n in wanted if s == k and n in nodes):
                best = min(d[q, a], d[a, q])
                if best == inf:
                    continue
                longest[k] = max(longest.get(k, 0), best)
                for u, v in ((q, a), (a, q)):
                    if d[u, v] == best:
                        on = [(h, t, n) for _, n, h, _, t in own if d[u, h] + 1 + d[t, v] == best]
                        every |= {(k, n) for _, _, n in on}
                        last |= {(k, max(n for h, t, n in on if (h, t) == e)) for e in {(h, t) for h, t, _ in on}}
    stored, real = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, *keys, parts=None: stored.append(df.count()) or real(df, *keys, parts=parts))
    ids = lambda df: {(r["sample_id"], r["triple_id"]) for r in df.collect()}
    assert ids(graph.shortest_path_triples(edges, topics, answers)) == every
    assert stored[0] == len(rows) and stored[1] <= 4 * len([r for r in rows if r[2].startswith("N")])
    assert ids(graph.weak_labels(edges, topics, answers, zeros=False)) == last == ids(graph.weak_labels(edges, topics, answers).where("label = 1"))
    assert {r["sample_id"]: r["max_path_length"] for r in graph.max_path_length(edges, topics, answers).collect()} == longest
