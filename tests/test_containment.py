"""Containment joins, line numbers and the action table function against plain loops."""

import os
import random

import pytest
from loomgraph.functions import actions
from loomgraph.operators import containment, ranking
from loomgraph.sources import readers
from pyspark.sql import functions as F


def nested(texts, patterns):
    known = {}
    for k, p in patterns:
        if p is not None:
            known.setdefault(k, set()).add(p)
    return sorted((k, i, p) for k, i, t in texts if t is not None for p in known.get(k, ()) if p in t)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc é") for _ in range(n))
    texts = [(rnd.randrange(6), i, word(rnd.randrange(0, 40))) for i in range(300)] + [(1, 900, None), (7, 901, "alone"), (2, 902, "x" * 5000 + "needle")]
    patterns = [(rnd.randrange(5), word(rnd.randrange(1, 5))) for _ in range(200)] + [(1, None), (2, "needle"), (3, ""), (8, "none")]
    return [*texts, texts[0]], patterns


@pytest.fixture(scope="module")
def tables(spark, case):
    return spark.createDataFrame(case[0], "k int, id long, text string"), spark.createDataFrame(case[1], "k int, pattern string")


@pytest.mark.parametrize("sizes", [(20_000, 100_000), (3, 7), (1, 1)])
def test_contained_equals_nested_loops(tables, case, sizes):
    got = sorted(map(tuple, containment.contained(*tables, ["k"], *sizes).collect()))
    want = nested(*case)
    assert got == want and len(want) > 1000
    some = sorted(map(tuple, containment.contained(*tables, ["k"], *sizes, pairs=False).collect()))
    assert some == sorted({(k, i) for k, i, _ in want})


def test_ten_thousand_patterns_of_one_key(spark):
    patterns = spark.range(10_000).selectExpr("'s' AS k", "concat('entity ', id, ';') AS pattern")
    texts = spark.range(300).selectExpr("'s' AS k", "id", "concat('of ', 'entity ', id * 7, '; and entity ', id * 11 + 5000, '; or entity ', id) AS text")
    got = sorted(map(tuple, containment.contained(texts, patterns, ["k"], block=4000, deal=100).select("id", "pattern").collect()))
    want = sorted({(i, f"entity {n};") for i in range(300) for n in (i * 7, i * 11 + 5000) if n < 10_000})
    assert got == want


def test_members_and_samples_without_answers(spark):
    lines = spark.createDataFrame([(1, 1, "ans: Paris France", "paris france"), (1, 2, "ans: Lond", "lond"), (1, 3, "ans: Rome", "rome"), (2, 1, "x", None)], "k int, id int, line string, answer string")
    entities = spark.createDataFrame([(1, "PARIS"), (1, "London"), (2, None)], "k int, entity string")
    assert sorted(map(tuple, containment.fuzzy_members(lines, entities, ["k"]).collect())) == [(1, 1), (1, 2)]
    triples = spark.createDataFrame([(1, "the Paris", "r", "b", 0), (1, "a", "r", "Rome", 1), (1, "c", "r", "d", 2), (2, "Paris", "r", "x", 0)], "sample_id long, head string, relation string, tail string, triple_id int")
    answers = spark.createDataFrame([(1, "Paris"), (1, "Rome"), (1, None)], "sample_id long, answer string")
    kept = ranking.seeded_sample(triples, 9, 1, without=answers)
    assert sorted((r["sample_id"], r["triple_id"]) for r in kept.collect()) == [(1, 2), (2, 0)]


def test_line_numbers_over_splits(spark, tmp_path):
    rnd = random.Random(2)
    files = {"a.txt": ["", "x" * 9000, "", *[f"line {k} " + "y" * rnd.randrange(300) for k in range(400)]], "b.txt": [""] * 7, "c.txt": [f"ü{k}" for k in range(900)], "d.txt": []}
    folder = tmp_path / "log"
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + ("\n" if lines and name != "a.txt" else ""), encoding="utf-8")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            spark.conf.set(c, "3000")
        rows = readers.numbered_lines(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        got = {(os.path.basename(r["file"]), r["line_no"]): (r["line"], r["folder_line_no"]) for r in rows.collect()}
        batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # splits over many batches
        again = {(os.path.basename(r["file"]), r["line_no"]): (r["line"], r["folder_line_no"]) for r in rows.collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    want, total = {}, 0
    for name in sorted(files):
        with open(folder / name, encoding="utf-8") as f:
            for n, line in enumerate(f, start=1):
                total += 1
                want[name, n] = (line.rstrip("\n"), total)
    assert got == want == again


def test_log_records_are_cut_by_steps(spark, tmp_path):
    spark.range(50).selectExpr("id AS v").coalesce(1).write.json(f"{tmp_path}/l")
    got = [(r["line_no"], r["step"], r["record"]["v"]) for r in readers.log_records(spark, f"{tmp_path}/l", "v long", 8, 2, 3).orderBy("line_no").collect()]
    assert got == [(k + 1, k // 8, k) for k in range(16, 32)]


def test_actions_as_a_table_function(spark):
    rows = spark.createDataFrame([(1, 'assistant\n{"action":"ADD_TRIPLE","triple_id":4}\nuser\n9\nassistant\nSTOP'), (2, "7 then STOP"), (3, "nothing"), (4, None)], "id int, text string")
    want = [(1, 0, "ADD_TRIPLE", 4, True), (1, 1, "STOP", None, True), (2, 0, "ADD_TRIPLE", 7, False)]
    key = lambda r: tuple(r[c] for c in ("id", "place", "action", "triple_id", "dialogue"))
    assert sorted(map(key, actions.action_rows(rows, "text").collect()), key=str) == want
    actions.register_functions(spark)
    got = spark.sql("SELECT * FROM {rows} r, LATERAL action_trace(r.text, 256)", rows=rows).collect()
    assert sorted(map(key, got), key=str) == want
    assert spark.sql("SELECT place FROM action_trace('1\\n2\\n3', 2)").count() == 2
