"""Readers, sinks, services and streams."""

import json
import threading
import time

import pytest
from loomgraph import schema
from loomgraph.sources import readers
from loomgraph.sources import service as service_module
from loomgraph.sources.service import AnswerService
from loomgraph.streaming.episodes import call_log, episode_events
from pyspark.sql import functions as F


def test_identifiers_and_exclude_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("m.1 \n\nm.2\nm.1\n")
    assert {r["entity"] for r in readers.entity_identifiers(spark, str(tmp_path / "e.txt")).collect()} == {"m.1", "m.2"}
    (tmp_path / "x.txt").write_text("# no\n a \n\nb\n")
    assert {r["id"] for r in readers.exclude_list(spark, [str(tmp_path / "x.txt")]).collect()} == {"a", "b"}


def test_materialized_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.materialized(spark, str(tmp_path / "t"), build).count() == 3
    assert built == [1]


def test_results_fall_back_for_test_only(spark, tmp_path):
    spark.createDataFrame([], schema.RETRIEVAL_RESULT).write.parquet(str(tmp_path / "retrieval_result_test"))
    assert readers.retrieval_results(spark, str(tmp_path), "test").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.retrieval_results(spark, str(tmp_path), "train")


def test_supervision_falls_back_to_gold_then_to_nothing(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"sample_id": "s", "triplets": [{"head": "a", "relation": "r", "tail": "b", "label": "bridge"}]}) + "\n")
    assert readers.supervision(spark, str(tmp_path / "silver.json"), str(tmp_path / "gold.json")).count() == 1
    assert readers.supervision(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0


def test_gold_paths(spark, tmp_path):
    path = {"answer_entity": "C", "path_found": True, "path_triplets": [{"head": "A", "relation": "r", "tail": "B"}, {"head": "B", "relation": "s", "tail": "C"}]}
    (tmp_path / "g.json").write_text(json.dumps({"sample_id": "1", "id": "1", "question": "q", "topic_entities": ["A"], "answer_entities": ["C"], "paths": [path]}) + "\n")
    rows = readers.path_triples(readers.gold_paths(spark, str(tmp_path / "g.json"))).orderBy("place").collect()
    assert [(r["path"], r["place"], r["tail"]) for r in rows] == [(0, 0, "B"), (0, 1, "C")]
    with pytest.raises(FileNotFoundError):
        readers.gold_paths(spark, str(tmp_path / "none"))


def test_records_round_trip_and_bad_lines(spark, tmp_path):
    rows = spark.createDataFrame([("1", "wer?", ["ä"], "ans: ä")], schema.PREDICTION)
    readers.write_records(rows, str(tmp_path / "p"))
    good, bad = readers.read_records(spark, str(tmp_path / "p"), schema.PREDICTION)
    assert good.collect() == rows.collect() and bad.count() == 0
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{oops\n\n')
    good, bad = readers.read_records(spark, str(tmp_path / "b.jsonl"), schema.PREDICTION)
    assert good.count() == 1 and [r["line"] for r in bad.collect()] == ["{oops"]


def test_merged_shards_raise_on_a_repeated_id(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(3,)], "id long")
    assert readers.merged_shards([a, b]).count() == 3
    with pytest.raises(Exception, match="duplicate id 1"):
        readers.merged_shards([a, a.where("id = 1")]).collect()


def test_config():
    c = readers.RetrievalConfig.load({"task": "retriever", "silver_label": 1, "cutoffs": "5,10"})
    assert c.bridge_label == 1.0 and c.cutoffs == (5, 10)
    for bad in ({"what": 1}, {"task": "other"}, {"max_k": "many"}):
        with pytest.raises(ValueError):
            readers.RetrievalConfig.load(bad)
    assert readers.sample_limits('{"val": 0}') == {"val": 0}
    for bad in ('{"x": 1}', '{"val": -1}', '{"val": true}'):
        with pytest.raises(ValueError):
            readers.sample_limits(bad)


def service(spark, folder, log, **other):
    def ask(request):
        with open(log, "a") as f:
            f.write(f"{request['q']} {threading.active_count()}\n")
        if request["q"].startswith("slow"):
            time.sleep(20)
        if request["q"] == "bad" or request["q"] == "shy" and open(log).read().count("shy") < 3:
            raise RuntimeError("down")
        return {"answer": request["q"].upper()}

    return AnswerService(spark, ask, f"{folder}/service", **other)


def said(rows):
    return {r["id"]: (r["ok"], r["cached"], r["response"] and json.loads(r["response"])["answer"], r["error"]) for r in rows.collect()}


def test_answer_service_asks_equal_requests_once_and_keeps_answers(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"q":"a"}'), (2, '{"q":"a"}'), (3, '{"q":"bad"}'), (4, None)], "id int, payload string")
    log = tmp_path / "log"
    log.touch()
    first = service(spark, tmp_path, log).answer(rows)
    assert said(first) == said(first) == {1: (True, False, "A", None), 2: (True, False, "A", None), 3: (False, False, None, "down"), 4: (False, False, None, None)}
    assert sorted(x.split()[0] for x in log.read_text().splitlines()) == ["a", "bad"]
    more = rows.unionByName(spark.createDataFrame([(5, '{"q":"b"}')], rows.schema))
    again = service(spark, tmp_path, log)  # the memo outlives the client; only what failed or is new is asked
    assert said(again.answer(more)) == {1: (True, True, "A", None), 2: (True, True, "A", None), 3: (False, False, None, "down"), 4: (False, False, None, None), 5: (True, False, "B", None)}
    assert sorted(x.split()[0] for x in log.read_text().splitlines()) == ["a", "b", "bad", "bad"]
    assert sorted((json.loads(r["payload"])["q"], r["ok"]) for r in again.log().collect()) == [("a", True), ("b", True), ("bad", False), ("bad", False)]
    assert {r["tries"] for r in again.log().collect()} == {1} and again.log().where("seconds < 0 OR called_at IS NULL").isEmpty()


def test_slow_calls_pass_their_deadline_and_shy_ones_are_repeated(spark, tmp_path):
    log = tmp_path / "log"
    log.touch()
    rows = spark.createDataFrame([(k, json.dumps({"q": q})) for k, q in enumerate(["slow1", "slow2", "shy", *(f"x{k}" for k in range(30))])], "id int, payload string").coalesce(1)
    began = time.time()
    got = said(service(spark, tmp_path, log, timeout=2.0, at_once=3, tries=4, wait=0.01).answer(rows.coalesce(1)))
    assert time.time() - began < 18  # nobody waits for the slow ones
    assert [got[k][0] for k in range(3)] == [False, False, True] and got[0][3] == "no answer within 2.0 s" and all(got[k][0] for k in range(3, 33))
    assert max(int(x.split()[1]) for x in log.read_text().splitlines()) <= 3 + 2 + 8  # calls at once, those given up, and the worker's own threads
    with pytest.raises(ValueError, match="positive"):
        service(spark, tmp_path, log, timeout=0)


def test_calls_under_way_are_bounded():
    now, most, lock = [0], [0], threading.Lock()

    def ask(payload):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return payload

    rows = list(service_module.called(ask, iter((str(k), f'{{"k": {k}}}') for k in range(40)), 5.0, 4, 1, 0.0))
    assert {r[0] for r in rows} == {str(k) for k in range(40)} and most[0] == 4 and all(r[2] for r in rows)


def test_eval_subgraphs_and_export(spark):
    t = {"head": " A ", "relation": "r", "tail": "B", "hop": 1, "score": 0.5}
    rows = spark.createDataFrame([("1", "q", ["A"], ["A"], ["B"], ["B"], None, [], [t, dict(t, head="A")]), ("2", "q", [], [], [], [], 3, [], [])], schema.RETRIEVAL_RESULT)
    assert [r["triplets"] for r in readers.eval_subgraphs(rows, 5, True).collect()] == [[["A", "r", "B"]]]
    agent = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    graphs = spark.createDataFrame([("1", None, "", ["Z"], ["Y"]), ("x", "2", "asked", ["T"], ["U"]), ("y", "2", "later", [], []), ("4", "1", "new", ["N"], [])], "key string, id string, question string, topic_entities array<string>, answer_entities array<string>")
    got = {r["id"]: tuple(r)[1:] for r in readers.exported_results(agent, rows, graphs).collect()}
    assert got == {"1": ("q", ["A"], ["B"], 1), "2": ("asked", ["T"], ["U"], 3), "4": ("new", ["N"], [], 1)}


TRUTHS = "episode_id long, candidates array<struct<idx:int,head:string,relation:string,tail:string>>, topic string, answers array<string>, support array<int>, soft_limit int"
TURNS = "episode_id long, turn long, kind string, triple_id int"


def episode_tables(spark):
    candidates = [(1, "A", "r", "B"), (2, "B", "s", "C"), (3, "X", "s", "Y")]
    said = {1: [("ADD_TRIPLE", 1), ("INVALID", None), ("ADD_TRIPLE", 2), ("STOP", None), ("ADD_TRIPLE", 1)], 2: [("ADD_TRIPLE", 3), ("ADD_TRIPLE", 3), ("ADD_TRIPLE", 9), ("ADD_TRIPLE", 1), ("ADD_TRIPLE", 2)], 3: [("ADD_TRIPLE", 1)] * 5}
    truths = spark.createDataFrame([(e, candidates, "A", ["C"], [1, 2], 14) for e in (1, 2, 4)], TRUTHS)  # 3 has none, 4 no turns
    return spark.createDataFrame([(e, k, *t) for e, ts in said.items() for k, t in enumerate(ts)], TURNS), truths


def test_stream_of_episodes_equals_batch_with_a_restart_between(spark, tmp_path):
    rows, truths = episode_tables(spark)
    source = str(tmp_path / "in")
    stream = lambda: episode_events(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source), truths)
    for part in ((0, 1), (2,), (3, 4)):
        for k in part:  # a file, and so a micro-batch, for each turn
            rows.where(F.col("turn") == k).coalesce(1).write.mode("append").json(source)
        call_log(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)  # a new query each time, over the same state
    batch = episode_events(rows, truths)
    got = spark.read.schema(batch.schema).json(str(tmp_path / "out"))
    key = lambda r: (r["episode_id"], r["turn"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert [r["event"] for r in sorted(batch.where("episode_id = 1").collect(), key=key)] == ["accepted", "invalid", "accepted", "stop"]
    assert [r["event"] for r in sorted(batch.where("episode_id = 2").collect(), key=key)] == ["accepted", "duplicate", "invalid", "accepted", "accepted"]
    assert {r["event"] for r in batch.where("episode_id = 3").collect()} == {"invalid"}


def test_silent_episodes_end(spark, tmp_path):
    rows, truths = episode_tables(spark)
    source = str(tmp_path / "in")
    for k in range(3):
        own = rows.where(F.col("turn") == k).where("episode_id <> 2" if k else "true")
        own.coalesce(1).write.mode("append").json(source)
    stream = episode_events(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source), truths, idle=1)
    query, until, got = call_log(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=False), time.time() + 90, []
    try:  # timers run as long as the query does
        while len(got) < 2 and time.time() < until and query.isActive:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = [r for r in spark.read.schema(stream.schema).json(str(tmp_path / "out")).collect() if r["episode_id"] == 2]
    finally:
        query.stop()
    assert [(r["turn"], r["event"], r["history"], r["done"]) for r in sorted(got, key=lambda r: r["event"])] == [(0, "accepted", "3", False), (0, "idle", "3", True)]
