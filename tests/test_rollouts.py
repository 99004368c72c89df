"""Rollouts against a one-by-one Python run, memo and resumption; prompts and observations against plain forms; labels."""

import hashlib
import itertools
import json

import pytest
from loomgraph.functions.actions import agent_action
from loomgraph.operators import episodes, joins, prompts, rollouts
from pyspark.sql import functions as F

SAMPLES = {
    1: ("who", {1: ("a", "r", "b"), 2: ("b", "s", "c"), 3: ("a", "t", 'd "q" \\ é')}, ["a"]),
    2: ("what?", {k: (f"h{k}", "r", f"t{k}") for k in range(1, 9)}, []),
    3: ("  ", {1: ("x", "r", "y")}, ["y", "x"]),
    4: ("none", {}, ["z"]),
}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, q, [(i, *t) for i, t in c.items()], topics) for k, (q, c, topics) in SAMPLES.items()]
    return spark.createDataFrame(rows, "sample_id long, question string, candidates array<struct<idx:int,head:string,relation:string,tail:string>>, topics array<string>")


def plain_prompt(question, candidates, selected, topics):
    line = lambda i: "|".join([str(i), *candidates[i]])
    asked = question.strip() + ("" if not question.strip() or question.strip().endswith("?") else "?")
    nodes = sorted({*topics, *(candidates[i][e] for i in selected for e in (0, 2))})
    state = {"selected_triples": [line(i) for i in sorted(selected)], "current_nodes": nodes}
    rest = [line(i) for i in candidates if i not in selected]
    return "\n".join(["Candidate Triples:", *(rest or ["(none)"]), "", "Question:", asked, "", "state:", json.dumps(state, ensure_ascii=False), "", "Action Rules:", "- Do not repeat triples", f"- {prompts.STOP_RULE}"])


def whole_prompt(*state):
    return f"{prompts.AGENT_SYSTEM}\n\n{prompts.AGENT_INSTRUCTION}\n{plain_prompt(*state)}"


def reply(prompt, draw):
    """Any of many replies, by a hash."""
    h = int(hashlib.md5(f"{prompt}{draw}".encode()).hexdigest(), 16)
    n = h % 9
    return {0: "STOP", 1: "no idea", 2: f'{{"action": "ADD_TRIPLE", "triple_id": {h % 50}}}'}.get(h // 9 % 12, f"[{n}] (x" if h // 1000 % 2 else f'{{"action": "ADD_TRIPLE", "triple_id": {n}}}')


def outcome(said, max_steps, max_stalled):
    """(selected, lines, duplicates, steps, reason or None) of a whole list of actions."""
    ids = [a for a in said if isinstance(a, int)]
    again = [isinstance(a, int) and a in said[:k] for k, a in enumerate(said)]
    repeats = next((k for k, x in enumerate(reversed(again)) if not x), len(again))
    ends = {None: "parse_none", "STOP": "stop"}
    reason = ends.get(said[-1], "stalled_after_duplicate" if repeats and 0 <= max_stalled <= repeats else "max_steps" if len(said) == max_steps else None) if said else None
    selected = list(dict.fromkeys(ids))
    return selected, [*map(str, selected), *(["STOP"] if reason == "stop" else [])], sum(again), len(said), reason


def one_by_one(n_rollouts, max_steps, max_stalled, sampled):
    out, calls = {}, []
    for (key, (question, candidates, topics)), r in itertools.product(SAMPLES.items(), range(n_rollouts)):
        said, now = [], ([], [], 0, 0, None)
        while candidates and not now[-1]:
            draw = r * max_steps + len(said) if sampled else 0
            calls.append((key, tuple(sorted(now[0])), draw))
            said.append(agent_action(reply(whole_prompt(question, candidates, now[0], topics), draw), candidates))
            now = out[key, r] = outcome(said, max_steps, max_stalled)
    return out, calls


def generator(log):
    def run(asked, draws):
        with open(log, "a") as f:
            f.write("x" * len(asked))
        return [reply(p, d) for p, d in zip(asked, draws, strict=True)]

    return run


def rows_of(frame):
    return {(r["sample_id"], r["rollout"]): (r["selected"], r["lines"], r["duplicates"], r["n_steps"], r["done_reason"]) for r in frame.collect()}


@pytest.mark.parametrize("sampled", [False, True])
def test_rollouts_equal_a_run_one_by_one(samples, tmp_path, sampled):
    want, calls = one_by_one(4, 7, 2, sampled)
    log = tmp_path / "log"
    got = rows_of(rollouts.Rollouts(samples, generator(log), f"{tmp_path}/r", n_rollouts=4, max_steps=7, max_stalled=2, sampled=sampled).run())
    assert got == want and 4 not in {k for k, _ in got}
    asked = len(log.read_text())
    assert asked == len(set(calls)) and (sampled or asked < len(calls) / 3)  # a state is asked for once


def test_a_stopped_run_goes_on_and_asks_nothing_twice(samples, tmp_path):
    want, calls = one_by_one(3, 6, 8, True)
    log = tmp_path / "log"
    make = lambda: rollouts.Rollouts(samples, generator(log), f"{tmp_path}/r", n_rollouts=3, max_steps=6, sampled=True)
    part = make().run(most_rounds=2)
    assert {r["done_reason"] for r in part.where("n_steps = 2").collect()} >= {None}
    assert rows_of(make().run()) == want == rows_of(make().run())
    assert len(log.read_text()) == len(set(calls))
    steps = rollouts.selections(make().run()).where("sample_id = 2 AND rollout = 0").orderBy("step").collect()
    assert [r["idx"] for r in steps] == want[2, 0][0]


def test_prompts_and_observations(samples):
    chosen = F.when(F.col("sample_id") == 1, F.array(F.lit(3), F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows = samples.select("sample_id", prompts.selection_prompt(F.col("question"), F.col("candidates"), chosen, F.col("topics")).alias("p"), prompts.observation(F.col("question"), F.col("candidates"), chosen, F.col("topics")).alias("o")).collect()
    for r in rows:
        question, candidates, topics = SAMPLES[r["sample_id"]]
        selected = [3, 1] if r["sample_id"] == 1 else []
        assert r["p"] == plain_prompt(question, candidates, selected, topics)
        line = lambda i, c=candidates: "|".join([str(i), *c[i]])
        state = {"selected_triples": [line(i) for i in sorted(selected)], "current_nodes": sorted({*topics, *(candidates[i][e] for i in selected for e in (0, 2))})}
        want = {"question": question, "topic_entity": topics[0] if topics else "", "state": state, "candidate_triples": [line(i) for i in candidates if i not in selected], "action_rules": {"allow_stop": True, "do_not_repeat_triples": True, "stop_condition": prompts.STOP_RULE}}
        assert r["o"] == json.dumps(want, ensure_ascii=False)


def test_records_and_conversations(spark):
    one = lambda c: [tuple(m) for m in spark.range(1).select(c.alias("c")).first()["c"]]
    assert one(prompts.messages("", F.lit("u"), F.lit("a"), "do")) == [("user", "do\nu", 0.0), ("assistant", "a", 1.0)]
    assert one(prompts.messages("s", F.lit(""), F.lit("a"), "do"))[:2] == [("system", "s", 0.0), ("user", "do", 0.0)]
    assert one(prompts.conversation(F.lit("u"), "s", ("q", "a"))) == [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "u")]
    assert one(prompts.conversation(F.lit("u"), "s", ("q", "a"), "sys")) == [("system", "s"), ("user", "u")]
    assert one(prompts.conversation(F.lit("u"), "s", ("q", "a"), "icl")) == [("user", "q"), ("assistant", "a")]
    assert one(prompts.conversation(F.lit("u"))) == [("user", "u")] and one(prompts.conversation(F.lit("u"), mode="x")) == []


def test_a_scored_triple_between_the_ends_of_a_good_one_stays(spark):
    rows = [(1, "a", "r", "b", 1, 1.0, True), (1, "b", "s", "a", 2, 1.0, True), (1, "b", "t", "a", 0, 0.9, False), (1, "a", "r", "b", 1, 0.8, False), (1, "c", "r", "d", 2, 0.7, False)]
    table = spark.createDataFrame(rows, "sample_id long, head string, relation string, tail string, rank int, score double, good boolean")
    shown = prompts.render(spark.createDataFrame([(1, "q")], "sample_id long, question string"), table, "rog_5_rmht").first()["user_query"]
    assert shown == "Triplets:\n(a,r,b)\n(b,t,a)\n(c,r,d)\n\nQuestion:\nq?"


def test_only_the_first_line_is_a_numbered_choice():
    known = {1: ("A", "r", "B"), 2: ("B", "s", "C")}
    cases = {
        "Take 2 first\nSTOP": 2, '{"action":"ADD_TRIPLE","triple_id":1}\n[2] (B, s, C)': 1, "[2] (B, s, C)\nSTOP": 2, "stop\n1": "STOP", "[9] (x)\n1": 1,
        '{"action":"ADD_TRIPLE","triple_id":2.0}': 2, '{"action":"ADD_TRIPLE","triple_id":77.0}': None, "<think>[1] (</think> [2] (B": 2, "": None,
    }
    assert {k: agent_action(k, known) for k in cases} == cases


def test_events_of_actions():
    got = [episodes.event_of(a, {1: (), 2: ()}, [1]) for a in (None, "STOP", 3, 1, 2)]
    assert got == ["parse_none", "stop", "invalid_action", "duplicate", "accepted"]


def test_labels_without_a_kind_count_for_nothing_unless_bare(spark):
    triples = spark.createDataFrame([(1, "a", "r", "b"), (1, "c", "r", "d"), (1, "e", "r", "f")], "sample_id long, head string, relation string, tail string")
    labels = spark.createDataFrame([(1, "a", "r", "b", None, False), (1, "c", "r", "d", None, True), (1, "e", "r", "f", "weak_support", False), (1, "e", "r", "f", "direct_support", None), (1, None, "r", "f", "bridge", None)], "sample_id long, head string, relation string, tail string, label string, bare boolean")
    got = {r["head"]: (r["is_direct"], r["is_bridge"], r["is_weak"]) for r in joins.label_flags(triples, labels).collect()}
    assert got == {"a": (False, False, False), "c": (False, True, False), "e": (True, False, True)}
    assert {r["is_bridge"] for r in joins.label_flags(triples, labels.drop("bare")).collect()} == {False}
