"""Text, metrics, actions, episodes and prompts on small cases."""

import re
import pytest
from loomgraph.functions import actions, scores, text
from loomgraph.operators import episodes, metrics, models, prompts
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, text.normalize(F.lit("The U.S.A., a  Test"))) == "usa test"
    assert one(spark, text.contains_normalized(F.lit("anything"), F.lit("The")))


def test_answer_lines(spark):
    assert one(spark, text.answer_lines(F.lit("ans: X\nANS: Y\nans: None\nans: not available\nans: X"))) == ["ans: X"]
    assert one(spark, text.answer_lines(F.lit(None).cast("string"))) == []


def test_years_only_where_asked(spark):
    dates = F.array(F.lit("1999-05-01"), F.lit("x-1"))
    assert one(spark, text.order_answers(dates, F.lit("When?"))) == ["1999", "x-1"]
    assert one(spark, text.order_answers(dates, F.lit("Who?"))) == ["1999-05-01", "x-1"]


def test_first_nonempty_treats_empty_like_null(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, text.first_nonempty(F.lit(None).cast("array<string>"), empty, F.array(F.lit("a")))) == ["a"]


def test_format_reward(spark):
    for body, want in (("", 0.0), ("```ans: x```", 0.0), ("ans: x because", 0.2), ("ans: x", 1.0), ("\n".join(f"ans: {i}" for i in range(3)), 0.8), ("\n".join(f"ans: {i}" for i in range(6)), 0.4)):
        assert one(spark, text.format_reward(F.lit(body), text.answer_lines(F.lit(body)))) == want


def plain(text):
    words = re.sub(r"[^\w\s]", "", text.lower()).split()
    return " ".join(w for w in words if w not in ("a", "an", "the"))


def greedy(lines, answers, double):
    """Lines that are taken: answer by answer the first free column of its row in the matrix of matches, longest lines first."""
    lines = sorted(lines, key=lambda x: -len(x))
    tails = [plain(p.rpartition("ans:")[2]) for p in lines]
    fits = [[plain(a) in plain(p) or double and (t in plain(a) or plain(p) in plain(a)) for p, t in zip(lines, tails, strict=True)] for a in answers]
    taken = set()
    for row in fits:
        taken |= set([k for k, fit in enumerate(row) if fit and k not in taken][:1])
    return len(taken)


@pytest.mark.parametrize("double", [False, True])
def test_greedy_matches_plain_python(spark, double):
    import random

    rnd, cases = random.Random(3), []
    for _ in range(60):
        words = lambda: " ".join(rnd.choice(["red", "car", "the", "old", "a"]) for _ in range(rnd.randint(1, 3)))  # noqa: B023, E731
        cases.append((list(dict.fromkeys("ans: " + words() for _ in range(rnd.randint(0, 4)))), [words() for _ in range(rnd.randint(0, 4))]))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, lines array<string>, answers array<string>")
    got = {r["i"]: r["n"] for r in rows.select("i", metrics.greedy_matches(F.col("lines"), F.col("answers"), F.lit(double)).alias("n")).collect()}
    assert got == {i: greedy(a, b, double) for i, (a, b) in enumerate(cases)}


def test_hallucination(spark):
    def score(lines, answerable, none=False, entities=("Paris",)):
        h = metrics.hallucination(F.array(*map(F.lit, lines)).cast("array<string>"), F.array(F.lit("paris")), F.lit(False), F.lit(answerable), F.lit(none), F.array(*map(F.lit, entities)))
        return one(spark, h)

    good = score(["ans: Paris", "ans: Rome"], True)
    assert (good["score"], good["g_c"], good["g_w"], good["g_c_in_graph"], good["g_w_out_graph"]) == (0.0, 1, 1, 1, 1)
    bad = score(["ans: Paris", "ans: Rome"], False)
    assert (bad["score"], bad["b_in_graph"], bad["b_out_graph_w"]) == (-1.25, 1, 1)
    assert score([], False, none=True)["score"] == 1.0 and score([], True, none=True)["score"] == 0.0


TRUTH = episodes.Truth({1: ("A", "r1", "B"), 2: ("B", "r2", "C"), 3: ("E", "r6", "F")}, "A", ("C",), frozenset({1, 2}))


def test_replay():
    steps, summary = episodes.replay(TRUTH, [1, 2, "STOP"])
    assert [s[2] for s in steps] == pytest.approx([1.0, 1.435365, 1.1], abs=1e-6)
    assert summary["stop_seen"] and summary["stop_reward"] == pytest.approx(1.1)
    final = 0.8 + 0.05 * (1 + 1.1 + summary["step_reward_sum"] + 1)
    assert final == pytest.approx(1.076768, abs=1e-6)


def test_disconnected_triples_stay_selected():
    steps, summary = episodes.replay(TRUTH, [1, 3, 2, "STOP"])
    assert [s[2] for s in steps] == pytest.approx([1.0, -1.5, 1.1475, 1.06], abs=1e-6)
    assert summary["selected"] == [1, 3, 2] and summary["allowed"]


def test_invalid_and_duplicate_actions():
    steps, _ = episodes.replay(TRUTH, [9, 1, 1])
    assert [(s[2], s[3]) for s in steps] == [(-2.0, "invalid_action"), (1.0, "support_gain"), (-2.0, "duplicate_action")]


def test_machine():
    assert episodes.run_machine(TRUTH, [1, 1, 1], max_stalled=2)["done_reason"] == "stalled_after_duplicate"
    assert episodes.run_machine(TRUTH, [None])["done_reason"] == "parse_none"
    assert episodes.run_machine(TRUTH, [7])["done_reason"] == "invalid_action"
    assert episodes.run_machine(TRUTH, [1, "STOP"])["lines"] == ["1", "STOP"]
    assert episodes.run_machine(TRUTH, [1])["done_reason"] == "max_steps"


def test_final_reward_without_service(spark):
    x = [F.lit(v) for v in (1.0, 0.5, 1.0, 2.0, 1.0)]
    assert one(spark, episodes.final_reward(*x, F.lit(False))) == pytest.approx(0.05 * 3.5)


def test_actions():
    trace = lambda s: [(p.action, p.source) for p in actions.action_trace(s)[0]]
    assert trace('{"action": 3}\n{"action": "ADD_TRIPLE", "triple_id": "4"}\nSTOP') == [(3, "json_action"), (4, "json_action_sft"), ("STOP", "token_fallback")]
    assert trace('assistant\n{"action": 3}\nuser\n{"action": 5}\nassistant\nI take 7 now') == [(3, "json_action"), (7, "token_fallback")]
    assert trace('{"observation": 12}') == [(12, "token_fallback")]  # nothing else: tokens of the whole text
    assert trace('<think>1</think>{"action": true, "x": 1}\n2') == [(2, "token_fallback")]
    assert trace('so {"action": 3} it is') == [(3, "json_action_fallback")]
    assert actions.accepted_history('x {"accepted_action_history": [1]} {"accepted_action_history": [1, 2]}') == [1, 2]
    assert actions.solution_text(None, "abc") == "abc" and actions.solution_text("assistant\n1", "abc") == "assistant\n1"


def test_agent_action():
    known = {1: ("A", "r", "B"), 2: ("B", "s", "C")}
    for said, want in (("[2] (B, s, C)", 2), ("STOP", "STOP"), ('{"action":"ADD_TRIPLE","triple":"1|A|r|B"}', 1), ('{"action":"ADD_TRIPLE","triple_id":77}', "STOP"), ("maybe 2", 2), ("none", None)):
        assert actions.agent_action(said, known) == want


def test_limits(spark):
    soft, hard = scores.triple_limits(F.lit("cwq"), F.lit(30), F.lit(40), F.lit(95))
    assert (one(spark, soft), one(spark, hard)) == (36, 54)
    a, b = scores.resolved_caps(F.lit("cwq"), F.lit(None).cast("int"), F.lit(9))
    assert (one(spark, a), one(spark, b)) == (14, 32)


def test_modes():
    assert prompts.Mode.parse("scored_100_rev_firstq") == prompts.Mode("scored", 100, reverse=True, question_first=True)
    with pytest.raises(ValueError, match="unknown prompt mode"):
        prompts.Mode.parse("other_3")


def test_two_pass_generation_and_retry(spark):
    tries = []

    def flaky(batch):
        tries.append(1)
        if len(tries) < 3:
            raise prompts.TransientError
        return ["ans: x"] * len(batch)

    waits = []
    assert prompts.with_retry(flaky, sleep=waits.append)(["a"]) == ["ans: x"] and waits == [5.0, 10.0]
    rows = spark.createDataFrame([(1, "(a,b,c)"), (2, "nothing"), (3, "(a,b,c)")], "sample_id int, prompt string")
    got = {r["sample_id"]: r["prediction"] for r in prompts.generate_twice(rows, "prompt", prompts.echo_generator).collect()}
    assert got == {1: "ans: c", 2: "ans: not available", 3: "ans: c"}


def test_scorer_checks_its_width(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id int, f array<double>")
    assert models.score_rows(rows, "f", models.Perceptron.seeded((2, 3, 1))).count() == 1
    with pytest.raises(Exception, match="must be 4 wide"):
        models.score_rows(rows, "f", models.Perceptron.seeded((4, 1))).collect()


def test_bad_sample_rules(spark):
    log = spark.createDataFrame([("a", "", i, i, 0.0, "no_selection", "q") for i in range(3)] + [("b", "", 9, 1, 1.0, "ok", "q"), ("", "", 10, 1, 0.0, "ok", "q")], "sample_id string, trajectory_id string, line_no int, step int, f1 double, diagnosis string, question string")
    per = metrics.by_sample(log)
    assert [r["sample_id"] for r in metrics.bad_samples(per, "all_rollouts_zero").collect()] == ["a"]
    assert metrics.bad_samples(per, "all_rollouts_zero", diagnoses=("ok",)).count() == 0
    with pytest.raises(ValueError, match="unknown rule"):
        metrics.bad_samples(per, "other")


def test_generator_is_asked_once_a_prompt(spark, tmp_path):
    def counting(batch):
        for p in batch:
            with open(tmp_path / "asked", "a") as f:
                f.write(f"{p!r}\n")
        return prompts.echo_generator(batch)

    rows = spark.createDataFrame([(1, "Triplets:\n(a,r,b)"), (2, "nothing"), (3, "nothing")], "sample_id long, prompt string")
    out = prompts.generate_twice(rows, "prompt", counting)
    assert len(out.collect()) == 3
    assert sorted((tmp_path / "asked").read_text().splitlines()) == sorted([repr("Triplets:\n(a,r,b)"), repr("nothing"), repr("nothing\n\nans: not available\n\nGive your best answer.")])
