"""Prompt rendering, conversations and two-pass generation behind an injected generator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.sources.storage import checkpointed, stored
from loomgraph.operators import ranking

KEY = "sample_id"


@dataclass(frozen=True)
class Mode:
    """``rog_k``, ``scored_k``, ``rand_k``, ``randNoA_k`` or ``noevi``, with ``rmht``, ``rev`` and ``firstq``."""

    kind: str
    k: int = 0
    distinct_ends: bool = False
    reverse: bool = False
    question_first: bool = False
    without_answers: bool = False

    @staticmethod
    def parse(mode: str) -> Mode:
        kind = next((k for k in ("rog", "scored", "rand", "noevi") if k in mode), None)
        if kind is None:
            raise ValueError(f"unknown prompt mode {mode!r}")
        k = 0 if kind == "noevi" else int(mode.split("_")[1])
        return Mode(kind, k, kind == "rog" and "rmht" in mode, kind == "scored" and "rev" in mode, "firstq" in mode, kind == "rand" and "randNoA" in mode)


def render(samples: DataFrame, triples: DataFrame, mode: str, system: str = "", threshold: float = 0.0, seed: int = 0, answers: DataFrame | None = None) -> DataFrame:
    """(sample_id, user_query, all_query): evidence (sample_id, triple, rank, score[, good]) and question of each sample.

    good marks path triples, which come first in ``rog`` modes.
    """
    m = Mode.parse(mode)
    rows = triples
    if m.kind == "rog":
        if m.distinct_ends:  # within each list: a scored triple between the ends of a good one stays
            rows = ranking.drop_same_ends(rows, within=("good",))
        rows = rows.withColumn("rank", F.row_number().over(ranking.W.partitionBy(KEY).orderBy(F.col("good").desc(), "rank")))
    if m.kind == "scored" and threshold:
        rows = rows.where(F.col("score") >= threshold)
    if m.kind == "rand":
        rows = ranking.seeded_sample(rows.dropDuplicates([KEY, *ranking.TRIPLE]), m.k, seed, "rank", answers if m.without_answers else None).withColumn("rank", F.col("place"))
    line = text.triple_text(F.col("head"), F.col("relation"), F.col("tail"), ",")
    best = ranking.first_distinct(rows.select(KEY, *ranking.TRIPLE, F.col("rank").alias("triple_id")), m.k) if m.kind != "noevi" else None
    out = samples.withColumn("_q", text.question_mark(F.concat(F.lit("Question:\n"), "question")))
    if best is not None:
        ordered = F.sort_array(F.collect_list(F.struct("idx", line.alias("line"))), asc=not m.reverse)
        lists = best.groupBy(KEY).agg(F.transform(ordered, lambda s: s["line"]).alias("_l"))
        out = out.join(lists, KEY, "left").withColumn("_t", F.concat(F.lit("Triplets:\n"), F.array_join(F.coalesce("_l", F.array().cast("array<string>")), "\n")))
    else:
        out = out.withColumn("_t", F.lit(""))
    pair = ["_q", "_t"] if m.question_first else ["_t", "_q"]
    user = F.concat_ws("\n\n", *pair)
    if m.kind == "noevi" and not m.question_first:
        user = F.col("_q")
    return out.select(KEY, user.alias("user_query"), F.concat_ws("\n\n", F.lit(system), *pair).alias("all_query"))


#: Texts and keys that agents are trained on. Fixed values.
AGENT_SYSTEM = """You are a knowledge-graph action agent.
Output exactly one JSON action and nothing else.

Allowed outputs:
{"action":"ADD_TRIPLE","triple_id":<id>}
{"action":"STOP"}

Rules:
- Use only provided candidate triples.
- Do not invent IDs or actions.
- No explanation."""
AGENT_INSTRUCTION = """Choose the best next action.

Priority:
1. semantic match
2. direct answer
3. connectivity unless intermediate expansion is required
4. no repeated triple
5. STOP only if no candidate improves progress"""
STOP_RULE = "Output STOP only when no remaining candidate triple can improve answer coverage or connectivity."
ENVIRONMENT_INSTRUCTION = """You are acting in an interactive KG environment.
Given the current observation, output exactly one JSON action and nothing else.
Valid outputs: {"action":"ADD_TRIPLE","triple_id":<id>} or {"action":"STOP"}."""


def json_list(texts: Column) -> Column:
    """A list of texts as JSON with a blank after each comma."""
    quoted = F.transform(texts, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def selection_state(candidates: Column, selected: Column, topics: Column) -> tuple[Column, Column]:
    """(remaining candidates as numbered lines, the state as JSON) after some of the candidates (idx, head, relation, tail) were selected.

    The state has the selected lines in the order of the candidates, and the topics and the ends of selected triples, sorted.
    """
    numbered = lambda c: text.indexed_text(c["idx"], c["head"], c["relation"], c["tail"])
    taken = lambda c: F.array_contains(selected, c["idx"])
    chosen, rest = F.filter(candidates, taken), F.filter(candidates, lambda c: ~taken(c))
    ends = F.flatten(F.transform(chosen, lambda c: F.array(c["head"], c["tail"])))
    nodes = F.array_sort(F.array_union(F.coalesce(topics, F.array().cast("array<string>")), ends))
    state = F.concat(F.lit('{"selected_triples": '), json_list(F.transform(chosen, numbered)), F.lit(', "current_nodes": '), json_list(nodes), F.lit("}"))
    return F.transform(rest, numbered), state


def selection_prompt(question: Column, candidates: Column, selected: Column, topics: Column, stop_rule: str = STOP_RULE) -> Column:
    """The candidates that remain, or (none), the question, the state, and the rules."""
    rest, state = selection_state(candidates, selected, topics)
    asked = F.trim(F.coalesce(question, F.lit("")))
    asked = F.when(asked == "", asked).otherwise(text.question_mark(asked))
    shown = F.filter(rest, lambda x: F.trim(x) != "")
    lines = F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise("(none)")
    return F.concat(F.lit("Candidate Triples:\n"), lines, F.lit("\n\nQuestion:\n"), asked, F.lit("\n\nstate:\n"), state, F.lit("\n\nAction Rules:\n- Do not repeat triples\n- " + stop_rule))


def observation(question: Column, candidates: Column, selected: Column, topics: Column, stop_rule: str = STOP_RULE) -> Column:
    """What an interactive environment shows of the same state: one JSON object."""
    rest, state = selection_state(candidates, selected, topics)
    one = lambda x: F.regexp_replace(F.to_json(F.array(F.coalesce(x, F.lit("")))), r"^\[|\]$", "")
    rules = F.concat(F.lit('{"allow_stop": true, "do_not_repeat_triples": true, "stop_condition": '), one(F.lit(stop_rule)), F.lit("}"))
    first = F.when(F.size(topics) > 0, F.get(topics, F.lit(0)))
    return F.concat(F.lit('{"question": '), one(question), F.lit(', "topic_entity": '), one(first), F.lit(', "state": '), state, F.lit(', "candidate_triples": '), json_list(rest), F.lit(', "action_rules": '), rules, F.lit("}"))


def messages(system: Column | str, user: Column, assistant: Column, instruction: str = "") -> Column:
    """A training record, without a system message if that is empty; only the assistant's message carries loss."""
    if instruction:
        user = F.when(F.coalesce(user, F.lit("")) == "", F.lit(instruction)).otherwise(F.concat(F.lit(instruction + "\n"), user))
    turns = [("system", system, 0.0), ("user", user, 0.0), ("assistant", assistant, 1.0)]
    return F.array(*[F.struct(F.lit(r).alias("role"), (F.lit(c) if isinstance(c, str) else c).alias("content"), F.lit(w).alias("loss_weight")) for r, c, w in turns if not (isinstance(c, str) and not c)])


def conversation(user: Column, system: str = "", example: tuple[str, str] | None = None, mode: str = "sys_icl") -> Column:
    """The messages of a chat, by substrings of mode: sys for the system message (where there is one) and the user's, icl for an example pair."""
    turns = [("system", F.lit(system))] if "sys" in mode and system else []
    if "icl" in mode and example:
        turns += [("user", F.lit(example[0])), ("assistant", F.lit(example[1]))]
    turns += [("user", user)] if "sys" in mode else []
    if not turns:
        return F.array().cast("array<struct<role:string,content:string>>")
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


class Generator(Protocol):
    """Answers for a batch of prompts, in their order."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class TransientError(RuntimeError):
    """An error worth another try."""


def with_retry(generator: Generator, tries: int = 5, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Generator:
    """Repeats after transient errors, waiting twice as long each time."""

    def call(prompts: list[str]) -> list[str]:
        for n in range(tries):
            try:
                return generator(prompts)
            except TransientError:
                if n + 1 == tries:
                    raise
                sleep(wait * 2**n)
        raise AssertionError

    return call


def echo_generator(prompts: list[str]) -> list[str]:
    """A deterministic stand-in: answers with the last word of the first evidence line, or that there is none."""
    out = []
    for p in prompts:
        line = next((x for x in p.splitlines() if x.startswith("(")), "")
        out.append(f"ans: {line.strip('()').split(',')[-1]}" if line else "ans: not available")
    return out


def generate(rows: DataFrame, prompt: str, generator: Generator, out: str = "prediction") -> DataFrame:
    """rows with the generator's answer, a batch of prompts at a time."""
    at = rows.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            answers = generator(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*batch.schema.names, out])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def generate_twice(rows: DataFrame, prompt: str, generator: Generator, second: str = "Give your best answer.", out: str = "prediction") -> DataFrame:
    """A second turn for the rows whose first answer is none; equal prompts are generated once.

    First answers are written to the shared folder before they are read twice:
    a generator may be paid by the call, or answer differently the next time.
    So are the rows, which are read for their prompts and again for the answers.
    """
    rows = stored(rows)
    unique = rows.select(prompt).distinct()
    first = checkpointed(generate(unique, prompt, generator, out))
    again = text.no_answer(F.col(out))
    kept = first.where(~again)
    redo = generate(first.where(again).select(prompt, F.concat_ws("\n\n", prompt, out, F.lit(second)).alias("_second")), "_second", generator, out)
    return rows.join(kept.select(prompt, out).unionByName(redo.select(prompt, out)), prompt)
