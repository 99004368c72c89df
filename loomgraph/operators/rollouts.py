"""Agent rollouts: all episodes advance together, one action a round.

A round takes the episodes that still run. Those in equal states (the same sample with the
same selection) see the same prompt, so states are rendered once, asked for once, and
what was said is kept in a memo table that later rounds, and later runs over the same folder,
read instead of asking again. Replies become events in the task that generates
them; the episodes then move by joins and column expressions. Each round is written
to the folder (the rows that ended, and those that go on), so a lost executor costs a
part of one round and a stopped run goes on where it was.

With ``sampled`` a state is still rendered once, but every episode and
step draws a reply of its own, as a generator at a temperature does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.actions import agent_action
from loomgraph.operators import prompts
from loomgraph.operators.episodes import ENDS, MAX_STALLED, MAX_STEPS, SPOKEN, STALLED, event_of
from loomgraph.sources import storage

KEY = "sample_id"
_STATE = ["sample_id", "rollout", "selected", "lines", "duplicates", "stalled", "n_steps", "done_reason"]


class RolloutGenerator(Protocol):
    """Replies to a batch of prompts, in their order; draws: numbers that tell apart replies to the same prompt."""

    def __call__(self, prompts: list[str], draws: list[int]) -> list[str]: ...


def without_draws(generator: prompts.Generator) -> RolloutGenerator:
    return lambda asked, draws: generator(asked)


def prompt_of(system: str = prompts.AGENT_SYSTEM, instruction: str = prompts.AGENT_INSTRUCTION):
    """The whole prompt of a state, from columns question, candidates, chosen and topics."""
    body = prompts.selection_prompt(F.col("question"), F.col("candidates"), F.col("chosen"), F.col("topics"))
    return F.concat_ws("\n\n", *([F.lit(system)] if system else []), F.concat_ws("\n", *([F.lit(instruction)] if instruction else []), body))


class Rollouts:
    """Episodes of samples (sample_id, question, candidates (idx, head, relation, tail), topics) in a folder of their own."""

    def __init__(self, samples: DataFrame, generator: RolloutGenerator, folder: str | None = None, n_rollouts: int = 1, max_steps: int = MAX_STEPS, max_stalled: int = MAX_STALLED, sampled: bool = False, system: str = prompts.AGENT_SYSTEM, instruction: str = prompts.AGENT_INSTRUCTION):
        if n_rollouts < 1 or max_steps < 1:
            raise ValueError("a rollout has a step at least")
        self.spark, self.generator, self.sampled = samples.sparkSession, generator, sampled
        self.folder = (folder or storage.new_folder(self.spark, "rollouts")).rstrip("/")
        self._given = samples.select(KEY, "question", "candidates", "topics")
        self.n_rollouts, self.max_steps, self.max_stalled = n_rollouts, max_steps, max_stalled
        self.prompt = prompt_of(system, instruction)
        key = samples.schema[KEY].dataType.simpleString()
        self.state_schema = f"{KEY} {key}, rollout int, selected array<int>, lines array<string>, duplicates int, stalled int, n_steps int, done_reason string"
        self.memo_schema = f"{KEY} {key}, chosen array<int>, draw long, reply string, event string, action int"

    # --- tables of the folder

    @cached_property
    def samples(self) -> DataFrame:
        """The samples, made once for the start and all rounds."""
        return storage.stored(self._given)

    def _table(self, name: str, schema: str) -> DataFrame:
        """All rounds of a table that were written to their end."""
        there = storage.finished_parts(self.spark, f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def memo(self) -> DataFrame:
        """(sample_id, chosen, draw, reply, event, action): everything that was ever asked."""
        return self._table("memo", self.memo_schema)

    def _start(self) -> DataFrame:
        fresh = self.samples.where(F.size("candidates") > 0).select(KEY, F.explode(F.sequence(F.lit(0), F.lit(self.n_rollouts - 1))).alias("rollout"))
        no = F.array()
        return fresh.select(KEY, F.col("rollout").cast("int").alias("rollout"), no.cast("array<int>").alias("selected"), no.cast("array<string>").alias("lines"), *[F.lit(0).alias(c) for c in ("duplicates", "stalled", "n_steps")], F.lit(None).cast("string").alias("done_reason"))

    # --- a round

    def _asked(self, todo: DataFrame) -> DataFrame:
        """States (sample_id, chosen, draw) with their reply and its event; the prompt of a state is rendered in the same row."""
        generator = self.generator

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                key, chosen, draw, asked, listed = batch.columns
                replies = generator(asked.to_pylist(), draw.to_pylist())
                events, taken = [], []
                for reply, own, cands in zip(replies, chosen.to_pylist(), listed.to_pylist(), strict=True):
                    known = {c["idx"]: (c["head"], c["relation"], c["tail"]) for c in cands}
                    action = agent_action(reply, known)
                    events.append(event_of(action, known, own))
                    taken.append(action if isinstance(action, int) else None)
                yield pa.RecordBatch.from_arrays([key, chosen, draw, pa.array(replies, pa.string()), pa.array(events, pa.string()), pa.array(taken, pa.int32())], [KEY, "chosen", "draw", "reply", "event", "action"])

        rows = todo.join(self.samples, KEY).select(KEY, "chosen", "draw", self.prompt.alias("prompt"), "candidates")
        return rows.mapInArrow(run, self.memo_schema)

    def step(self, active: DataFrame) -> DataFrame:
        """The episodes after one action each; replies that the memo lacks are asked for and appended to it."""
        draw = (F.col("rollout").cast("long") * self.max_steps + F.col("n_steps")) if self.sampled else F.lit(0).cast("long")
        placed = active.withColumns({"chosen": F.array_sort("selected"), "draw": draw})
        states = placed.select(KEY, "chosen", "draw").distinct()
        missing = states.join(self.memo().select(KEY, "chosen", "draw"), [KEY, "chosen", "draw"], "left_anti")
        storage.write_part(self._asked(missing), f"{self.folder}/memo")
        said = self.memo().select(KEY, "chosen", "draw", "event", "action")
        out = placed.join(said, [KEY, "chosen", "draw"])
        event, again = F.col("event"), F.col("event") == "duplicate"
        stalled = F.when(again, F.col("stalled") + 1).when(event == "accepted", 0).otherwise(F.col("stalled"))
        stuck = again & (stalled >= self.max_stalled) if self.max_stalled >= 0 else F.lit(False)
        line = F.when(event == "stop", "STOP").otherwise(F.col("action").cast("string"))
        ended = F.when(event.isin(*ENDS), event).when(stuck, STALLED).when(F.col("n_steps") + 1 >= self.max_steps, "max_steps")
        return out.select(
            KEY, "rollout",
            F.when(event == "accepted", F.concat("selected", F.array("action"))).otherwise(F.col("selected")).alias("selected"),
            F.when(event.isin(*SPOKEN), F.concat("lines", F.array(line))).otherwise(F.col("lines")).alias("lines"),
            (F.col("duplicates") + again.cast("int")).alias("duplicates"), stalled.cast("int").alias("stalled"), (F.col("n_steps") + 1).alias("n_steps"), ended.alias("done_reason"),
        )

    def run(self, most_rounds: int | None = None) -> DataFrame:
        """(sample_id, rollout, selected, lines, duplicates, stalled, n_steps, done_reason) of all episodes, from the last whole round on.

        most_rounds: rounds of this call; the episodes that have not ended then have no done_reason.
        """
        rounds = f"{self.folder}/rounds"
        done = len(storage.finished_parts(self.spark, rounds))
        if not done:
            storage.write_part(self._start(), rounds, 0)
            done = 1
        last = self.max_steps + 1 if most_rounds is None else min(self.max_steps + 1, done + most_rounds)
        for k in range(done, last):
            # a part holds what its round changed: the episodes that were active in it
            active = self._round(k - 1).where("done_reason IS NULL")
            if active.isEmpty():
                break
            storage.write_part(self.step(active), rounds, k)
        parts = storage.finished_parts(self.spark, rounds)
        ended = self._table("rounds", self.state_schema).where("done_reason IS NOT NULL")
        running = self.spark.read.schema(self.state_schema).parquet(parts[-1]).where("done_reason IS NULL")
        return ended.unionByName(running).select(*_STATE)

    def _round(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.state_schema).parquet(storage.finished_parts(self.spark, f"{self.folder}/rounds")[k])


def selections(episodes: DataFrame) -> DataFrame:
    """(sample_id, rollout, step, idx) of the selected triples of all episodes, as the union of rollouts takes them."""
    return episodes.select(KEY, "rollout", F.posexplode("selected").alias("step", "idx"))
