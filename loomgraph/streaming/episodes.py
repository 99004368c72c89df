"""Episodes as a stream: one action in, one event with its reward out; state is kept a key.

The stream carries actions only. What an episode is judged by (candidates, topic,
answers, support) is the initial state of its key, loaded once; the selection is a list that
grows by one entry an accepted action, and a timer ends episodes that fall silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.episodes import Episode, Truth, _action, truth_of

EVENT_SCHEMA = "episode_id long, turn long, event string, reward double, reason string, history string, done boolean"
_NAMES = [c.strip().split()[0] for c in EVENT_SCHEMA.split(",")]
#: Events of the reasons that accept nothing; every other reason is an accepted action.
_EVENTS = {"stop_action": "stop", "invalid_action": "invalid", "duplicate_action": "duplicate"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _advance(key: int, rows: pd.DataFrame, truth: Truth, selected: list[int], history: str, done: bool) -> tuple[list[tuple], Episode, str]:
    """Events of the turns of an episode, in order, up to the one that ends it; what follows is ignored."""
    episode, out = Episode(truth, list(selected), done), []
    for row in rows.sort_values("turn", kind="stable").to_dict("records"):
        if episode.done:
            break
        action = _action(row["kind"], row["triple_id"])
        reward, why = episode.step(action)
        event = _EVENTS.get(why, "accepted")
        if event in ("accepted", "stop"):
            history = f"{history},{action}" if history else str(action)
        out.append((key, int(row["turn"]), event, float(reward), why, history, episode.done))
    return out, episode, history


class EpisodeProcessor(StatefulProcessor):
    """One key is one episode. idle: milliseconds without a turn after which an episode that runs is ended with an idle event."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.truth = handle.getValueState("truth", "truth string")
        self.selected = handle.getListState("selected", "idx int")
        self.record = handle.getValueState("record", "history string, done boolean, turn long")

    def _known(self) -> Truth:
        if not self.truth.exists():
            return Truth({})
        t = json.loads(self.truth.get()[0])
        return Truth({int(i): tuple(c) for i, c in t["candidates"]}, t["topic"], tuple(t["answers"]), frozenset(t["support"]), t["soft_limit"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        t = truth_of(initialState.to_dict("records")[0])
        self.truth.update((json.dumps({"candidates": list(t.candidates.items()), "topic": t.topic, "answers": t.answers, "support": sorted(t.support), "soft_limit": t.soft_limit}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history, done, turn = self.record.get() if self.record.exists() else ("", False, -1)
        selected = [x[0] for x in self.selected.get()] if self.selected.exists() else []
        out, episode, history = _advance(int(key[0]), pd.concat(list(rows)), self._known(), selected, history, done)
        for idx in episode.selected[len(selected) :]:
            self.selected.appendValue((idx,))
        self.record.update((history, episode.done, max([turn, *(r[1] for r in out)])))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not episode.done:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if episode.done:  # the record stays, so that late turns are ignored
            self.truth.clear()
            self.selected.clear()
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        history, _, turn = self.record.get()
        self.record.update((history, True, turn))
        self.truth.clear()
        self.selected.clear()
        yield pd.DataFrame([(int(key[0]), turn, "idle", 0.0, "idle", history, True)], columns=_NAMES)

    def close(self) -> None:
        pass


def episode_events(turns: DataFrame, truths: DataFrame, idle: int | None = None) -> DataFrame:
    """turns (episode_id, turn, kind, triple_id), streaming or not, as events; truths (episode_id, candidates, topic, answers, support, soft_limit) is a table.

    Invalid and repeated actions do not end an episode; STOP does. A batch table of turns is
    one micro-batch without state before it, and has no idle episodes. An episode without a truth has no candidates.
    """
    spark = turns.sparkSession
    if not turns.isStreaming:

        def fold(key, own: pd.DataFrame, truth: pd.DataFrame) -> pd.DataFrame:
            known = truth_of(truth.to_dict("records")[0]) if len(truth) else Truth({})
            return pd.DataFrame(_advance(int(key[0]), own, known, [], "", False)[0], columns=_NAMES)

        return turns.groupBy("episode_id").cogroup(truths.groupBy("episode_id")).applyInPandas(fold, EVENT_SCHEMA)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state of several kinds needs this store
    return turns.groupBy("episode_id").transformWithStateInPandas(EpisodeProcessor(idle), EVENT_SCHEMA, "append", "none" if idle is None else "processingTime", truths.groupBy("episode_id"))


def call_log(events: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends events as JSON lines, exactly once a micro-batch; once: what is there now, then stops."""
    writer = events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user with their numbers of events, late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
