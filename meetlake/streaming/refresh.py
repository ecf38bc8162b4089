"""Streams that keep state beyond a window: an index that follows edits, and turns that later statements extend."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meetlake.operators.index_store import Store, refresh

TURNS = "meeting_id long, start_s double, end_s double, label string, confidence double, statements long"


def follow(documents: DataFrame, store: Store, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Refreshes the index by all versions of documents that a stream has to offer now. A micro-batch that is repeated after a failure finds its meetings
    current or stale as they are, so its outcome is the same."""
    documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: refresh(store, rows, embed)).start().awaitTermination()


class Turns:
    """A meeting's open turns. A statement that starts within ``within`` seconds of an open turn extends it and replaces its label (unless it has
    none) and confidence; another one opens a turn. A turn that ended ``settle`` seconds before the audio fed is closed; a statement that starts
    before that horizon and meets no open turn is late, and dropped."""

    def __init__(self, within: float, settle: float, fed: float = float("-inf"), turns: list | None = None):
        self.within, self.settle, self.fed, self.turns = within, settle, fed, turns or []

    def closed(self) -> list[list]:
        horizon = self.fed - self.settle
        done = [t for t in self.turns if t[1] <= horizon]
        self.turns = [t for t in self.turns if t[1] > horizon]
        return done

    def state(self, start: float, end: float, label: str | None, confidence: float, fed: float) -> list[list]:
        """The turns that the audio fed so far closes, before the statement counts."""
        self.fed = max(self.fed, fed)
        done = self.closed()
        own = next((t for t in self.turns if round(abs(t[0] - start), 9) <= self.within), None)
        if own is not None:
            own[1], own[2], own[3], own[4] = max(own[1], end), label or own[2], confidence, own[4] + 1
        elif start > self.fed - self.settle:
            self.turns = sorted([*self.turns, [start, end, label or "", confidence, 1]])
        return done


def rows_of(meeting: int, turns: list[list]) -> pd.DataFrame:
    return pd.DataFrame([(meeting, *t) for t in turns], columns=["meeting_id", "start_s", "end_s", "label", "confidence", "statements"])


def closed_turns(statements: DataFrame, within: float = 0.01, settle: float = 15.0) -> DataFrame:
    """Turns, each once, when they close. Streaming. statements: meeting_id, arrival, start_s, end_s, label, confidence, fed_s; they come in the order of
    ``arrival`` between micro-batches and are sorted by it within one, so that the cut into micro-batches changes nothing. The state is what
    the settling time covers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fed, packed = state.get if state.exists else (-1e300, "[]")
        open_ = Turns(within, settle, fed, json.loads(packed))
        done = []
        for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
            done += open_.state(float(r.start_s), float(r.end_s), r.label, float(r.confidence), float(r.fed_s))
        done += open_.closed()
        state.update((open_.fed, json.dumps(open_.turns)))
        yield rows_of(key[0], done)

    return statements.groupBy("meeting_id").applyInPandasWithState(run, TURNS, "fed double, open string", "append", GroupStateTimeout.NoTimeout)


def settled_turns(statements: DataFrame, within: float = 0.01, settle: float = 15.0) -> DataFrame:
    """What closed_turns() has emitted once all statements are in, as a batch job: a meeting's statements are walked in their order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        open_, done = Turns(within, settle), []
        for r in rows.sort_values("arrival").itertuples():
            done += open_.state(float(r.start_s), float(r.end_s), r.label, float(r.confidence), float(r.fed_s))
        return rows_of(key[0], done + open_.closed())

    return statements.groupBy("meeting_id").applyInPandas(run, TURNS)
