"""Undo and redo of reviewers' commands: each command is a batch of changes on a bounded stack of its session.

A log of commands becomes a log of changes: a new batch applies its changes in order, undo gives back what the last batch changed in opposite
order, redo applies it again; a new batch ends what can be redone. The stacks are the only state. The same fold runs over a whole log
(sorted by session, as a stream through each task) and over a streaming one (state kept by session between micro-batches).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Commands that can be undone.
DEPTH = 100
#: A batch's changes, and the changes that a log of commands makes. Null values leave a field as it is.
CHANGES = "array<struct<det_id:long,status_before:string,status:string,ground_before:string,ground:string>>"
COMMANDS = f"session long, seq long, action string, changes {CHANGES}"
_OUT = "session long, seq long, nth int, det_id long, status string, ground string"


class History:
    """The stacks of one session. Commands up to the last seq seen are repeated deliveries and do nothing."""

    def __init__(self, depth: int = DEPTH, state: str | None = None):
        self.depth = depth
        self.done, self.undone, self.last = json.loads(state) if state else ([], [], None)

    def state(self) -> str:
        return json.dumps([self.done, self.undone, self.last])

    def apply(self, seq: int, action: str, changes: list[tuple]) -> list[tuple[int, str | None, str | None]]:
        """The changes (det_id, status, ground) that a command makes, in order."""
        if self.last is not None and seq <= self.last:
            return []
        self.last = seq
        if action == "push":
            batch = [list(c) for c in changes]
            self.done, self.undone = [*self.done, batch][-self.depth :], []
            return [(c[0], c[2], c[4]) for c in batch]
        if action == "undo" and self.done:
            batch = self.done.pop()
            self.undone.append(batch)
            return [(c[0], c[1], c[3]) for c in reversed(batch)]
        if action == "redo" and self.undone:
            batch = self.undone.pop()
            self.done.append(batch)
            return [(c[0], c[2], c[4]) for c in batch]
        if action == "clear":
            self.done, self.undone = [], []
        return []


def _rows(session: int, commands: Iterator[tuple], history: History) -> list[tuple]:
    out = []
    for seq, action, changes in commands:
        made = history.apply(seq, action, [] if changes is None else [(c["det_id"], c["status_before"], c["status"], c["ground_before"], c["ground"]) for c in changes])
        out += [(session, seq, nth, *change) for nth, change in enumerate(made)]
    return out


def changes_of(commands: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The changes of a whole log of commands (COMMANDS): session, seq, nth, det_id, status, ground.

    Rows of a session come sorted through one task, batch by batch, so a session of any length takes the memory of its stacks.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, history = None, History(depth)
        for frame in frames:
            out = []
            for own, seq, action, changes in zip(frame["session"].tolist(), frame["seq"].tolist(), frame["action"].tolist(), frame["changes"].tolist(), strict=True):
                if own != session:
                    session, history = own, History(depth)
                out += _rows(own, iter([(seq, action, changes)]), history)
            yield _frame(out)

    ordered = commands.select("session", "seq", "action", "changes").repartition("session").sortWithinPartitions("session", "seq", "action")
    return ordered.mapInPandas(fold, _OUT)


def changes_of_stream(commands: DataFrame, depth: int = DEPTH) -> DataFrame:
    """changes_of on a stream: the stacks of a session are its state, so a restart from a checkpoint goes on where it stopped.

    Commands of a micro-batch are sorted by seq; later ones with a seq already passed are repeated deliveries and are left out.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = History(depth, state.get[0] if state.exists else None)
        own = pd.concat(list(frames)).sort_values(["seq", "action"])
        out = _rows(int(key[0]), zip(own["seq"].tolist(), own["action"].tolist(), own["changes"].tolist(), strict=True), history)
        state.update((history.state(),))
        yield _frame(out)

    return commands.groupBy("session").applyInPandasWithState(fold, _OUT, "stacks string", "append", GroupStateTimeout.NoTimeout)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["session", "seq", "nth", "det_id", "status", "ground"])
    return out.astype({"session": "int64", "seq": "int64", "nth": "int32", "det_id": "int64"})


def states(changes: DataFrame) -> DataFrame:
    """session, det_id, status, ground, n: what the changes leave behind; a field keeps its last value that is not null."""
    place = F.struct("seq", "nth")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    return changes.groupBy("session", "det_id").agg(last("status"), last("ground"), F.count("*").alias("n"))


def sweep_commands(rows: DataFrame, status: str, ground: str | None = None) -> DataFrame:
    """One batch for each (session, seq) of rows (session, seq, det_id, review_status, woo_article): all become `status`, with their state before kept."""
    change = F.struct("det_id", F.col("review_status").alias("status_before"), F.lit(status).alias("status"), F.col("woo_article").alias("ground_before"), F.lit(ground).cast("string").alias("ground"))
    return rows.groupBy("session", "seq").agg(F.lit("push").alias("action"), F.array_sort(F.collect_list(change)).cast(CHANGES).alias("changes")).select("session", "seq", "action", "changes")
