"""Conversations compacted as they go on, and observations appended by day."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenkb.functions.text import estimate_tokens, line_count
from lumenkb.operators.sessions import HOT_TURNS, LINE_LIMIT, TOKEN_LIMIT, diagnostic, succeeded
from lumenkb.session import ship_code

FOLDED = "session_id long, turn_index long, role string, tier long, solved long"


class Session:
    """The last turns of a session and its unresolved errors before them, as (turn_index, role, error, long, solved)."""

    def __init__(self, kept: str | None):
        self.recent, self.errors, self.last = json.loads(kept) if kept else ([], [], None)
        self.settled: list[tuple] = []

    def kept(self) -> str:
        return json.dumps([self.recent, self.errors, self.last], ensure_ascii=False)

    def _settle(self, turn: list, tier: int) -> None:
        index, role, _, _, solved = turn
        tier = 0 if role in ("system", "user") else tier
        self.settled.append((index, role, tier, solved if tier == 3 else None))

    def add(self, index: int, role: str, error: str | None, ok: bool, long: bool, hot: int) -> None:
        if ok or (error is not None and error != self.last):  # what went wrong before is over
            for turn in [*self.errors, *self.recent]:
                if turn[2] is not None and turn[4] is None:
                    turn[4] = index
            for turn in self.errors:
                self._settle(turn, 3)
            self.errors = []
        self.last = self.last if error is None else error
        self.recent.append([index, role, error, long, None])
        while len(self.recent) > hot:
            turn = self.recent.pop(0)
            if turn[2] is not None and turn[4] is None and turn[1] not in ("system", "user"):
                self.errors.append(turn)
            else:
                self._settle(turn, 3 if turn[4] is not None else 2 if turn[3] else -1)

    def end(self) -> None:
        for turn in self.errors:
            self._settle(turn, 2 if turn[3] else -1)
        for turn in self.recent:
            self._settle(turn, 1)


def fold_stream(turns: DataFrame, hot: int = HOT_TURNS, foldable_role: str = "tool", idle: str = "1 hour") -> DataFrame:
    """FOLDED: the turns of a stream with the tier that ``sessions.fold_turns`` gives them, each once, when it is settled.

    ``turns``: session_id, turn_index, role, content, ts; a session's turns come in their order, from batch to batch. A
    turn is settled when it is no longer among the last ``hot`` of its session, an unresolved error when a later turn
    resolves it, and what is left when the session has been idle for so long by event time. State holds recent turns
    and unresolved errors without their contents, and goes when the session ends; a turn after that begins another
    session of the same id.
    """
    lines = line_count(F.col("content"))
    long = (F.col("role") == foldable_role) & ((lines > LINE_LIMIT) | (estimate_tokens(F.col("content")) > TOKEN_LIMIT))
    rows = turns.withWatermark("ts", idle).select("session_id", "turn_index", "role", "ts", diagnostic(F.col("content")).alias("error"), succeeded(F.col("content")).alias("ok"), long.alias("long"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            session.end()
            state.remove()
        else:
            arrived = pd.concat(list(batches)).sort_values("turn_index", kind="stable")
            for t in arrived.itertuples(index=False):
                session.add(int(t.turn_index), t.role, None if pd.isna(t.error) else t.error, bool(t.ok), bool(t.long), hot)
            state.update((session.kept(),))
            state.setTimeoutTimestamp(max(int(arrived["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame([(key[0], *x) for x in session.settled], columns=[x.split()[0] for x in FOLDED.split(", ")])
        yield out.astype({"session_id": "int64", "turn_index": "int64", "tier": "int64", "solved": "Int64"})

    ship_code(turns.sparkSession)
    return rows.groupBy("session_id").applyInPandasWithState(step, FOLDED, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def append_by_day(observations: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of observations (ts, more) to a folder for each day. The sink's log and the checkpoint make each row count once over restarts."""
    rows = observations.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start(target)
