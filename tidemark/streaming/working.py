"""Working memory and scoring history over a stream: the last items of each session, kept as state.

Rows: tenant, session_id, id, role, content, created_at and, optionally, kind: 'turn' (or null) or 'reset', a control row
that empties its session. Inside a micro-batch a session's rows count in the order of their time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "tenant string, session_id string, position int, id string, role string, content string, created_at long"
NAMES = ("id", "role", "content", "created_at")
STATE = "ids array<string>, roles array<string>, contents array<string>, times array<long>"
HISTORY = "tenant string, session_id string, id string, role string, content string, created_at long, history array<string>"


def _held(state: GroupState) -> list[tuple]:
    return list(zip(*state.get, strict=True)) if state.exists else []


def _keep(state: GroupState, rows: list[tuple], idle_ms: int | None, latest: int) -> None:
    state.update(tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [], []))
    if idle_ms is not None:
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)


def _rows(batches: Iterator[pd.DataFrame]) -> list[tuple[bool, tuple]]:
    """(whether it is a reset, the row) in order; a reset comes after the turns of its time."""
    new = pd.concat(list(batches), ignore_index=True).sort_values(["created_at", "reset", "id"], na_position="first")
    return [(r[0], r[1:]) for r in new[["reset", *NAMES]].itertuples(index=False, name=None)]


def _told(turns: DataFrame, idle_ms: int | None) -> DataFrame:
    reset = "coalesce(kind = 'reset', false) AS reset" if "kind" in turns.columns else "false AS reset"
    return turns.selectExpr("tenant", "session_id", *NAMES, reset, *(["ts"] if idle_ms is not None else []))


def last_items(turns: DataFrame, items: int = 5, idle_ms: int | None = None) -> DataFrame:
    """For each session with new rows: its last items in order; none of a session that a reset has just emptied.

    The state of a session is its last items only. A turn whose id is among them already isn't taken twice. With
    idle_ms, rows need a watermark on ts, and a session is forgotten once the watermark is that far past its last row.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, latest = _held(state), 0
        for reset, row in _rows(batches):
            latest = max(latest, row[3])
            if reset:
                held = []
            elif all(row[0] != x[0] for x in held):
                held = sorted([*held, row], key=lambda x: (x[3], x[0]))[-items:]
        _keep(state, held, idle_ms, latest)
        yield pd.DataFrame({"tenant": key[0], "session_id": key[1], "position": range(1, len(held) + 1), **{c: [x[n] for x in held] for n, c in enumerate(NAMES)}})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return _told(turns, idle_ms).groupBy("tenant", "session_id").applyInPandasWithState(update, OUT, STATE, "update", timeout)


def with_history(turns: DataFrame, items: int = 5, idle_ms: int | None = None, resets: bool = False) -> DataFrame:
    """Each turn of a stream with history: the contents of up to `items` turns before it in its session, also of
    earlier micro-batches. What episodes.scoring_context() gives for a whole table whose turns come in order of time.

    Resets empty the history only if `resets` says so: what a message is scored by is what was said. idle_ms as in
    last_items(). Turns without a session (null) share one history for each tenant, as they do in the batch form.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, latest, out = _held(state), 0, []
        for reset, row in _rows(batches):
            latest = max(latest, row[3])
            if not reset:
                out.append((*key, *row, [x[2] for x in held if x[2] is not None]))
                held = [*held, row][-items:]
            elif resets:
                held = []
        _keep(state, held, idle_ms, latest)
        yield pd.DataFrame(out, columns=["tenant", "session_id", *NAMES, "history"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return _told(turns, idle_ms).groupBy("tenant", "session_id").applyInPandasWithState(update, HISTORY, STATE, "append", timeout)
