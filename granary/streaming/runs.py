"""Runs of equal states over a stream, one open run in state for each person."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "person long, state string, start long, end long, n long"
COLUMNS = ["person", "state", "start", "end", "n"]


def _advance(idle: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, start, end, n = held.get if held.exists else (None, 0, 0, 0)
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(key[0], state, start, end, n)] if n else [], columns=COLUMNS)
            return
        closed = []
        rows = pd.concat(list(batches)).sort_values("ord")
        for order, value in zip(rows["ord"], rows["state"], strict=True):
            if n and value == state:
                end, n = order, n + 1
                continue
            if n:
                closed.append((key[0], state, start, end, n))
            state, start, end, n = value, order, order, 1
        held.update((state, int(start), int(end), int(n)))
        if idle is not None:
            held.setTimeoutTimestamp(max(int(rows["ms"].max()), held.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(closed, columns=COLUMNS)

    return step


def closed_runs(stream: DataFrame, time_col: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Rows for each run of a stream (person, ord, state) once a row of another state ends it.

    Rows of a person must not arrive in a batch before others that precede them; within a batch they are ordered. With
    time_col, rows that come more than `late` behind the newest are left out, and the open run of a person of whom
    nothing came for idle_ms of that time is closed and forgotten, which bounds the state.
    """
    if time_col is None:
        return stream.select("person", "ord", "state").groupBy("person").applyInPandasWithState(_advance(None), OUT, "state string, start long, end long, n long", "append", "NoTimeout")
    timed = stream.withWatermark(time_col, late).select("person", "ord", "state", F.unix_millis(time_col).alias("ms"), time_col)
    return timed.groupBy("person").applyInPandasWithState(_advance(idle_ms), OUT, "state string, start long, end long, n long", "append", "EventTimeTimeout")
