"""Failure streaks of sources as a stream: streak, reason for attention and its start in Spark's state store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

_RESULT = "id long, source_id long, failures int, reason string, since timestamp"


def streak_step(now: tuple, run: tuple, attention_after: int = 3) -> tuple:
    """``failures, reason, since`` after a run ``at, category, error_code``.

    An ``ok`` run clears all. A ``blocked`` one asks for attention with its code; an ``extraction`` failure does from the
    given number in a row. The start moves only with the reason.
    """
    failures, reason, since = now
    at, category, code = run
    if category == "ok":
        return 0, None, None
    failures += 1
    asked = code if category == "blocked" else "extraction_failed" if category == "extraction" and failures >= attention_after else None
    if asked is not None and asked != reason:
        reason, since = asked, at
    return failures, reason, since


def failure_streak_stream(runs: DataFrame, late: str = "1 hour", attention_after: int = 3) -> DataFrame:
    """``id, source_id, failures, reason, since`` of each run ``id, source_id, finished_at, category, error_code``.

    Runs of one micro-batch are put in order; one that arrives in a later batch counts when it arrives. There is one
    small state for each source.
    """

    def step(key, frames, state):
        failures, reason, since = state.get if state.exists else (0, None, None)
        now = (failures, reason, None if since is None else pd.Timestamp(since, unit="us"))
        rows, out = pd.concat(list(frames)).sort_values(["finished_at", "id"]), []
        for i, at, category, code in zip(rows["id"], rows["finished_at"], rows["category"], rows["error_code"]):
            now = streak_step(now, (at, category, code), attention_after)
            out.append((i, key[0], *now))
        state.update((now[0], now[1], None if now[2] is None else int(now[2].value // 1000)))
        yield pd.DataFrame(out, columns=["id", "source_id", "failures", "reason", "since"]).astype({"since": "datetime64[us]"})

    timed = runs.withWatermark("finished_at", late)
    return timed.groupBy("source_id").applyInPandasWithState(step, _RESULT, "failures int, reason string, since long", "append", GroupStateTimeout.NoTimeout)
