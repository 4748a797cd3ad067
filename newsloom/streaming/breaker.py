"""The failure breaker as a stream: the state of each provider lives in Spark's state store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from newsloom.operators.ledgers import BREAKER, breaker_start, breaker_step

_RESULT = "id long, provider long, status string, n_failures int"


def failure_breaker_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """``id, provider, status, n_failures`` of each call, as the batch operator gives them.

    Calls of one micro-batch are put in order; a call that arrives in a later batch than one after it
    counts when it arrives, or is left out if it is more than ``late``. State that nothing has touched
    for the lapse would start anew, so it goes once the watermark is past it.
    """

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else breaker_start()
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for call, at, success in zip(rows["id"], rows["at"], rows["success"]):
            now, told = breaker_step(now, (at, bool(success)))
            out.append((call, key[0], *told))
        state.update(now)
        state.setTimeoutTimestamp(int((now[3] + BREAKER["lapse"]) * 1000) + 1)
        yield pd.DataFrame(out, columns=["id", "provider", "status", "n_failures"])

    timed = calls.withWatermark("created_at", late).withColumn("at", F.unix_micros("created_at") / 1e6)
    return timed.groupBy("provider").applyInPandasWithState(run, _RESULT, "failures int, opened double, successes int, written double", "append", GroupStateTimeout.EventTimeTimeout)
