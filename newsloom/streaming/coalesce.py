"""Requests that one job serves, as a stream with deadlines: the job of each entity and its timer lie in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.ordered import fold_in_order

_RESULT = "id long, entity_id long, job_id long, absorbed boolean, expired boolean"
_STATE = "job_id long, until long"


def coalesce_step(now: tuple | None, event: tuple, deadline: int) -> tuple[tuple | None, tuple]:
    """The job ``job_id, until`` (microseconds) of an entity after an event ``id, at, finish``, and ``job_id, absorbed``.

    A request joins the job that is open and has not reached its deadline, else it opens one; a finish ends the open job.
    """
    number, at, finish = event
    if finish:
        return None, (None, None)
    if now is not None and at < now[1]:
        return now, (now[0], True)
    return (number, at + deadline), (number, False)


def coalesced_within(events: DataFrame, deadline_seconds: int) -> DataFrame:
    """``id, entity_id, job_id, absorbed`` of each request of ``id, entity_id, created_at, finish``, in order of time and id."""
    timed = events.selectExpr("id", "entity_id", "unix_micros(created_at) as at", "finish")
    step = lambda now, row: coalesce_step(now, row, deadline_seconds * 1_000_000)
    told = fold_in_order(timed, ["entity_id"], ["at", "id"], lambda: None, step, ["id", "at", "finish"], "job_id long, absorbed boolean")
    return told.where("not finish").select("id", "entity_id", "job_id", "absorbed")


class _Coalescing(StatefulProcessor):
    def __init__(self, deadline: int):
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _hold(self, before: tuple | None, now: tuple | None) -> None:
        """Keep the job and move the timer to its deadline."""
        if before == now:
            return
        if before is not None:
            self.handle.deleteTimer(before[1] // 1000 + 1)
        if now is None:
            self.job.clear()
        else:
            self.job.update(now)
            self.handle.registerTimer(now[1] // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = now = tuple(self.job.get()) if self.job.exists() else None
        events, out = pd.concat(list(rows)).sort_values(["at", "id"]), []
        for event in zip(events["id"].tolist(), events["at"].tolist(), events["finish"].tolist()):
            now, (job, absorbed) = coalesce_step(now, event, self.deadline)
            if job is not None:
                out.append((event[0], key[0], job, absorbed, False))
        self._hold(before, now)
        yield pd.DataFrame(out, columns=["id", "entity_id", "job_id", "absorbed", "expired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, _ = self.job.get()
        self.job.clear()
        yield pd.DataFrame([(None, key[0], job, None, True)], columns=["id", "entity_id", "job_id", "absorbed", "expired"]).astype({"id": "Int64", "absorbed": "boolean"})

    def close(self) -> None:
        pass


def coalesce_stream(events: DataFrame, deadline_seconds: int, late: str = "1 hour") -> DataFrame:
    """``id, entity_id, job_id, absorbed, expired``: each request as in the batch, and a row for each job that its deadline ends.

    Events of one micro-batch are put in order; a later one counts when it arrives, or is left out if it is more than ``late``. The
    session's state store has to be RocksDB.
    """
    timed = events.withWatermark("created_at", late).selectExpr("id", "entity_id", "created_at", "unix_micros(created_at) as at", "finish")
    return timed.groupBy("entity_id").transformWithStateInPandas(_Coalescing(deadline_seconds * 1_000_000), _RESULT, "append", "EventTime")
