"""Jobs' progress as a state machine on a stream: an order of states, stalls, cancelling with a grace, expiry, and events on change.

Rows are (job_id, ts, event, current, total, message): ``create``, ``start``, ``update``, ``complete``, ``fail``, ``cancel`` and ``stopped``
(the work of a cancelled job has ended). A job goes pending, running, completed or failed; one that is pending or running may be cancelled, is cancelling then,
and is cancelled when its work says that it stopped, or after ``grace``. A state that ends a job stays; what comes later changes nothing and is
reported as refused. A job that has been silent for ``stall`` is reported once a silence; an ended one is forgotten ``ttl`` after its end.

Emitted are (job_id, kind, status, current, total, message, frame): ``progress`` where count or status changed (or at every row, without
``on_change``), ``heartbeat`` after each ``heartbeat`` without one, ``refused``, ``stalled``, ``expired``; ``frame`` is the server-sent event of the first two.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalog import TERMINAL

STATE = "status string, current long, total long, message string, at long, beat long, ended long, stalled boolean"
OUT = "job_id string, kind string, status string, current long, total long, message string, frame string"
#: Event: (states that it may come in, the state after it; None: the same).
EVENTS = {
    "create": ((None,), "pending"),
    "start": (("pending",), "running"),
    "update": (("pending", "running", "cancelling"), None),
    "complete": (("pending", "running", "cancelling"), "completed"),
    "fail": (("pending", "running", "cancelling"), "failed"),
    "cancel": (("pending", "running"), "cancelling"),
    "stopped": (("cancelling",), "cancelled"),
}
#: Milliseconds until a job counts as stalled, until a cancelled one is given up, until an ended one is forgotten, and between heartbeats.
STALL, GRACE, TTL, HEARTBEAT = 45_000, 10_000, 300_000, 1_000


def after(status: str | None, event: str) -> str | None:
    """The state after an event, or None where the event is refused. A job that begins with another event than ``create`` is pending before it."""
    if event not in EVENTS:
        return None
    before, to = EVENTS[event]
    if status is None and event != "create":
        return after("pending", event)
    return (to or status) if status in before else None


def frame(kind: str, job: str, status: str, current: int, total: int, message: str | None) -> str:
    """A server-sent event."""
    if kind == "heartbeat":
        return "event: heartbeat\ndata: {}\n\n"
    percent = round(100 * current / total) if total else 0
    return f"event: progress\ndata: {json.dumps({'job_id': job, 'status': status, 'current': current, 'total': total, 'percent': percent, 'message': message})}\n\n"


class Jobs(StatefulProcessor):
    def __init__(self, on_change: bool = True, stall: int = STALL, grace: int = GRACE, ttl: int = TTL, heartbeat: int = HEARTBEAT):
        self.on_change, self.stall, self.grace, self.ttl, self.heartbeat = on_change, stall, grace, ttl, heartbeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("job", STATE)

    def _load(self) -> dict | None:
        if not self.held.exists():
            return None
        return dict(zip((c.split()[0] for c in STATE.split(", ")), self.held.get(), strict=True))

    def _save(self, job: dict, now: int) -> None:
        """The state, and one timer for whatever comes first."""
        self.held.update(tuple(job.values()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(now + 1, self._due(job)))

    def _due(self, job: dict) -> int:
        if job["status"] in TERMINAL:
            return job["ended"] + self.ttl
        waits = [job["beat"] + self.heartbeat]
        if not job["stalled"]:
            waits.append(job["at"] + self.stall)
        if job["status"] == "cancelling":
            waits.append(job["ended"] + self.grace)
        return min(waits)

    @staticmethod
    def _row(key: str, kind: str, job: dict) -> tuple:
        text = frame(kind, key, job["status"], job["current"], job["total"], job["message"]) if kind in ("progress", "heartbeat") else None
        return key, kind, job["status"], job["current"], job["total"], job["message"], text

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"current": "int64", "total": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, job, out = timerValues.getCurrentProcessingTimeInMs(), self._load(), []
        for batch in rows:
            for r in batch.sort_values("ts", kind="stable").itertuples():
                to = after(job and job["status"], r.event)
                new = job or {"status": "pending", "current": 0, "total": 0, "message": None, "at": now, "beat": now, "ended": 0, "stalled": False}
                if to is None:
                    out.append(self._row(key[0], "refused", {**new, "message": str(r.event)}))
                    continue
                was = job and (job["status"], job["current"])
                ended = now if to != new["status"] and (to in TERMINAL or to == "cancelling") else new["ended"]
                number = lambda v, old: old if pd.isna(v) else int(v)
                job = {**new, "status": to, "current": number(r.current, new["current"]), "total": number(r.total, new["total"]), "message": r.message if isinstance(r.message, str) else new["message"], "at": now, "ended": ended, "stalled": False}
                if not self.on_change or was != (job["status"], job["current"]):
                    job["beat"] = now
                    out.append(self._row(key[0], "progress", job))
        if job is not None:
            self._save(job, now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, job, out = timerValues.getCurrentProcessingTimeInMs(), self._load(), []
        if job is not None and job["status"] in TERMINAL and now >= job["ended"] + self.ttl:
            out.append(self._row(key[0], "expired", job))
            self.held.clear()
        elif job is not None:
            if job["status"] == "cancelling" and now >= job["ended"] + self.grace:
                job.update(status="cancelled", ended=now, beat=now)
                out.append(self._row(key[0], "progress", job))
            elif job["status"] not in TERMINAL:
                if not job["stalled"] and now >= job["at"] + self.stall:
                    job["stalled"] = True
                    out.append(self._row(key[0], "stalled", job))
                if now >= job["beat"] + self.heartbeat:
                    job["beat"] = now
                    out.append(self._row(key[0], "heartbeat", job))
            self._save(job, now)
        yield self._frame(out)

    def close(self) -> None:
        pass


def track(events: DataFrame, **how) -> DataFrame:
    """What a stream of job events emits; needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Jobs(**how), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
