"""Rate limiter and job store as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limited(requests: DataFrame, key: str, ts: str, request_id: str, limit: int, window_s: float) -> DataFrame:
    """(key, request_id, allowed) for a stream of requests; idle keys' state goes after a window."""
    limit = max(1, int(limit))
    kinds = dict(requests.dtypes)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["__t", request_id], kind="stable")
        allowed = []
        for t in rows["__t"]:
            hits = [h for h in hits if h >= t - window_s]
            ok = len(hits) < limit
            if ok:
                hits.append(float(t))
            allowed.append(ok)
        state.update((hits,))
        state.setTimeoutDuration(int(window_s * 1000))
        yield pd.DataFrame({key: group[0], request_id: rows[request_id], "allowed": allowed})

    timed = requests.select(key, request_id, F.col(ts).cast("timestamp").cast("double").alias("__t"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {request_id} {kinds[request_id]}, allowed boolean", "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def job_states(events: DataFrame, ttl_s: float) -> DataFrame:
    """(job_id, status, n_events, frames): the job store fed by an event stream (job_id, seq, type, payload, ts).

    ``frames`` are the server-sent events the batch adds, in order; events after
    the TTL, or of unknown jobs, do nothing.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        born, status, n = state.get if state.exists else (None, None, 0)
        sent = []
        for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if r.type == "create":
                born, status, n = float(r.t), "queued", 0
            elif born is not None and r.t - born <= ttl_s:
                n += 1
                sent.append(f"event: {r.type}\ndata: {r.payload}\n\n")
                status = {"complete": "done", "fail": "error"}.get(r.type, "running" if status == "queued" else status)
        if born is None:
            return
        state.update((born, status, n))
        state.setTimeoutDuration(int(ttl_s * 1000))
        yield pd.DataFrame({"job_id": [group[0]], "status": [status], "n_events": [n], "frames": ["".join(sent)]})

    timed = events.select("job_id", "seq", "type", "payload", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return timed.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, n_events long, frames string", "born double, status string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
