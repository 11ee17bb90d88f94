"""Stateful checks over a stream of job events: which change of status is allowed, and how often a message was delivered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkspan.operators.jobs import MAX_RETRIES
from inkspan.schemas import STATUSES, TRANSITIONS

CHECKED = "job_id string, seq long, previous_status string, status string, allowed boolean"
DELIVERED = "message_id string, retry_count int, outcome string"


def _allowed(before: str | None, after: str) -> bool:
    return after in STATUSES if before is None else before == after or after in TRANSITIONS.get(before, ())


def _check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for seq, status in sorted((s, t) for b in batches for s, t in zip(b["seq"], b["status"], strict=True)):
        ok = _allowed(last, status)
        rows.append((key[0], seq, last, status, ok))
        last = status if ok else last
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(rows, columns=["job_id", "seq", "previous_status", "status", "allowed"])


def check_transitions(events: DataFrame) -> DataFrame:
    """A stream of (job_id, seq, status): each with the status it was checked against. A change that is not allowed leaves the job's status as it was."""
    rows = events.select("job_id", "seq", "status")
    return rows.groupBy("job_id").applyInPandasWithState(_check, CHECKED, "status string", "append", GroupStateTimeout.NoTimeout)


def _deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    count = state.get[0] if state.exists else -1
    outcome = None
    if state.hasTimedOut:
        outcome = "idle"
    else:
        kinds = [k for b in batches for k in b["kind"]]
        for kind in kinds:
            if kind == "ack":
                state.remove()
                yield pd.DataFrame([(key[0], max(count, 0), "done")], columns=["message_id", "retry_count", "outcome"])
                return
            count += 1
            outcome = "failed" if count >= MAX_RETRIES else "delivered"
    if outcome == "idle":
        count += 1
        outcome = "failed" if count >= MAX_RETRIES else "reclaimed"
    if outcome == "failed":
        state.remove()
    elif outcome:
        state.update((count,))
        state.setTimeoutDuration(idle_ms)
    if outcome:
        yield pd.DataFrame([(key[0], count, outcome)], columns=["message_id", "retry_count", "outcome"])


def track_deliveries(events: DataFrame, idle_ms: int = 30_000) -> DataFrame:
    """A stream of (message_id, kind: delivery or ack). A message without an ack is reclaimed after idle_ms; each delivery or reclaim adds one to its count, and the third retry
    fails it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _deliver(key, batches, state, idle_ms)

    rows = events.select("message_id", F.col("kind"))
    return rows.groupBy("message_id").applyInPandasWithState(step, DELIVERED, "count int", "append", GroupStateTimeout.ProcessingTimeTimeout)
