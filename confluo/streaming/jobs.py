"""Queue jobs as keyed state with timers: a job comes due again by what became of it, and its state goes when nothing happens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from confluo.functions.status import ATTEMPTS, RECHECK_HOURS, RETRY_HOURS

OUT = "url string, event string, status string, attempts int, next_check_ms long"
STATE = "status string, attempts int, seq long, priority string"
REFUSED = ("blocked", "invalid")


def fetched(http: float | None, matched: bool | None, parsed: bool | None, attempts: int) -> str:
    """What becomes of a job, as functions.status.outcome has it."""
    if http is None or http != http:
        return "deferred"
    if http in (401, 403):
        return "blocked"
    if http == 429 and attempts < ATTEMPTS:
        return "deferred"
    if 400 <= http < 500:
        return "invalid"
    return "deferred" if http >= 500 or not parsed else "done" if matched else "unmatched"


def delay_hours(status: str, priority: str | None) -> int | None:
    """Hours until a job is due, as functions.status.next_check has them; None if it never is."""
    return None if status in REFUSED else RETRY_HOURS if status == "deferred" else RECHECK_HOURS.get(priority, RECHECK_HOURS["low"])


def job_queue(stream: DataFrame, ttl_hours: int = 30 * 24, hour_ms: int = 3_600_000) -> DataFrame:
    """url, event, status, attempts, next_check_ms of jobs whose state changes.

    stream: url, seq (long; rising with each fetch of a job), http (int; null where there was no answer), matched, parsed, priority
    (high, medium, low). events: `fetched` once a batch in which a job has news; `due` when its timer fires (6, 48 or 168 hours after
    a page was read, 24 after a failure); `expired` when the state is dropped: refused jobs, and due ones that nobody fetched, after
    `ttl_hours`. Rows of a seq that was seen already change nothing, so input that comes again does no harm. Attempts count the
    failures since a page was last read. Timers go by the clock of the cluster; hour_ms is the length of an hour.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()

        def told(event: str, status: str, attempts: int, due: int | None) -> pd.DataFrame:
            return pd.DataFrame({"url": [key[0]], "event": [event], "status": [status], "attempts": pd.array([attempts], "int32"), "next_check_ms": pd.array([due], "Int64")})

        if state.hasTimedOut:
            status, attempts, seq, priority = state.get
            if status in REFUSED or status == "due":
                state.remove()
                yield told("expired", status, attempts, None)
            else:
                state.update(("due", attempts, seq, priority))
                state.setTimeoutDuration(max(1, ttl_hours * hour_ms))
                yield told("due", status, attempts, now)
            return
        status, attempts, seq, priority = state.get if state.exists else ("pending", 0, -1, None)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable").drop_duplicates("seq")
        rows = rows[rows["seq"] > seq]
        for r in rows.itertuples():
            attempts += 1
            priority = r.priority if isinstance(r.priority, str) else priority
            status = fetched(None if pd.isna(r.http) else int(r.http), bool(r.matched) if not pd.isna(r.matched) else False, bool(r.parsed) if not pd.isna(r.parsed) else False, attempts)
            attempts = attempts if status == "deferred" else 0 if status in ("done", "unmatched") else attempts
            seq = int(r.seq)
        hours = delay_hours(status, priority)
        wait = max(1, (ttl_hours if hours is None else hours) * hour_ms)
        if len(rows):
            state.update((status, attempts, seq, priority))
            state.setTimeoutDuration(wait)
            yield told("fetched", status, attempts, None if hours is None else now + wait)
        elif state.exists:
            state.setTimeoutDuration(wait if status != "due" else max(1, ttl_hours * hour_ms))

    return stream.groupBy("url").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
