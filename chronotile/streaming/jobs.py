"""ST2: detection jobs of a runner with one slot, as keyed state over a stream of events."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "runner string, job_id long, status string, at long"
#: The running job and since when (0 for none), jobs whose runner died, and those that wait, oldest first.
STATE = "running long, since long, orphans array<long>, waits array<long>, waiting array<long>"


class Slot:
    """One runner's jobs. Times are milliseconds; ``changes`` are (job_id, status, time)."""

    def __init__(self, running: int = 0, since: int = 0, orphans: Iterable[int] = (), waits: Iterable[int] = (), waiting: Iterable[int] = ()) -> None:
        self.running, self.since, self.orphans = running, since, list(orphans)
        self.queue = sorted(zip(waits, waiting, strict=True))
        self.changes: list[tuple[int, str, int]] = []

    def state(self) -> tuple:
        return self.running, self.since, self.orphans, [t for t, _ in self.queue], [j for _, j in self.queue]

    def _start(self, job: int, at: int) -> None:
        self.running, self.since = job, at
        self.changes.append((job, "running", at))

    def repair(self, at: int) -> None:
        """MU10: unless a job runs, jobs of a dead runner have failed, and the oldest waiting one starts."""
        if self.running:
            return
        self.changes += [(job, "failed", at) for job in self.orphans]
        self.orphans = []
        if self.queue:
            self._start(self.queue.pop(0)[1], at)

    def take(self, job: int, kind: str, at: int) -> None:
        """queued: starts if the slot is free, else waits. started: a job that ran when the runner died. completed or failed: frees the slot.
        repair: as above. restart: the runner died, so its job is repaired with the others."""
        if kind == "queued":
            if self.running:
                insort(self.queue, (at, job))
                self.changes.append((job, "queued", at))
            else:
                self._start(job, at)
        elif kind == "waiting":
            insort(self.queue, (at, job))
        elif kind == "started":
            self.orphans.append(job)
        elif kind in ("completed", "failed") and job == self.running:
            self.running = self.since = 0
            self.changes.append((job, kind, at))
        elif kind in ("repair", "restart"):
            if kind == "restart" and self.running:
                self.orphans.append(self.running)
                self.running = self.since = 0
            self.repair(at)


def job_changes(events: DataFrame, stale_after_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """Changes of status (runner, job_id, status, at) from a stream of (runner, job_id, kind, ts), kinds as in ``Slot.take``, and ``waiting`` for
    jobs that wait from before.

    Events of a runner are taken in the order of ts and job_id within a micro-batch. With ``stale_after_ms`` a job that runs longer is
    failed by a timer on event time and the next one starts. A runner's state is its waiting jobs, in one task; runners spread.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot = Slot(*state.get) if state.exists else Slot()
        if state.hasTimedOut:
            at = slot.since + stale_after_ms
            slot.take(0, "restart", at)
        rows = pd.concat(batches, ignore_index=True) if not state.hasTimedOut else pd.DataFrame()
        if len(rows):
            for r in rows.sort_values(["at", "job_id"], kind="stable").itertuples():
                slot.take(int(r.job_id), r.kind, int(r.at))
        state.update(slot.state())
        if stale_after_ms is not None and slot.running:
            state.setTimeoutTimestamp(max(slot.since + stale_after_ms, state.getCurrentWatermarkMs() + 1))
        if slot.changes:
            yield pd.DataFrame([(key[0], *c) for c in slot.changes], columns=["runner", "job_id", "status", "at"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if stale_after_ms is not None else timed
    rows = timed.select("runner", "job_id", "kind", "ts", F.unix_millis("ts").alias("at"))
    timeout = GroupStateTimeout.NoTimeout if stale_after_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("runner").applyInPandasWithState(run, OUT, STATE, "append", timeout)
