"""The reindex queue: a small table of jobs in numbered JSON files, changed by compare and set.

Any number of workers may share it: each change is written only if no other came first, else made again on top of it,
so a job is claimed once and no change is lost. A group is drained by one worker at a time, which holds it by a lease:
its running jobs, renewed with every batch that it reports. A worker that stops lets its lease run out, and the next
one goes on after the last key that was reported.
"""

from __future__ import annotations

import datetime
import logging
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.index import Files, Numbered

log = logging.getLogger("pagewright")

#: A running job that has not been heard of for so long may be claimed by another worker.
STALE = datetime.timedelta(minutes=5)
LONGEST_ERROR = 4000


@dataclass(frozen=True)
class Job:
    """last_id is the owner of a targeted job, and else the last key that a build has reported."""

    id: int
    entity: str
    group_name: str
    status: str = "pending"
    batch_size: int = 5000
    last_id: str | None = None
    enqueued_at: str = ""
    started_at: str | None = None
    finished_at: str | None = None
    error: str | None = None
    targeted: bool = False


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


def _stale(job: Job, now: datetime.datetime) -> bool:
    return job.started_at is not None and now - datetime.datetime.fromisoformat(job.started_at) > STALE


class JobQueue:
    """Bounded by what is waiting: done jobs are dropped by forget()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._state = Numbered(Files(spark), path)

    def jobs(self) -> list[Job]:
        return _jobs(self._state.read()[1])

    def _change(self, change: Callable[[list[Job]], list[Job]]) -> list[Job]:
        return _jobs(self._state.update(lambda value, _: [asdict(j) for j in change(_jobs(value))]))

    def enqueue(self, entity: str, group: str, last_ids: Sequence[str | None] = (None,), batch_size: int = 5000) -> int:
        """Add pending jobs, one for each id, unless an equal one is pending; returns how many were added."""
        added: list[Job] = []

        def change(jobs: list[Job]) -> list[Job]:
            added.clear()
            pending = {(j.entity, j.group_name, j.last_id if j.targeted else None) for j in jobs if j.status == "pending"}
            at = max((j.id for j in jobs), default=0)
            for last in dict.fromkeys(last_ids):
                if (entity, group, last) not in pending:
                    added.append(Job(at + len(added) + 1, entity, group, batch_size=batch_size, last_id=last, enqueued_at=_now().isoformat(), targeted=last is not None))
            return [*jobs, *added]

        self._change(change)
        return len(added)

    def claimable(self, now: datetime.datetime | None = None) -> list[Job]:
        """Pending and failed jobs, and running ones that went stale, oldest first; none of a group that a worker holds."""
        return _claimable(self.jobs(), now or _now())

    def claim(self, entity: str, group: str) -> list[Job]:
        """Mark the claimable jobs of a group as running, equal ones collapsed into the one with the least id. Empty if
        another worker holds the group."""
        taken: set[int] = set()

        def change(jobs: list[Job]) -> list[Job]:
            taken.clear()
            able = [j for j in _claimable(jobs, _now()) if (j.entity, j.group_name) == (entity, group)]
            first: dict[str | None, Job] = {}
            for j in sorted(able, key=lambda j: j.id):
                known = first.setdefault(j.last_id if j.targeted else None, j)
                if not j.targeted and j.last_id is not None and known.last_id is None:
                    first[None] = replace(known, last_id=j.last_id)  # a build that stopped goes on
            keep, gone = {j.id: j for j in first.values()}, {j.id for j in able}
            taken.update(keep)
            started = _now().isoformat()
            return [replace(keep.get(j.id, j), status="running", started_at=started, error=None) if j.id in keep else j for j in jobs if j.id in keep or j.id not in gone]

        return sorted((j for j in self._change(change) if j.id in taken), key=lambda j: j.id)

    def progress(self, ids: Sequence[int], last_id: str | None = None) -> None:
        """Renew the lease of running jobs, and note how far the builds among them have come."""
        started = _now().isoformat()
        self._change(lambda jobs: [replace(j, started_at=started, last_id=j.last_id if j.targeted or last_id is None else last_id) if j.id in set(ids) else j for j in jobs])

    def finish(self, ids: Sequence[int], error: str | None = None) -> None:
        status = "failed" if error else "done"
        self._change(lambda jobs: [replace(j, status=status, finished_at=_now().isoformat(), error=error and error[:LONGEST_ERROR]) if j.id in set(ids) else j for j in jobs])

    def forget(self) -> None:
        self._change(lambda jobs: [j for j in jobs if j.status != "done"])

    def drain(self, run: Callable[[str, str, list[Job], Callable[[str | None], None]], None]) -> int:
        """Run what is claimable, group by group; a failure marks its jobs and does not stop the others. Returns jobs done.

        run gets a function that renews the lease and notes the last key of a batch.
        """
        done = 0
        for entity, group in dict.fromkeys((j.entity, j.group_name) for j in self.claimable()):
            jobs = self.claim(entity, group)
            ids = [j.id for j in jobs]
            if not ids:
                continue  # another worker was first
            try:
                run(entity, group, jobs, lambda last=None, ids=ids: self.progress(ids, last))
            except Exception as error:  # the queue outlives any job
                log.exception("jobs %s of %s, group %s, failed", ids, entity, group)
                self.finish(ids, str(error) or type(error).__name__)
            else:
                self.finish(ids)
                done += len(ids)
        return done

    def frame(self) -> DataFrame:
        """The jobs as a table."""
        return self.spark.createDataFrame(
            [tuple(asdict(j).values()) for j in self.jobs()],
            "id long, entity string, group_name string, status string, batch_size int, last_id string, enqueued_at string, started_at string, finished_at string, error string, targeted boolean",
        )


def _jobs(value: object | None) -> list[Job]:
    return [Job(**x) for x in value or []]


def _claimable(jobs: Sequence[Job], now: datetime.datetime) -> list[Job]:
    held = {(j.entity, j.group_name) for j in jobs if j.status == "running" and not _stale(j, now)}
    able = [j for j in jobs if j.status in ("pending", "failed") or (j.status == "running" and _stale(j, now))]
    return sorted((j for j in able if (j.entity, j.group_name) not in held), key=lambda j: (j.enqueued_at, j.id))


def collapse(jobs: DataFrame) -> DataFrame:
    """Jobs without duplicates: of each (entity, group_name, last_id) the one with the least id, as a plan over a job table."""
    first = F.min_by(F.struct(*jobs.columns), "id").alias("job")
    return jobs.groupBy("entity", "group_name", F.coalesce("last_id", F.lit("")).alias("_at"), F.col("last_id").isNull().alias("_none")).agg(first).select("job.*")


def enqueue_frame(pending: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (entity, group_name, last_id) that no pending job covers yet."""
    same = [wanted[c].eqNullSafe(pending[c]) for c in ("entity", "group_name", "last_id")]
    return wanted.distinct().join(pending, same, "left_anti")
