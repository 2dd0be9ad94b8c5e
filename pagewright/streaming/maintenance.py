"""Keeping indexes current: changed rows to owners to refreshed index rows, from batches or from a stream."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright import cursor
from pagewright.model import Entity, ReindexMode
from pagewright.operators import paging
from pagewright.operators.joins import candidate_frame, owners_of
from pagewright.plans.engine import Engine
from pagewright.sources.jobs import Job, JobQueue

log = logging.getLogger("pagewright")


def changed_rows(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old and new images of rows that differ between two snapshots of a table: inserted, deleted and changed ones."""
    columns = after.columns
    mark = F.xxhash64(*[F.struct(c) for c in columns])
    old = before.select(*columns).withColumn("_mark", mark)
    new = after.select(*columns).withColumn("_mark", mark)
    on = [*key, "_mark"]
    return old.join(new.select(*on), on, "left_anti").unionByName(new.join(old.select(*on), on, "left_anti")).drop("_mark")


def affected_owners(engine: Engine, entity: Entity, table: str, changed: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Owners whose indexed text changes with these rows of a table: the entity's own or one on any of its search paths."""
    key = list(entity.key_columns)
    found = changed.select(*key) if table == entity.table else None
    for path in {p.hops for p in entity.paths if p.hops}:
        for depth, hop in enumerate(path):
            if hop.table == table:
                owners = owners_of(engine.tables, entity, path[: depth + 1], changed)
                found = owners if found is None else found.unionByName(owners)
    if found is None:
        return engine.tables(entity.table).select(*key).limit(0)
    return found.distinct()


def refresh_changes(engine: Engine, entity: Entity, table: str, changed: DataFrame) -> list[str]:
    return engine.refresh(entity, affected_owners(engine, entity, table, changed))


def enqueue_changes(engine: Engine, queue: JobQueue, entity: Entity, table: str, changed: DataFrame, rebuild_beyond: int | None = None) -> int:
    """Targeted jobs for the owners of changed rows, one for each. The queue is a small table: a caller who expects many
    owners refreshes them at once (refresh_changes), or says beyond how many owners the groups are rebuilt instead."""
    owners = affected_owners(engine, entity, table, changed)
    found = (owners if rebuild_beyond is None else owners.limit(rebuild_beyond + 1)).collect()
    ids = [None] if rebuild_beyond is not None and len(found) > rebuild_beyond else [cursor.join_key(tuple(r)) for r in found]
    return sum(queue.enqueue(entity.table, g.name, ids) for g in entity.text_groups) if ids else 0


def watch(engine: Engine, entity: Entity, table: str, changes: DataFrame, checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Refresh from a stream of changed rows (old and new images); a batch that is replayed gives the same index."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh_changes(engine, entity, table, batch)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def run_job(engine: Engine, entity_name: str, group: str, jobs: Sequence[Job], progress: Callable[[str | None], None] = lambda last=None: None, delay: float = 0.0) -> None:
    """Run the jobs of one group: targeted ones refresh their owners together, any other builds the group batch by batch.

    A build that was stopped goes on after the last key that it reported.
    """
    entity = engine.registry[entity_name]
    kinds = [k for k, gs in (("fulltext", entity.text_groups), ("vector", entity.vector_groups)) if group in {g.name for g in gs}]
    if not kinds:
        raise ValueError(f"{entity_name} has no group {group!r}")
    base = engine.tables(entity.table)
    types = [base.schema[c].dataType for c in entity.key_columns]
    keys_of = lambda text: cursor.decode_keys(cursor.split_key(text, len(types)), types)
    whole = [j for j in jobs if not j.targeted]
    for kind in kinds:
        if whole:
            after = next((j.last_id for j in whole if j.last_id), None)
            resumable(engine, entity, group, whole[0].batch_size, keys_of(after) if after else None, lambda last: progress(cursor.join_key(last)), kind, delay, fresh=after is None)
        else:
            keys = [tuple(keys_of(j.last_id or "")) for j in jobs]
            engine.refresh(entity, candidate_frame(base, entity, keys), kind, [group])
            progress()


def drain(engine: Engine, queue: JobQueue, delay: float = 0.0) -> int:
    return queue.drain(lambda entity, group, jobs, progress: run_job(engine, entity, group, jobs, progress, delay))


def work(engine: Engine, queue: JobQueue, every: float = 30.0, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Poll the queue; rounds bounds the polls, endless by default. An error of a poll is logged and the next one comes."""
    done, k = 0, 0
    while rounds is None or k < rounds:
        try:
            done += drain(engine, queue)
        except Exception:  # storage that is away for a while does not end the worker
            log.exception("poll of the reindex queue failed")
        k += 1
        if rounds is None or k < rounds:
            sleep(every)
    return done


def apply_mode(engine: Engine, queue: JobQueue, entity: Entity, mode: ReindexMode) -> int:
    """Inline builds now, concurrent enqueues, deferred does nothing. Returns builds or jobs."""
    if mode is ReindexMode.INLINE:
        return len(engine.reindex(entity))
    if mode is ReindexMode.CONCURRENT:
        return sum(queue.enqueue(entity.table, g.name) for g in (*entity.text_groups, *entity.vector_groups))
    return 0


def next_keys(engine: Engine, entity: Entity, size: int, after: Sequence[object] | None = None, inclusive: bool = False) -> DataFrame:
    """The next keys of a table in key order, for resumable builds: more than after, or from it on."""
    base, key = engine.tables(entity.table), list(entity.key_columns)
    rows = base.select(*key)
    if after is not None:
        kinds = [base.schema[c].dataType for c in key]
        beyond = paging.after([(c, False) for c in key], after, kinds)
        if inclusive:
            at = F.lit(True)
            for c, v, kind in zip(key, after, kinds, strict=True):
                at = at & (F.col(c) == F.lit(v).cast(kind))
            beyond = beyond | at
        rows = rows.filter(beyond)
    return rows.orderBy(*key).limit(size)


def batch_summary(keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """(affected, last_key): how many keys a batch has and the greatest, in one aggregate."""
    return keys.agg(F.count("*").alias("affected"), F.max(F.struct(*key)).alias("last")).select("affected", *[F.col(f"last.{k}").alias(f"last_{k}") for k in key])


def batch_bounds(engine: Engine, entity: Entity, size: int, after: Sequence[object] | None = None) -> list[tuple[int, tuple]]:
    """(rows, last key) of batches of about size rows in key order, from one range sort of the keys.

    One row for each batch reaches the driver.
    """
    base, key = engine.tables(entity.table), list(entity.key_columns)
    rows = base.select(*key)
    if after is not None:
        rows = rows.filter(paging.after([(c, False) for c in key], after, [base.schema[c].dataType for c in key]))
    n = rows.count()
    if not n:
        return []
    dealt = rows.repartitionByRange(max(1, -(-n // size)), *key)
    found = dealt.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("n"), F.max(F.struct(*key)).alias("last")).collect()
    return sorted(((r["n"], tuple(r["last"])) for r in found), key=lambda x: x[1])


def resumable(
    engine: Engine, entity: Entity, group: str, size: int = 5000, after: Sequence[object] | None = None, on_batch: Callable[[tuple], None] | None = None,
    kind: str | None = None, delay: float = 0.0, fresh: bool = False,
) -> int:
    """Build a group batch by batch in key order, telling on_batch the last key of each, so a stopped build can resume.

    Batches are cut once, and each appends a delta of its own keys, so the work is that of the table and not of the
    batches times the table. fresh starts an empty index first if there is none or another definition's; owners that
    are gone from the table leave when it is built from the start.
    """
    base, key = engine.tables(entity.table), list(entity.key_columns)
    kinds = [base.schema[c].dataType for c in key]
    kind = kind or ("fulltext" if group in {g.name for g in entity.text_groups} else "vector")
    if fresh:
        engine.start_index(entity, kind, group)
    done = 0
    for n, last in batch_bounds(engine, entity, size, after):
        keys = base.select(*key)
        if after is not None:
            keys = keys.filter(paging.after([(c, False) for c in key], after, kinds))
        keys = keys.filter(~paging.after([(c, False) for c in key], last, kinds))
        engine.refresh(entity, keys, kind, [group])
        done, after = done + n, last
        if on_batch:
            on_batch(tuple(last))
        if delay:
            time.sleep(delay)
    return done
