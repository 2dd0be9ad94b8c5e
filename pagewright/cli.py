"""python -m pagewright.cli reindex|reindex-status: enqueue and drain, or list the queue.

Exit codes: 0 done, 1 unknown entity, 2 nothing to connect to.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Sequence

from pagewright import cursor
from pagewright.errors import UnknownEntity
from pagewright.plans.engine import Engine
from pagewright.sources.jobs import JobQueue
from pagewright.streaming.maintenance import drain, resumable


def _load(spec: str) -> tuple[Engine, JobQueue]:
    """module:function that returns (engine, queue)."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)()


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("reindex", "reindex-status"):
        command = commands.add_parser(name)
        command.add_argument("--app", help="module:function that returns (engine, queue)")
        command.add_argument("--entity", required=name == "reindex")
        command.add_argument("--group", default=None)
        command.add_argument("--batch-size", type=int, default=5000)
        command.add_argument("--delay", type=float, default=0.0, help="seconds between batches")
        command.add_argument("--start-after", default=None, help="key after which to go on, without the queue; parts of a key are joined by |")
    args = parser.parse_args(argv)
    if not args.app:
        print("--app is required: it names the session, tables and entities", file=sys.stderr)
        return 2
    try:
        engine, queue = _load(args.app)
    except (ImportError, AttributeError) as error:
        print(f"cannot load {args.app}: {error}", file=sys.stderr)
        return 2
    if args.command == "reindex-status":
        for j in queue.jobs():
            if args.entity in (None, j.entity):
                print("\t".join(map(str, (j.id, j.entity, j.group_name, j.status, j.last_id or "-", j.error or "-"))))
        return 0
    try:
        entity = engine.registry[args.entity]
    except UnknownEntity as error:
        print(error, file=sys.stderr)
        return 1
    names = [g.name for g in (*entity.text_groups, *entity.vector_groups) if args.group in (None, g.name)]
    if args.start_after is not None:
        base = engine.tables(entity.table)
        kinds = [base.schema[c].dataType for c in entity.key_columns]
        after = cursor.decode_keys(cursor.split_key(args.start_after, len(kinds)), kinds)
        for name in names:
            print(f"{name}: {resumable(engine, entity, name, args.batch_size, after, delay=args.delay)} row(s)")
        return 0
    for name in names:
        queue.enqueue(entity.table, name, batch_size=args.batch_size)
    print(f"{drain(engine, queue, args.delay)} job(s) done")
    return 0


if __name__ == "__main__":
    sys.exit(main())
