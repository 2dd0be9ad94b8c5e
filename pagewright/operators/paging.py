"""Order, pages and keyset predicates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright import cursor
from pagewright.errors import NotSortable, QueryError
from pagewright.model import Entity, Sort


def check_sorts(entity: Entity, sorts: Sequence[Sort]) -> None:
    for s in sorts:
        if s.field not in entity.sortable:
            raise NotSortable(f"Field {s.field!r} of {entity.table} is not sortable")


def check_limits(limit: int, page: int | None) -> None:
    if limit < 0 or (page or 0) < 0:
        raise QueryError("limit and page must not be negative")


def order_of(column: str | Column, descending: bool) -> Column:
    """Nulls count as larger than any value: last ascending, first descending."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def offset_order(entity: Entity, sorts: Sequence[Sort]) -> list[tuple[str, bool]]:
    """Sort columns and then all parts of the key, ascending, so that ties have one order."""
    check_sorts(entity, sorts)
    out = [(entity.column(s.field), s.descending) for s in sorts]
    return out + [(c, False) for c in entity.key_columns if c not in {x for x, _ in out}]


def keyset_order(entity: Entity, sorts: Sequence[Sort]) -> list[tuple[str, bool]]:
    """Sort columns and then the missing key parts, in the direction of the last sort."""
    check_sorts(entity, sorts)
    out = [(entity.column(s.field), s.descending) for s in sorts]
    tie = sorts[-1].descending if sorts else False
    return out + [(c, tie) for c in entity.key_columns if c not in {x for x, _ in out}]


def offset_page(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, offset: int) -> DataFrame:
    """A page by offset; Spark plans this as a top-k, not as a full sort."""
    ordered = df.orderBy(*[order_of(c, d) for c, d in order])
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def after(order: Sequence[tuple[str, bool]], values: Sequence[Any], kinds: Sequence[T.DataType]) -> Column:
    """Rows that come strictly after the given values in this order, nulls included, as an expansion column by column."""
    result: Column = F.lit(False)
    same: Column = F.lit(True)
    for (name, descending), value, kind in zip(order, values, kinds, strict=True):
        column = F.col(name)
        if value is None:
            beyond = column.isNotNull() if descending else F.lit(False)
            equal = column.isNull()
        else:
            at = F.lit(value).cast(kind)
            beyond = (column < at) if descending else ((column > at) | column.isNull())
            equal = column == at
        result = result | (same & beyond)
        same = same & equal
    return F.coalesce(result, F.lit(False))


def flip(order: Sequence[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The opposite order. Nulls change sides with it, as they count as largest."""
    return [(c, not d) for c, d in order]


def anchor(row: Any, order: Sequence[tuple[str, bool]], key: Sequence[str], print_: str) -> str:
    """The token of a row: its sort values and its key."""
    return cursor.encode(cursor.Token(cursor.KEYSET, tuple(cursor.value_text(row[c]) for c, _ in order if c not in key), tuple(cursor.key_text(row[c]) for c in key), print_))
