"""Filters: whitelisted fields and operators, typed values, one conjunction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright import coerce
from pagewright.errors import NotFilterable, OperatorNotAllowed, QueryError
from pagewright.model import Entity, Filter, Op, SearchPath


def _contains(column: Column, value: str) -> Column:
    """Case-insensitive substring; no character of value is a wildcard."""
    return F.contains(F.lower(column), F.lower(F.lit(value)))


def _items(value: str) -> list[str]:
    items = [x for x in (part.strip() for part in value.split(",")) if x]
    if not items:
        raise QueryError("in requires at least one value")
    return items


def predicate(clause: Filter, column: Column, kind: T.DataType) -> Column:
    """One clause; a null never satisfies a comparison."""
    if clause.op is Op.IS_NULL:
        return column.isNull()
    if clause.op is Op.NOT_NULL:
        return column.isNotNull()
    if clause.op is Op.CONTAINS:
        if not isinstance(kind, T.StringType):
            raise QueryError(f"contains needs a text field, {clause.field} is {kind.simpleString()}")
        return _contains(column, clause.value)
    if clause.op is Op.IN:
        return column.isin([coerce.literal(x, kind) for x in _items(clause.value)])
    value = coerce.literal(clause.value, kind)
    return {Op.EQ: column == value, Op.NEQ: column != value, Op.GT: column > value, Op.GTE: column >= value, Op.LT: column < value, Op.LTE: column <= value}[clause.op]


def check_filters(entity: Entity, clauses: Sequence[Filter]) -> None:
    for c in clauses:
        if c.field not in entity.filterable:
            raise NotFilterable(f"Field {c.field!r} of {entity.table} is not filterable")
        allowed = entity.filterable[c.field]
        if allowed and c.op not in allowed:
            raise OperatorNotAllowed(f"Operator {c.op.value!r} is not allowed on field {c.field!r} of {entity.table}")


def apply_filters(df: DataFrame, entity: Entity, clauses: Sequence[Filter]) -> DataFrame:
    """The rows that satisfy all clauses; comparisons with literals reach the Parquet scan."""
    check_filters(entity, clauses)
    if not clauses:
        return df
    terms = [predicate(c, F.col(entity.column(c.field)), df.schema[entity.column(c.field)].dataType) for c in clauses]
    return df.filter(reduce(and_, terms))


def restrict_fields(entity: Entity, paths: Sequence[SearchPath], names: Sequence[str]) -> list[SearchPath]:
    """Paths that a search names: by column or property at any depth, or table.column for joined fields; all if none are named."""
    if not names:
        return list(paths)
    wanted = {n.lower() for n in names}
    return [p for p in paths if p.column.lower() in wanted or p.searchable.field.lower() in wanted or (p.hops and f"{p.table}.{p.column}".lower() in wanted)]
