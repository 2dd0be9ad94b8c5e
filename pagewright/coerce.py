"""Text values of a query to typed literals, by the column's Spark type and independent of any locale."""

from __future__ import annotations

import datetime
import uuid
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.errors import QueryError

_RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def parse(text: str, kind: T.DataType) -> object:
    """The Python value of text for a column of this type; raises QueryError if it has none."""
    try:
        if isinstance(kind, T.StringType):
            return text
        if (bits := _RANGES.get(type(kind))) is not None:
            value = int(text.strip().replace("_", "x"))
            if not -(1 << bits - 1) <= value < 1 << bits - 1:
                raise ValueError
            return value
        if isinstance(kind, T.DecimalType):
            return Decimal(text.strip())
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[text.strip().lower()]
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(text.strip())
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return datetime.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except (ValueError, KeyError, InvalidOperation):
        pass
    raise QueryError(f"{text!r} is not a value of type {kind.simpleString()}")


def literal(text: str, kind: T.DataType) -> Column:
    value = parse(text, kind)
    if isinstance(value, datetime.datetime) and isinstance(kind, T.TimestampType) and value.tzinfo is None:
        value = value.replace(tzinfo=datetime.UTC)
    return F.lit(value).cast(kind)


def canonical_uuid(text: str) -> str:
    """A uuid as stored: canonical lower case with dashes, whose text order is its byte order."""
    return str(uuid.UUID(text))
