"""Errors that callers can tell apart."""


class QueryError(ValueError):
    """A query that the entity or the engine does not admit."""


class NotFilterable(QueryError):
    pass


class OperatorNotAllowed(QueryError):
    pass


class NotSortable(QueryError):
    pass


class InvalidCursor(QueryError):
    pass


class UnknownEntity(QueryError):
    pass


class ModelError(ValueError):
    """An entity that contradicts itself or its table."""


class IndexNotReady(RuntimeError):
    """An index that is missing, or was built for another model or size."""
