"""HTTP: entities behind paths of a WSGI application, from query string to JSON and back.

GET <path>?q=...&limit=... answers 200 with a page, 400 with a problem for what the caller got wrong, 404 for an unknown
path, 405 for another method, and 503 where an index is not built yet. Limits are the engine's own unless a route has others.
"""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row

from pagewright.errors import IndexNotReady, QueryError
from pagewright.model import CursorPage, Entity, Mode, OffsetPage
from pagewright.plans.engine import Engine
from pagewright.wire import Limits, cursor_query, legacy_query, offset_query


@dataclass(frozen=True)
class Route:
    """An entity, how its pages are counted, its limits, and whether the older query shape is spoken."""

    entity: Entity
    mode: Mode = Mode.OFFSET
    limits: Limits | None = None
    legacy: bool = False


def plain(value: Any) -> Any:
    """A value as JSON has it: rows are objects, times ISO text, decimals text."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, float) and value != value:
        return None
    return value


def offset_response(page: OffsetPage, rows: Iterable[Row]) -> dict[str, Any]:
    return {"items": [plain(r) for r in rows], "limit": page.limit, "page": page.page, "total": page.total, "has_more": page.has_more, "has_prev": page.has_prev, "match_info": page.match_info}


def cursor_response(page: CursorPage) -> dict[str, Any]:
    return {
        "items": [plain(r) for r in page.items], "limit": page.limit, "next_cursor": page.next_cursor, "prev_cursor": page.prev_cursor,
        "has_more": page.has_more, "has_prev": page.has_prev, "match_info": page.match_info,
    }


class Endpoint:
    """A WSGI application over routes by path."""

    def __init__(self, engine: Engine, routes: Mapping[str, Route]):
        self.engine, self.routes = engine, {p.rstrip("/"): r for p, r in routes.items()}

    def answer(self, path: str, query_string: str) -> tuple[int, dict[str, Any]]:
        route = self.routes.get(path.rstrip("/"))
        if route is None:
            return 404, _problem(404, f"nothing is served at {path}")
        options = self.engine.options
        limits = route.limits or Limits(options.default_limit, options.most_limit)
        try:
            if route.mode is Mode.CURSOR:
                return 200, cursor_response(self.engine.search_cursor(route.entity, cursor_query(query_string, limits)))
            page, rows = self.engine.fetch_offset(route.entity, (legacy_query if route.legacy else offset_query)(query_string, limits))
            if route.legacy:
                return 200, {"items": [plain(r) for r in rows], "page": page.page, "count": page.limit, "total": page.total, "match_info": page.match_info}
            return 200, offset_response(page, rows)
        except QueryError as error:
            return 400, _problem(400, str(error))
        except IndexNotReady as error:
            return 503, _problem(503, str(error))

    def __call__(self, environ: Mapping[str, Any], start_response: Callable) -> list[bytes]:
        if environ.get("REQUEST_METHOD", "GET") not in ("GET", "HEAD"):
            status, body = 405, _problem(405, "only GET is served")
        else:
            status, body = self.answer(environ.get("PATH_INFO", ""), environ.get("QUERY_STRING", ""))
        out = json.dumps(body, ensure_ascii=False).encode()
        kind = "application/json" if status == 200 else "application/problem+json"
        start_response(f"{status} {_REASONS[status]}", [("Content-Type", kind), ("Content-Length", str(len(out)))])
        return [out]


_REASONS = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 503: "Service Unavailable"}


def _problem(status: int, detail: str) -> dict[str, Any]:
    return {"status": status, "title": _REASONS[status], "detail": detail}
