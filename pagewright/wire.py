"""Queries as they come over the wire: query strings, clause grammar, limits, the legacy shape."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any
from urllib.parse import parse_qs

from pagewright.errors import QueryError
from pagewright.model import Filter, Mode, OffsetPage, Op, PagedQuery, Sort


@dataclass(frozen=True)
class Limits:
    default: int = 25
    most: int = 100


def parse_filters(texts: Iterable[str | None]) -> tuple[Filter, ...]:
    """field:op:value; a value may hold colons. Unknown operators and short clauses are dropped."""
    out = []
    for text in texts:
        parts = (text or "").split(":", 2) if (text or "").strip() else []
        if len(parts) < 2:
            continue
        op = next((o for o in Op if o.value == parts[1].lower()), None)
        bare = op in (Op.IS_NULL, Op.NOT_NULL)
        if op is None or (len(parts) != 3 and not bare):
            continue
        out.append(Filter(parts[0], op, "" if bare else parts[2]))
    return tuple(out)


def parse_sorts(texts: Iterable[str | None]) -> tuple[Sort, ...]:
    """field or field:direction; anything but desc is ascending."""
    pairs = [text.partition(":") for text in texts if text and text.strip()]
    return tuple(Sort(name, direction.lower() == "desc") for name, _, direction in pairs)


class _Params:
    def __init__(self, source: str | Mapping[str, list[str]]):
        self.values = parse_qs(source.lstrip("?"), keep_blank_values=True) if isinstance(source, str) else source

    def all(self, name: str) -> list[str]:
        return list(self.values.get(name, []))

    def text(self, name: str) -> str | None:
        return ",".join(self.all(name)) or None

    def number(self, name: str) -> int | None:
        try:
            return int(self.text(name) or "")
        except ValueError:
            return None

    def flag(self, name: str) -> bool | None:
        return {"true": True, "false": False}.get((self.text(name) or "").strip().lower())

    def names(self, name: str) -> tuple[str, ...]:
        """Repeated parameters or one with commas."""
        return tuple(x.strip() for value in self.all(name) for x in value.split(",") if x.strip())


def _limit(given: int | None, limits: Limits, name: str = "limit") -> int:
    value = limits.default if given is None else given
    if value > limits.most:
        raise QueryError(f"{name}={value} is over the maximum of {limits.most}")
    if value < 0:
        raise QueryError(f"{name} must not be negative")
    return value


def offset_query(source: str | Mapping[str, list[str]], limits: Limits = Limits()) -> PagedQuery:
    """q, fields, match_info, limit, sort, filter, page (from 0), count."""
    p = _Params(source)
    return PagedQuery(
        Mode.OFFSET, _limit(p.number("limit"), limits), p.text("q"), p.names("fields"), parse_sorts(p.all("sort")), parse_filters(p.all("filter")),
        page=p.number("page"), count=p.flag("count") is not False, match_info=bool(p.flag("match_info")),
    )


def cursor_query(source: str | Mapping[str, list[str]], limits: Limits = Limits()) -> PagedQuery:
    """q, fields, match_info, limit, sort, filter, and after or before."""
    p = _Params(source)
    after, before = p.text("after"), p.text("before")
    if after and before:
        raise QueryError("of after, before only one can say where a page lies")
    return PagedQuery(
        Mode.CURSOR, _limit(p.number("limit"), limits), p.text("q"), p.names("fields"), parse_sorts(p.all("sort")), parse_filters(p.all("filter")),
        cursor=after or before, backward=bool(before), match_info=bool(p.flag("match_info")),
    )


def legacy_query(source: str | Mapping[str, list[str]], limits: Limits = Limits()) -> PagedQuery:
    """The older shape: page, page_size, search, search_fields, include_match_info. include_hidden is read and unused."""
    p = _Params(source)
    return PagedQuery(
        Mode.OFFSET, _limit(p.number("page_size"), limits, "page_size"), p.text("search"), p.names("search_fields"), parse_sorts(p.all("sort")), parse_filters(p.all("filter")),
        page=p.number("page"), count=True, match_info=bool(p.flag("include_match_info")),
    )


def legacy_response(page: OffsetPage) -> dict[str, Any]:
    """items, page, count (the limit), total, match_info."""
    return {"items": [r.asDict(True) for r in page.items.collect()], "page": page.page, "count": page.limit, "total": page.total, "match_info": page.match_info}


def respond(answer: Any) -> tuple[int, dict[str, Any]]:
    """(status, body) of a call: 400 with a message for what the caller got wrong."""
    try:
        return 200, answer()
    except QueryError as error:
        return 400, {"error": str(error)}
