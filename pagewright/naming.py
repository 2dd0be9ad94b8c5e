"""Table and column names from the names of types and properties."""

from __future__ import annotations


def identity(name: str) -> str:
    return name


def snake_case(name: str) -> str:
    """OrderItem -> order_item; within a run of capitals only the last starts a word (HTTPServer -> http_server)."""
    out = []
    for k, char in enumerate(name):
        if char.isupper():
            starts = k > 0 and (name[k - 1].islower() or (k + 1 < len(name) and name[k + 1].islower()))
            out.append("_" * starts + char.lower())
        else:
            out.append(char)
    return "".join(out)


def plural(name: str) -> str:
    """Naive English plural: s stays, y becomes ies, anything else gets an s."""
    if name.endswith("s"):
        return name
    return name[:-1] + "ies" if name.endswith("y") else name + "s"


def table_name(type_name: str) -> str:
    return plural(snake_case(type_name))
