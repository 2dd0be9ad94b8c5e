"""Full text: token columns, a query language, matching, and cover-density rank.

A text column becomes an array of (lexeme, pos, label). Matching looks only at the tokens of the query's own
lexemes, which are filtered out JVM-side; phrases and rank work on those few.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.errors import QueryError
from pagewright.functions.stem import STOP_WORDS, porter
from pagewright.model import Parser

TOKENS = "array<struct<lexeme:string,pos:int,label:string>>"
#: Rank of a hit by label (fixed values).
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
CONFIGS = ("simple", "english")
_GAP = r"[^\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")


def normal(word: str, config: str) -> str | None:
    """The lexeme of a word, or None for a stop word."""
    word = word.lower()
    if config == "english":
        return None if word in STOP_WORDS else porter(word)
    return word


def check_config(config: str) -> str:
    if config not in CONFIGS:
        raise QueryError(f"text configuration {config!r} is unknown: {', '.join(CONFIGS)}")
    return config


def tokens(text: Column, config: str, label: str) -> Column:
    """Tokens of a text with positions from 1; stop words leave gaps. Null gives none."""
    check_config(config)
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP), lambda w: w != "")
    placed = F.transform(words, lambda w, k: F.struct(w.alias("lexeme"), (k + 1).cast("int").alias("pos"), F.lit(label).alias("label")))
    if config == "simple":
        return placed

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: [porter(w) for w in ws])

    kept = F.filter(placed, lambda t: ~t["lexeme"].isin(*STOP_WORDS))
    return F.zip_with(kept, stems(F.transform(kept, lambda t: t["lexeme"])), lambda t, s: F.struct(s.alias("lexeme"), t["pos"].alias("pos"), t["label"].alias("label")))


def joined(parts: Sequence[Column]) -> Column:
    """Token columns one after another; positions of later ones follow those of earlier ones."""

    def two(a: Column, b: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(a, lambda t: t["pos"])), F.lit(0))
        return F.concat(a, F.transform(b, lambda t: F.struct(t["lexeme"].alias("lexeme"), (t["pos"] + last).alias("pos"), t["label"].alias("label"))))

    return reduce(two, parts)


@dataclass(frozen=True)
class Term:
    lexeme: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    """Terms at given distances from the first."""

    terms: tuple[Term, ...]
    gaps: tuple[int, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Query = Term | Phrase | And | Or | Not


def _phrase(words: Sequence[str], config: str) -> Query | None:
    found = [(k, lexeme) for k, w in enumerate(words) if (lexeme := normal(w, config)) is not None]
    if not found:
        return None
    if len(found) == 1:
        return Term(found[0][1])
    return Phrase(tuple(Term(x) for _, x in found), tuple(k - found[0][0] for k, _ in found))


def _all(kind: type, parts: Sequence[Query | None]) -> Query | None:
    have = [p for p in parts if p is not None]
    return None if not have else have[0] if len(have) == 1 else kind(tuple(have))


def _websearch(text: str, config: str) -> Query | None:
    """Words, "phrases", or, and a leading minus; never raises."""
    pieces = re.findall(r'(-?)"([^"]*)(?:"|$)|(-?)([^\s"]+)', text)
    groups: list[list[Query | None]] = [[]]
    for minus_q, quoted, minus_w, word in pieces:
        if word and not minus_w and word.lower() == "or":
            if groups[-1]:
                groups.append([])
            continue
        words = _WORD.findall(quoted if quoted or minus_q else word)
        part = _phrase(words, config)
        if part is not None:
            groups[-1].append(Not(part) if (minus_q or minus_w) else part)
    return _all(Or, [_all(And, g) for g in groups if g])


def _raw(text: str, config: str) -> Query | None:
    """Operators & | ! <-> <n>, parentheses, quotes and :* for prefixes; raises on bad syntax."""
    marks = re.findall(r"<->|<\d+>|[&|!()]|'(?:[^']|'')*'(?::[*A-Da-d]+)?|[^\s&|!()<>':]+(?::[*A-Da-d]+)?|\S", text)
    at = 0

    def peek() -> str | None:
        return marks[at] if at < len(marks) else None

    def take() -> str:
        nonlocal at
        if at >= len(marks):
            raise QueryError(f"syntax error in text query {text!r}")
        at += 1
        return marks[at - 1]

    def one() -> Query | None:
        mark = take()
        if mark == "!":
            inner = one()
            return Not(inner) if inner is not None else None
        if mark == "(":
            inner = either()
            if take() != ")":
                raise QueryError(f"syntax error in text query {text!r}")
            return inner
        if mark in ("&", "|", ")") or mark.startswith("<"):
            raise QueryError(f"syntax error in text query {text!r}")
        word, _, flags = mark.partition(":") if not mark.startswith("'") else (mark[1:].rpartition("'")[0].replace("''", "'"), "", mark.rpartition("'")[2])
        found = _WORD.findall(word)
        if "*" in flags and len(found) == 1:
            return Term(found[0].lower() if config == "simple" else porter(found[0].lower()), True)
        return _phrase(found, config)

    def follows() -> Query | None:
        left = one()
        while (mark := peek()) is not None and mark.startswith("<"):
            take()
            gap = 1 if mark == "<->" else int(mark[1:-1])
            right = one()
            if left is None or right is None:
                left = right if left is None else left
                continue
            a, b = (p if isinstance(p, Phrase) else Phrase((p,), (0,)) if isinstance(p, Term) else None for p in (left, right))
            if a is None or b is None:
                raise QueryError("only words can follow each other in a text query")
            left = Phrase(a.terms + b.terms, a.gaps + tuple(a.gaps[-1] + gap + g for g in b.gaps))
        return left

    def both() -> Query | None:
        parts = [follows()]
        while peek() == "&":
            take()
            parts.append(follows())
        return _all(And, parts)

    def either() -> Query | None:
        parts = [both()]
        while peek() == "|":
            take()
            parts.append(both())
        return _all(Or, parts)

    if not marks:
        return None
    out = either()
    if peek() is not None:
        raise QueryError(f"syntax error in text query {text!r}")
    return out


def parse(text: str, parser: Parser = Parser.WEBSEARCH, config: str = "simple") -> Query | None:
    """The query of a search text; None if nothing but stop words is left, which matches nothing."""
    check_config(config)
    if parser is Parser.WEBSEARCH:
        return _websearch(text, config)
    if parser is Parser.RAW:
        return _raw(text, config)
    words = _WORD.findall(text)
    return _phrase(words, config) if parser is Parser.PHRASE else _all(And, [_phrase([w], config) for w in words])


def terms_of(query: Query, positive_only: bool = False) -> list[Term]:
    if isinstance(query, Term):
        return [query]
    if isinstance(query, Phrase):
        return list(query.terms)
    if isinstance(query, Not):
        return [] if positive_only else terms_of(query.part)
    return [t for p in query.parts for t in terms_of(p, positive_only)]


def needs_hit(query: Query) -> bool:
    """Whether every match holds some term of the query; false where leaving words out is enough."""
    if isinstance(query, Not):
        return False
    if isinstance(query, (Term, Phrase)):
        return True
    return (any if isinstance(query, And) else all)(needs_hit(p) for p in query.parts)


def _is(lexeme: Column, term: Term) -> Column:
    return F.startswith(lexeme, F.lit(term.lexeme)) if term.prefix else lexeme == term.lexeme


def hits(column: Column, query: Query) -> Column:
    """The tokens that are in the query: all that matching and rank need."""
    terms = list(dict.fromkeys(terms_of(query)))
    return F.filter(column, lambda t: reduce(lambda a, b: a | b, [_is(t["lexeme"], x) for x in terms]))


def possible(texts: Sequence[Column], query: Query) -> Column:
    """A filter that every match of unstemmed texts passes: the substrings are there. It spares the rest the tokenizer."""
    if isinstance(query, Term):
        return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(t.cast("string"), F.lit(""))), F.lit(query.lexeme)) for t in texts])
    if isinstance(query, Not):
        return F.lit(True)
    parts = [possible(texts, p) for p in (query.terms if isinstance(query, Phrase) else query.parts)]
    return reduce((lambda a, b: a | b) if isinstance(query, Or) else (lambda a, b: a & b), parts)


def _phrase_in(found: Column, phrase: Phrase) -> Column:
    """Whether some token of the first term has the others at their distances."""

    def follows(t: Column) -> Column:
        rest = [_one_at(found, term, t["pos"] + gap) for term, gap in zip(phrase.terms[1:], phrase.gaps[1:], strict=True)]
        return reduce(lambda a, b: a & b, [_is(t["lexeme"], phrase.terms[0]), *rest])

    return F.exists(found, follows)


def _one_at(found: Column, term: Term, pos: Column) -> Column:
    return F.exists(found, lambda u: _is(u["lexeme"], term) & (u["pos"] == pos))


def matches(found: Column, query: Query) -> Column:
    """Whether hits satisfy the query."""
    if isinstance(query, Term):
        return F.exists(found, lambda t: _is(t["lexeme"], query))
    if isinstance(query, Phrase):
        return _phrase_in(found, query)
    if isinstance(query, Not):
        return ~matches(found, query.part)
    parts = [matches(found, p) for p in query.parts]
    return reduce((lambda a, b: a & b) if isinstance(query, And) else (lambda a, b: a | b), parts)


def _holds(query: Query, at: dict[str, list[int]]) -> bool:
    """Whether the places of lexemes satisfy the query; what is excluded does not count in a cover."""

    def places(t: Term) -> list[int]:
        return [p for x, ps in at.items() if x.startswith(t.lexeme) for p in ps] if t.prefix else at.get(t.lexeme, [])

    if isinstance(query, Term):
        return bool(places(query))
    if isinstance(query, Phrase):
        return any(all(p + g in places(t) for t, g in zip(query.terms[1:], query.gaps[1:], strict=True)) for p in places(query.terms[0]))
    if isinstance(query, Not):
        return True
    return (all if isinstance(query, And) else any)(_holds(p, at) for p in query.parts)


def cover_density(found: Sequence[tuple[str, int, str]], query: Query) -> float:
    """Sum over minimal covers of (hits / sum of 1 / weight) / (1 + words between), after Clarke, Cormack and Tudhope.

    A cover is a stretch of hits that satisfies the query and has no shorter one inside; a single hit covers a
    single term, so it adds its weight.
    """
    wanted = {(t.lexeme, t.prefix) for t in terms_of(query, positive_only=True)}
    entries = sorted((p, x, w) for x, p, w in found if any(x == t or (pre and x.startswith(t)) for t, pre in wanted))
    total, begin = 0.0, 0
    while begin < len(entries):
        at: dict[str, list[int]] = {}
        end = None
        for k in range(begin, len(entries)):
            at.setdefault(entries[k][1], []).append(entries[k][0])
            if _holds(query, at):
                end = k
                break
        if end is None:
            break
        at = {}
        first = end
        for k in range(end, begin - 1, -1):
            at.setdefault(entries[k][1], []).append(entries[k][0])
            if _holds(query, at):
                first = k
                break
        inverse = sum(1.0 / WEIGHTS[w] for _, _, w in entries[first : end + 1])
        between = (entries[end][0] - entries[first][0]) - (end - first)
        if between < 0:
            between = (end - first) // 2
        total += ((end - first + 1) / inverse) / (1 + between)
        begin = first + 1
    return total


def rank(found: Column, query: Query) -> Column:
    """Rank of hits that match. A single term is a sum of weights and stays JVM-side."""
    if isinstance(query, Term):
        weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
        return F.aggregate(F.transform(F.filter(found, lambda t: _is(t["lexeme"], query)), lambda t: weight[t["label"]]), F.lit(0.0), lambda a, x: a + x)

    @F.pandas_udf("double")
    def score(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: None if ts is None else cover_density([(t["lexeme"], t["pos"], t["label"]) for t in ts], query)).astype("float64")

    return score(found)
