"""Word similarity by trigrams: how well a term matches its best stretch of a text."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least similarity of a match; the greatest distance is one less this.
MINIMUM = 0.35
_SPLIT = re.compile(r"[^\w]|_", re.UNICODE)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return [w for w in _SPLIT.split(text.lower()) if w]


def trigrams(text: str) -> list[str]:
    """All trigrams in order: each word has two spaces before it and one after."""
    out = []
    for word in words_of(text):
        padded = f"  {word} "
        out += [padded[k : k + 3] for k in range(len(padded) - 2)]
    return out


def best_match(term: frozenset[str], text: list[str], least: float = 0.0) -> float:
    """The greatest Jaccard similarity of the term's trigrams and those of a stretch of the text.

    Only stretches that begin and end with a trigram of the term can be best. With a least similarity s, a stretch
    of more than |term| / s distinct trigrams cannot reach it, so the work is linear in the text.
    """
    if not term:
        return 0.0
    hits = [k for k, g in enumerate(text) if g in term]
    most = len(term) / least if least > 0 else math.inf
    best = 0.0
    for i, start in enumerate(hits):
        inside: set[str] = set()
        shared = 0
        at = start
        for end in hits[i:]:
            for g in text[at : end + 1]:
                if g not in inside:
                    inside.add(g)
                    shared += g in term
            at = end + 1
            if len(inside) > most:
                break
            best = max(best, shared / (len(term) + len(inside) - shared))
    return best


def word_similarity(term: str, text: str) -> float:
    return best_match(frozenset(trigrams(term)), trigrams(text))


#: What lies between words, JVM-side: the same class as words_of splits on. Combining marks part words in both.
_GAP = r"[^\p{L}\p{N}]+"


def _spaced(column: Column) -> Column:
    """Words with their padding; three spaces part them, so no trigram of a word occurs across a border."""
    return F.concat(F.lit("  "), F.regexp_replace(F.trim(F.regexp_replace(F.lower(column), _GAP, " ")), " ", "   "), F.lit(" "))


def trigram_column(column: Column) -> Column:
    """The distinct trigrams of a text, JVM-side; null gives none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), _GAP), "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def least_shared(term: str, least: float) -> int:
    """How many of the term's trigrams a text must hold to reach a similarity."""
    return math.ceil(least * len(set(trigrams(term))) - 1e-9)


def may_match(column: Column, term: str, least: float) -> Column:
    """A JVM-side filter that every match passes: at least ceil(least * |term|) of the term's trigrams occur."""
    wanted = sorted(set(trigrams(term)))
    if not wanted:
        return F.lit(False)
    spaced = _spaced(column)
    held = sum((F.contains(spaced, F.lit(g)).cast("int") for g in wanted), F.lit(0))
    return held >= least_shared(term, least)


def distance(column: Column, term: str, greatest: float) -> Column:
    """1 - word similarity where that is at most greatest, else null; texts that cannot match go to Python as null.

    Declared non-deterministic, which it is not, so that a filter on the result does not run it a second time.
    """
    wanted, least = frozenset(trigrams(term)), max(0.0, 1.0 - greatest)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known: dict[str, float | None] = {}

        def one(text: str | None) -> float | None:
            if text is None:
                return None
            if text not in known:
                if len(known) > 100_000:
                    known.clear()
                found = 1.0 - best_match(wanted, trigrams(text), least)
                known[text] = found if found <= greatest + 1e-12 else None
            return known[text]

        return texts.map(one).astype("float64")

    text = column.cast("string")
    return score.asNondeterministic()(F.when(may_match(text, term, least), text))
