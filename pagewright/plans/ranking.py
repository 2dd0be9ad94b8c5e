"""The rankers. Each returns (key..., score) with its own order; hybrid fuses bounded arms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.errors import QueryError
from pagewright.functions import fulltext, trigram, vector
from pagewright.model import Backend, Parser, SearchPath, Tables
from pagewright.operators.joins import hop_table, owners_with
from pagewright.operators.paging import order_of


@dataclass(frozen=True)
class TextOptions:
    parser: Parser = Parser.WEBSEARCH
    combine_by_sum: bool = False


@dataclass(frozen=True)
class HybridOptions:
    rrf_k: int = 60
    candidate_depth: int = 5
    default_weight: float = 1.0
    default_confidence: float | None = None
    most_cursor_offset: int = 200
    fixed_depth: int | None = None
    filters_allowed: bool = False


@dataclass(frozen=True)
class Ranked:
    """Matching keys with their score; descending says which end of the score is best."""

    rows: DataFrame
    key: tuple[str, ...]
    descending: bool

    @property
    def order(self) -> list[Column]:
        return [order_of("score", self.descending), *[F.col(k).asc() for k in self.key]]


def trigram_search(
    tables: Tables, base: DataFrame, key: Sequence[str], paths: Sequence[SearchPath], term: str, greatest: float = 1 - trigram.MINIMUM, candidates: DataFrame | None = None
) -> Ranked:
    """The least distance of any field, up to greatest. Fields of the row itself are scored in one scan without a shuffle,
    or on the candidates of a trigram index. Texts at the end of hops are scored where they stand, once for each row of
    the last table, and only those that match walk back to their owners."""
    key = tuple(key)
    arms = []
    own = [p for p in paths if not p.hops]
    if own:
        scores = [trigram.distance(F.col(p.column), term, greatest) for p in own]
        able = reduce(lambda a, b: a | b, [trigram.may_match(F.col(p.column).cast("string"), term, 1 - greatest) for p in own])
        here = base if candidates is None else base.join(candidates, list(key), "left_semi")
        arms.append(here.filter(able).select(*key, (F.least(*scores) if len(scores) > 1 else scores[0]).alias("score")).filter("score is not null"))
    for p in paths:
        if p.hops:
            leaf = hop_table(tables, p.hops[-1])
            leaf = leaf.filter(trigram.may_match(F.col(p.column).cast("string"), term, 1 - greatest))
            arms.append(owners_with(tables, base, key, p.hops, leaf.withColumn("_score", trigram.distance(F.col(p.column), term, greatest)).filter("_score is not null")))
    if not arms:
        return Ranked(base.select(*key, F.lit(0.0).alias("score")).limit(0), key, False)
    rows = arms[0] if len(arms) == 1 else reduce(DataFrame.unionByName, arms).groupBy(*key).agg(F.min("score").alias("score"))
    return Ranked(rows, key, False)


def fulltext_search(index: DataFrame, key: Sequence[str], groups: Sequence[tuple[str, str]], text: str, options: TextOptions = TextOptions(), least: float | None = None) -> Ranked:
    """Rows of a token index that match in any group, ranked by the best group or by the sum.

    groups are (token column, text configuration). The text is parsed once per configuration.
    """
    key = tuple(key)
    queries = {config: fulltext.parse(text, options.parser, config) for _, config in groups}
    used = [(column, queries[config]) for column, config in groups if queries[config] is not None]
    if not used:
        return Ranked(index.select(*key, F.lit(0.0).alias("score")).limit(0), key, True)
    hits = [fulltext.hits(F.coalesce(F.col(c), F.array().cast(fulltext.TOKENS)), q).alias(f"_h{k}") for k, (c, q) in enumerate(used)]
    # the explode of one element keeps the filter below from being pushed under the projection, which would tokenize once per term
    hit = index.select(*key, F.explode(F.array(F.struct(*hits))).alias("_hits")).select(*key, "_hits.*")
    found = hit.filter(reduce(lambda a, b: a | b, [fulltext.matches(F.col(f"_h{k}"), q) for k, (_, q) in enumerate(used)]))
    ranks = [F.coalesce(fulltext.rank(F.col(f"_h{k}"), q), F.lit(0.0)) for k, (_, q) in enumerate(used)]
    score = ranks[0] if len(ranks) == 1 else reduce(lambda a, b: a + b, ranks) if options.combine_by_sum else F.greatest(*ranks)
    rows = found.select(*key, score.alias("score"))
    return Ranked(rows if least is None else rows.filter(F.col("score") >= least), key, True)


def vector_search(index: DataFrame, key: Sequence[str], column: str, query: Sequence[float], greatest: float | None = None) -> Ranked:
    """Exact cosine distance of all rows that have a vector; zero vectors do not match."""
    key = tuple(key)
    rows = index.filter(F.col(column).isNotNull()).select(*key, vector.cosine_distance(F.col(column), query).alias("score")).filter("score is not null")
    return Ranked(rows if greatest is None else rows.filter(F.col("score") <= greatest), key, False)


@dataclass(frozen=True)
class Arm:
    ranked: Ranked
    weight: float


def arm_depth(limit: int, offset: int, options: HybridOptions) -> int:
    if options.fixed_depth is not None:
        return options.fixed_depth
    return max((limit + offset) * options.candidate_depth, options.candidate_depth)


def fuse(arms: Sequence[Arm], depth: int, rrf_k: int) -> Ranked:
    """Weighted reciprocal rank fusion: sum of weight / (k + rank). Each arm is cut to depth rows first, so the window is over few."""
    if not arms:
        raise QueryError("hybrid search needs at least one arm")
    key = arms[0].ranked.key
    parts = []
    for arm in arms:
        top = arm.ranked.rows.orderBy(*arm.ranked.order).limit(depth)
        placed = top.withColumn("_rank", F.row_number().over(Window.orderBy(*arm.ranked.order)))
        parts.append(placed.select(*key, (F.lit(arm.weight) * 1.0 / (F.lit(rrf_k) + F.col("_rank"))).alias("_part")))
    rows = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("_part").alias("score"))
    return Ranked(rows, key, True)


def route(backends: Sequence[Backend], override: Backend | None, table: str, hybrid_enabled: bool, primary: Backend | None = None) -> Backend | None:
    """The backend of a search; None means hybrid."""
    if override is not None:
        if override not in backends:
            raise QueryError(f"{table} has no field for backend {override.value}")
        return override
    if not backends:
        raise QueryError(f"{table} has no searchable field")
    if len(backends) == 1:
        return backends[0]
    if not hybrid_enabled:
        raise QueryError(f"{table} is searchable by several backends; enable hybrid search or name one")
    return None


def resolve_single(backends: Sequence[Backend], override: Backend | None, primary: Backend | None) -> Backend | None:
    """The rule for one backend in isolation: the override, else the only one, else the primary."""
    return override or (backends[0] if len(backends) == 1 else primary)
