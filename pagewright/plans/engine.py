"""The engine: one query object in, one page out; and index builds."""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import cursor
from pagewright.errors import InvalidCursor, QueryError
from pagewright.functions import fulltext, trigram
from pagewright.functions.vector import centroids, probe_recall, sampled
from pagewright.model import Backend, CursorPage, Entity, Mode, OffsetPage, PagedQuery, Registry, Tables
from pagewright.operators import paging
from pagewright.operators.joins import restrict
from pagewright.operators.predicates import apply_filters, check_filters, restrict_fields
from pagewright.plans.ranking import Arm, HybridOptions, Ranked, TextOptions, arm_depth, fulltext_search, fuse, route, trigram_search, vector_search
from pagewright.sources.embeddings import EmbeddingProvider
from pagewright.sources.index import Change, IndexStore, check_vector, composed_tokens, embedded_vectors, plan_changes, probed, probes_for, text_definition, trigram_definition, trigram_postings, vector_definition, with_cells

log = logging.getLogger("pagewright")


_OTHER_QUERY = "this token belongs to another query: begin again at the first page"


class Ranker(Protocol):
    """Ranks rows of an entity for one backend: rows holds what filters and candidates leave, threshold an arm's confidence or None."""

    def __call__(self, engine: Engine, entity: Entity, query: PagedQuery, rows: DataFrame, threshold: float | None) -> Ranked: ...


@dataclass(frozen=True)
class Options:
    default_limit: int = 25
    most_limit: int = 100
    minimum_similarity: float = trigram.MINIMUM
    slow_seconds: float = 0.5
    text: TextOptions = field(default_factory=TextOptions)
    hybrid: HybridOptions | None = None
    provider: EmbeddingProvider | None = None
    index_joined_where: bool = False
    #: Rankers that take the place of the built-in ones, by backend.
    rankers: Mapping[Backend, Ranker] = field(default_factory=dict)
    #: Log the plan of each search.
    log_plans: bool = False
    #: Cells of a coarse vector index (0: none), and how many a search reads (0: all, which is exact). With least_recall a
    #: search reads as many as held that share of the ten nearest when the index was built and measured by brute force.
    vector_cells: int = 0
    probes: int = 0
    least_recall: float | None = None


class Engine:
    """Answers queries over entities whose tables come from tables; indexes come from a store, or are computed in the plan.

    A page's items are one lazy plan: filters, candidates, ranker and the fetch of full rows. Totals are counted by
    an aggregate of their own, and only where they are asked for.
    """

    def __init__(self, spark: SparkSession, tables: Tables, registry: Registry, options: Options = Options(), store: IndexStore | None = None):
        self.spark, self.tables, self.registry, self.options, self.store = spark, tables, registry, options, store

    # --- offset pages

    def search_offset(self, entity: Entity, query: PagedQuery) -> OffsetPage:
        if query.mode is not Mode.OFFSET:
            raise QueryError("an offset search needs a query in offset mode")
        paging.check_limits(query.limit, query.page)
        page = query.page or 0
        with self._timed(entity, "offset"):
            items, counted = self._page(entity, query, page * query.limit, query.limit)
            total = counted.count() if query.count else None
        return OffsetPage(items, query.limit, page, total, None if total is None else total > (page + 1) * query.limit, page > 0)

    def fetch_offset(self, entity: Entity, query: PagedQuery) -> tuple[OffsetPage, list]:
        """An offset page and its rows, at most limit of them, fetched inside the time that is watched."""
        with self._timed(entity, "offset fetch"):
            page = self.search_offset(entity, query)
            return page, page.items.collect()

    def _logged(self, entity: Entity, df: DataFrame) -> DataFrame:
        if self.options.log_plans:
            log.info("plan for %s:\n%s", entity.table, df._jdf.queryExecution().toString())
        return df

    def _page(self, entity: Entity, query: PagedQuery, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
        """The full rows of a page in order, and the frame whose count is the total."""
        base = self.tables(entity.table)
        entity.check(base.schema)
        if not query.term:
            rows = apply_filters(base, entity, query.filters)
            return self._logged(entity, paging.offset_page(rows, paging.offset_order(entity, query.sort), limit, offset)), rows
        ranked = self.ranked(entity, query, base, offset, limit)
        ordered = ranked.rows.orderBy(*ranked.order)
        top = (ordered.offset(offset) if offset else ordered).limit(limit)
        # the page is at most limit rows, so it is the broadcast side; rows that are gone from the table drop out
        fetched = base.join(F.broadcast(top), list(entity.key_columns))
        return self._logged(entity, fetched.orderBy(*ranked.order)), ranked.rows

    # --- ranking

    def ranked(self, entity: Entity, query: PagedQuery, base: DataFrame | None = None, offset: int = 0, limit: int | None = None) -> Ranked:
        """The ranker of a search over the rows that filters and candidates leave."""
        base = self.tables(entity.table) if base is None else base
        check_filters(entity, query.filters)
        backend = route(entity.backends, query.backend, entity.table, self.options.hybrid is not None, entity.primary)
        if backend is None:
            return self._hybrid(entity, query, base, offset, query.limit if limit is None else limit)
        return self._single(backend, entity, query, self._restricted(entity, query, base), None)

    def _restricted(self, entity: Entity, query: PagedQuery, base: DataFrame) -> DataFrame:
        rows = apply_filters(base, entity, query.filters)
        return rows if query.candidates is None else restrict(rows, entity, query.candidates)

    def _single(self, backend: Backend, entity: Entity, query: PagedQuery, rows: DataFrame, threshold: float | None) -> Ranked:
        if backend in self.options.rankers:
            return self.options.rankers[backend](self, entity, query, rows, threshold)
        key = entity.key_columns
        if backend is Backend.TRIGRAM:
            paths = restrict_fields(entity, entity.paths_of(backend), query.search_fields)
            greatest = 1 - self.options.minimum_similarity if threshold is None else threshold
            return trigram_search(self.tables, rows, key, paths, query.term, greatest, self._trigram_candidates(entity, query.term, greatest))
        narrowed = bool(query.filters) or query.candidates is not None
        if backend is Backend.FULL_TEXT:
            index = self._text_index(entity, rows, narrowed, query.term)
            groups = [(g.name, g.config) for g in entity.text_groups]
            return fulltext_search(index, key, groups, query.term, self.options.text, threshold)
        provider = self._provider()
        group = entity.vector_groups[0]
        wanted = provider.embed(query.term)
        index = self._vector_index(entity, rows, narrowed, provider, wanted)
        return vector_search(index, key, group.name, wanted, threshold)

    def _trigram_candidates(self, entity: Entity, term: str, greatest: float) -> DataFrame | None:
        """Keys that may match by their own fields, from the trigram index; None without one that fits the entity."""
        tris = sorted(set(trigram.trigrams(term)))
        least = trigram.least_shared(term, 1 - greatest)
        found = self.store.manifest(entity, "trigram", "default") if self.store is not None and least > 0 else None
        if found is None or found.definition != trigram_definition(entity.paths_of(Backend.TRIGRAM)):
            return None
        return self.store.holding(entity, "default", tris, least)

    def _provider(self) -> EmbeddingProvider:
        if self.options.provider is None:
            raise QueryError("vector search needs an embedding provider")
        return self.options.provider

    def _text_index(self, entity: Entity, rows: DataFrame, narrowed: bool, term: str) -> DataFrame:
        key = list(entity.key_columns)
        if self.store is None:
            rows = self._able(entity, rows, term)
            parts = [composed_tokens(self.tables, rows, key, g, self.options.index_joined_where) for g in entity.text_groups]
            return reduce(lambda a, b: a.join(b, key), parts)
        queries = {g.name: fulltext.parse(term, self.options.text.parser, g.config) for g in entity.text_groups}
        parts = [self.store.tokens(entity, g.name, fulltext.terms_of(q) if (q := queries[g.name]) is not None else []) for g in entity.text_groups]
        index = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
        if not all(q is None or fulltext.needs_hit(q) for q in queries.values()):
            index = rows.select(*key).join(index, key, "left")  # what holds no term may match
        return index.join(rows.select(*key), key, "left_semi") if narrowed else index

    def _able(self, entity: Entity, rows: DataFrame, term: str) -> DataFrame:
        """Without an index, only rows whose own texts may match are tokenized; joined or stemmed texts cannot be told beforehand."""
        paths = [(g, p) for g in entity.text_groups for p in g.paths]
        if any(p.hops or (p.searchable.config or g.config) != "simple" for g, p in paths):
            return rows
        wanted = fulltext.parse(term, self.options.text.parser)
        if wanted is None:
            return rows.limit(0)
        terms = [fulltext.possible([F.col(p.column) for p in g.paths], wanted) for g in entity.text_groups]
        return rows.filter(reduce(lambda a, b: a | b, terms))

    def _vector_index(self, entity: Entity, rows: DataFrame, narrowed: bool, provider: EmbeddingProvider, wanted: Sequence[float]) -> DataFrame:
        group = entity.vector_groups[0]
        if self.store is None:
            if dict(rows.dtypes).get(group.source.column, "").startswith("array"):
                return rows.select(*entity.key_columns, F.col(group.source.column).alias(group.name))
            return embedded_vectors(rows, entity, group, provider)
        manifest = check_vector(self.store.manifest(entity, "vector", group.name), group, provider)
        index = probed(self.store.read(entity, "vector", group.name), manifest, wanted, self.options.probes or probes_for(manifest, self.options.least_recall))
        return index.join(rows.select(*entity.key_columns), list(entity.key_columns), "left_semi") if narrowed else index

    def _hybrid(self, entity: Entity, query: PagedQuery, base: DataFrame, offset: int, limit: int) -> Ranked:
        options = self.options.hybrid
        if query.filters and not options.filters_allowed:
            raise QueryError("hybrid search does not take filters")
        if (query.candidates is not None or query.search_fields) and not options.filters_allowed:
            raise QueryError("hybrid search does not take candidate keys or search fields")
        rows = self._restricted(entity, query, base)
        arms = []
        for backend, config in entity.hybrid.items():
            weight = config.weight if config.weight == config.weight else options.default_weight
            threshold = options.default_confidence if config.confidence is None else config.confidence
            arms.append(Arm(self._single(backend, entity, query, rows, threshold), weight))
        return fuse(arms, arm_depth(limit, offset, options), options.rrf_k)

    # --- cursor pages

    def search_cursor(self, entity: Entity, query: PagedQuery) -> CursorPage:
        if query.mode is not Mode.CURSOR:
            raise QueryError("a cursor search needs a query in cursor mode")
        paging.check_limits(query.limit, None)
        with self._timed(entity, "cursor"):
            return self._search_pages(entity, query) if query.term else self._keyset_page(entity, query)

    def _print(self, entity: Entity, query: PagedQuery) -> str:
        return cursor.fingerprint(entity.table, query.sort, query.filters, entity.key_columns, query.term, query.backend)

    def keyset_rows(self, entity: Entity, query: PagedQuery, look_ahead: int = 1) -> DataFrame:
        """The rows of a keyset page and look_ahead more, in the order in which they are read."""
        base = self.tables(entity.table)
        entity.check(base.schema)
        order = paging.keyset_order(entity, query.sort)
        rows = apply_filters(base, entity, query.filters)
        read = paging.flip(order) if query.backward else order
        if query.cursor:
            token = cursor.decode(query.cursor)
            if token.version != cursor.KEYSET or token.fingerprint != self._print(entity, query):
                raise InvalidCursor(_OTHER_QUERY)
            kinds = {f.name: f.dataType for f in base.schema.fields}
            keys = dict(zip(entity.key_columns, cursor.decode_keys(token.key_values, [kinds[c] for c in entity.key_columns]), strict=True))
            sorts = [c for c, _ in order if c not in keys]
            if len(sorts) != len(token.sort_values):
                raise InvalidCursor(_OTHER_QUERY)
            values = keys | {c: cursor.value_of(t, kinds[c]) for c, t in zip(sorts, token.sort_values, strict=True)}
            rows = rows.filter(paging.after(read, [values[c] for c, _ in order], [kinds[c] for c, _ in order]))
        return rows.orderBy(*[paging.order_of(c, d) for c, d in read]).limit(query.limit + look_ahead)

    def _keyset_page(self, entity: Entity, query: PagedQuery) -> CursorPage:
        found = self.keyset_rows(entity, query).collect()
        extra, rows = len(found) > query.limit, found[: query.limit]
        if query.backward:
            rows.reverse()
        order, print_ = paging.keyset_order(entity, query.sort), self._print(entity, query)
        mark = lambda row: paging.anchor(row, order, entity.key_columns, print_)
        given = bool(query.cursor)
        return CursorPage(rows, query.limit, mark(rows[-1]) if rows else None, mark(rows[0]) if rows else None, given if query.backward else extra, extra if query.backward else given)

    def _search_pages(self, entity: Entity, query: PagedQuery) -> CursorPage:
        """A search paged by an absolute offset inside the token, up to a cap."""
        print_, offset = self._print(entity, query), 0
        if query.cursor:
            token = cursor.decode(query.cursor)
            if token.version != cursor.SEARCH or token.fingerprint != print_:
                raise InvalidCursor(_OTHER_QUERY)
            offset = token.offset or 0
        most = (self.options.hybrid or HybridOptions()).most_cursor_offset
        if offset > most or offset < 0:
            raise InvalidCursor(f"this token points beyond row {most}, the maximum to which a search can be paged")
        rows = self._page(entity, query, offset, query.limit)[0].collect()
        onward = offset + query.limit
        more = len(rows) == query.limit and query.limit > 0 and onward <= most
        mark = lambda at: cursor.encode(cursor.Token(cursor.SEARCH, fingerprint=print_, offset=at))
        return CursorPage(rows, query.limit, mark(onward) if more else None, mark(max(0, offset - query.limit)) if offset else None, more, offset > 0)

    # --- index builds

    def reindex(self, entity: Entity, kind: str | None = None, groups: Sequence[str] | None = None) -> list[str]:
        """Build the named groups anew, all of them by default, each in one distributed job."""
        base = self.tables(entity.table)
        done = []
        for k, g in self._groups(entity, kind, groups):
            rows, facts = self._index_rows(entity, k, g, base)
            if k == "vector" and self.options.vector_cells:
                sample = sampled(rows, g.name)
                if len(cells := centroids(sample, self.options.vector_cells)):
                    rows, facts["centers"], facts["recall"] = with_cells(rows, g.name, cells), cells.tolist(), probe_recall(sample, cells)
            self.store.publish(entity, k, getattr(g, "name", "default"), rows, **facts)
            done.append(f"{k}:{getattr(g, 'name', 'default')}")
        return done

    def start_index(self, entity: Entity, kind: str, group: str) -> None:
        """An index of this definition without the owners that the table has lost: an empty one if there is none that fits."""
        g = next(g for k, g in self._groups(entity, kind, [group]))
        base, key = self.tables(entity.table), list(entity.key_columns)
        rows, facts = self._index_rows(entity, kind, g, base.limit(0))
        found = self.store.manifest(entity, kind, group)
        if found is None or found.definition != facts["definition"] or (found.model, found.dims) != (facts.get("model"), facts.get("dims")):
            self.store.publish(entity, kind, group, rows, **facts)
            return
        known = self.store.rows(entity, kind, group).select(*key).distinct()
        lost = known.join(base.select(*key), key, "left_anti")
        self.store.refresh(entity, kind, group, lost, rows)

    def _groups(self, entity: Entity, kind: str | None, groups: Sequence[str] | None) -> list[tuple[str, object]]:
        """(kind, group) of the indexes asked for; the trigram index of an entity's own fields has no group of the model."""
        own = [None] if any(not p.hops for p in entity.paths_of(Backend.TRIGRAM)) else []
        every = [("fulltext", g) for g in entity.text_groups] + [("vector", g) for g in entity.vector_groups] + [("trigram", g) for g in own]
        return [(k, g) for k, g in every if kind in (None, k) and (groups is None or getattr(g, "name", "default") in groups)]

    def _index_rows(self, entity: Entity, kind: str, group, base: DataFrame) -> tuple[DataFrame, dict]:
        """The index rows of the rows of base, and what the manifest says of them."""
        if kind == "fulltext":
            return composed_tokens(self.tables, base, entity.key_columns, group, self.options.index_joined_where), dict(config=group.config, definition=text_definition(group))
        if kind == "vector":
            provider = self._provider()
            return embedded_vectors(base, entity, group, provider), dict(model=provider.model_id, dims=group.dims, definition=vector_definition(group.source))
        paths = [p for p in entity.paths_of(Backend.TRIGRAM) if not p.hops]
        return trigram_postings(base, entity.key_columns, [p.column for p in paths]), dict(definition=trigram_definition(paths))

    def refresh(self, entity: Entity, owners: DataFrame, kind: str | None = None, groups: Sequence[str] | None = None) -> list[str]:
        """Bring the rows of some owners up to date: their whole text, joined fields included; deleted owners leave the index.

        Each index gets a delta of these owners; nothing else of it is read or written. Groups without an index raise,
        but for a trigram index, which is optional.
        """
        base, key = self.tables(entity.table), list(entity.key_columns)
        owners = owners.select(*key).distinct()
        changed = base.join(owners, key, "left_semi")
        done = []
        for k, g in self._groups(entity, kind, groups):
            name = getattr(g, "name", "default")
            if k == "trigram" and self.store.manifest(entity, k, name) is None:
                continue
            self.store.refresh(entity, k, name, owners, self._index_rows(entity, k, g, changed)[0])
            done.append(f"{k}:{name}")
        return done

    def apply_changes(self, entity: Entity, changes: Sequence[Change] | None = None) -> list[Change]:
        """Carry out what plan_changes lists: build, rename, drop."""
        changes = plan_changes(self.store, entity) if changes is None else changes
        for c in changes:
            if c.action == "drop":
                self.store.drop(entity, c.kind, c.group)
            elif c.action == "rename":
                self.store.rename(entity, c.kind, c.previous, c.group)
            else:
                self.reindex(entity, c.kind, [c.group])
        return list(changes)

    def _timed(self, entity: Entity, what: str):
        return _Timer(self.spark, entity.table, what, self.options.slow_seconds)


class _Timer:
    """Names the jobs of a query and warns about slow ones."""

    def __init__(self, spark: SparkSession, table: str, what: str, slow: float):
        self.spark, self.what, self.slow = spark, f"pagewright {what} search of {table}", slow

    def __enter__(self):
        self.began = time.monotonic()
        self.spark.sparkContext.setJobDescription(self.what)

    def __exit__(self, kind, error, _):
        self.spark.sparkContext.setJobDescription(None)
        took = time.monotonic() - self.began
        if kind is not None:
            log.error("%s failed after %.3f s: %s", self.what, took, error)
        if took > self.slow:
            log.warning("%s took %.3f s", self.what, took)
