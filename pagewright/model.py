"""What a caller declares (entities, searchable fields, joins) and asks for (one query object)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from pagewright.errors import ModelError, UnknownEntity

#: Hops that all joins of a search path may take together.
HOP_BUDGET = 5


class Op(Enum):
    EQ = "eq"
    NEQ = "neq"
    GT = "gt"
    GTE = "gte"
    LT = "lt"
    LTE = "lte"
    CONTAINS = "contains"
    IN = "in"
    IS_NULL = "isnull"
    NOT_NULL = "notnull"


class Backend(Enum):
    TRIGRAM = "trigram"
    FULL_TEXT = "fulltext"
    VECTOR = "vector"


class Parser(Enum):
    WEBSEARCH = "websearch"
    PLAIN = "plain"
    PHRASE = "phrase"
    RAW = "raw"


class ReindexMode(Enum):
    INLINE = "inline"
    CONCURRENT = "concurrent"
    DEFERRED = "deferred"


def weight_label(weight: float) -> str:
    """The label bucket of a full-text weight."""
    return "A" if weight >= 2.0 else "B" if weight >= 1.0 else "C" if weight >= 0.5 else "D"


@dataclass(frozen=True)
class Searchable:
    """A field that a ranker reads; a field may have several."""

    field: str
    backend: Backend = Backend.TRIGRAM
    weight: float = 1.0
    group: str = "default"
    config: str | None = None
    dims: int | None = None
    confidence: float | None = None
    embedding_source: str | None = None
    previous_group: str | None = None
    as_primary: bool = False


@dataclass(frozen=True)
class Join:
    """A navigation to another entity: many children that point here, or one parent that this row points to.

    where is trusted developer SQL over the joined table; {c} stands for the table itself.
    """

    name: str
    to: Entity
    many: bool = False
    foreign_key: str | None = None
    depth: int = 1
    where: str | None = None


@dataclass(frozen=True)
class Hop:
    table: str
    alias: str
    foreign_key: str
    referenced_key: str
    many: bool
    where: str | None
    schema: str | None = None


@dataclass(frozen=True)
class SearchPath:
    """A searchable field with the hops that lead to it; none for the entity's own fields."""

    searchable: Searchable
    column: str
    table: str
    hops: tuple[Hop, ...] = ()


@dataclass(frozen=True)
class TextGroup:
    name: str
    config: str
    paths: tuple[SearchPath, ...]
    previous: str | None = None


@dataclass(frozen=True)
class VectorGroup:
    name: str
    dims: int
    source: SearchPath


@dataclass(frozen=True)
class ArmConfig:
    weight: float
    confidence: float | None


#: The key of an entity that names none.
DEFAULT_KEY = ("id",)


@dataclass(frozen=True)
class Entity:
    """A root table with its key, its searchable fields and what may filter and sort.

    fields maps property names to columns where they differ. filterable maps a field to the operators that it
    admits; an empty set admits all. key names one or more fields, in tie-break order.
    """

    table: str
    key: tuple[str, ...] = DEFAULT_KEY
    searchables: tuple[Searchable, ...] = ()
    joins: tuple[Join, ...] = ()
    filterable: Mapping[str, frozenset[Op]] = field(default_factory=dict)
    sortable: frozenset[str] = frozenset()
    fields: Mapping[str, str] = field(default_factory=dict)
    ignored: frozenset[str] = frozenset()
    schema: str | None = None
    text_config: str = "simple"

    def column(self, name: str) -> str:
        return self.fields.get(name, name)

    @cached_property
    def key_columns(self) -> tuple[str, ...]:
        if not self.key:
            raise ModelError(f"Entity {self.table} has no key")
        return tuple(map(self.column, self.key))

    @cached_property
    def paths(self) -> tuple[SearchPath, ...]:
        """All searchable fields, the entity's own first, then those of joined entities."""
        return tuple(_paths(self, 0, (), {x.lower() for x in self.ignored}))

    def paths_of(self, backend: Backend) -> tuple[SearchPath, ...]:
        return tuple(p for p in self.paths if p.searchable.backend is backend)

    @cached_property
    def backends(self) -> tuple[Backend, ...]:
        return tuple(b for b in Backend if self.paths_of(b))

    @cached_property
    def text_groups(self) -> tuple[TextGroup, ...]:
        out = []
        for name, paths in _by_group(self.paths_of(Backend.FULL_TEXT)).items():
            configs = {p.searchable.config for p in paths if p.searchable.config}
            renames = {p.searchable.previous_group for p in paths if p.searchable.previous_group}
            if len(renames) > 1:
                raise ModelError(f"Full-text group {name!r} of {self.table} is renamed from several groups: {sorted(renames)}")
            if name in renames:
                raise ModelError(f"Full-text group {name!r} of {self.table} is renamed from itself")
            out.append(TextGroup(name, next(iter(configs)) if len(configs) == 1 else self.text_config, tuple(paths), next(iter(renames), None)))
        return tuple(out)

    @cached_property
    def vector_groups(self) -> tuple[VectorGroup, ...]:
        out = []
        for name, paths in _by_group(self.paths_of(Backend.VECTOR)).items():
            dims = {p.searchable.dims for p in paths}
            if len(dims) != 1:
                raise ModelError(f"Vector group {name!r} of {self.table} has conflicting dimensions: {sorted(map(str, dims))}")
            size = next(iter(dims))
            if not size or size <= 0:
                raise ModelError(f"Vector group {name!r} of {self.table} needs positive dimensions")
            out.append(VectorGroup(name, size, paths[0]))
        return tuple(out)

    @cached_property
    def hybrid(self) -> dict[Backend, ArmConfig] | None:
        """One arm per backend if there are several: the first searchable of each sets its weight and threshold."""
        if len(self.backends) < 2:
            return None
        first = {b: self.paths_of(b)[0].searchable for b in self.backends}
        return {b: ArmConfig(s.weight, s.confidence) for b, s in first.items()}

    @property
    def primary(self) -> Backend | None:
        return next((p.searchable.backend for p in self.paths if p.searchable.as_primary), None)

    def check(self, schema: StructType) -> None:
        """Raise unless the table has the columns that the entity names."""
        have = set(schema.fieldNames())
        wanted = {*self.key_columns, *map(self.column, self.filterable), *map(self.column, self.sortable), *(p.column for p in self.paths if not p.hops)}
        if missing := sorted(wanted - have):
            raise ModelError(f"Table {self.table} lacks the columns {missing} that its entity names")


def _by_group(paths: Sequence[SearchPath]) -> dict[str, list[SearchPath]]:
    out: dict[str, list[SearchPath]] = {}
    for p in paths:
        out.setdefault(p.searchable.group or "default", []).append(p)
    return out


def _alias(name: str, depth: int) -> str:
    capitals = "".join(c.lower() for c in name if c.isupper())
    return (capitals or name[:2].lower()) + str(depth)


def _paths(entity: Entity, depth: int, hops: tuple[Hop, ...], ignored: set[str]) -> list[SearchPath]:
    out = [SearchPath(s, entity.column(s.field), entity.table, hops) for s in entity.searchables if s.field.lower() not in ignored]
    for join in entity.joins:
        if join.name.lower() in ignored:
            continue
        deeper = depth + join.depth
        if deeper > HOP_BUDGET:
            raise ModelError(f"Search join {entity.table}.{join.name} exceeds the hop budget of {HOP_BUDGET}")
        if len(join.to.key) > 1:
            raise ModelError(f"Search join {entity.table}.{join.name} references {join.to.table}, which has a composite key")
        if join.many:
            own = entity.key_columns[0] if len(entity.key) == 1 else None
            foreign = join.foreign_key or own
            if foreign is None:
                raise ModelError(f"Search join {entity.table}.{join.name} needs a foreign key")
            hop = Hop(join.to.table, _alias(join.name, deeper), foreign, entity.key_columns[0], True, join.where, join.to.schema)
        else:
            hop = Hop(join.to.table, _alias(join.name, deeper), join.foreign_key or f"{join.name}_id".lower(), join.to.key_columns[0], False, join.where, join.to.schema)
        out += _paths(join.to, deeper, (*hops, hop), ignored)
    return out


@dataclass(frozen=True)
class Filter:
    field: str
    op: Op
    value: str = ""


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


class Mode(Enum):
    OFFSET = "offset"
    CURSOR = "cursor"


@dataclass(frozen=True)
class PagedQuery:
    """The one query object. Offset mode counts pages from 0; cursor mode takes a token and a direction."""

    mode: Mode = Mode.OFFSET
    limit: int = 25
    search: str | None = None
    search_fields: tuple[str, ...] = ()
    sort: tuple[Sort, ...] = ()
    filters: tuple[Filter, ...] = ()
    page: int | None = None
    count: bool = True
    cursor: str | None = None
    backward: bool = False
    backend: Backend | None = None
    candidates: Sequence[Any] | None = None
    match_info: bool = False

    @property
    def term(self) -> str:
        return (self.search or "").strip()

    def with_(self, **changes: Any) -> PagedQuery:
        return replace(self, **changes)


@dataclass(frozen=True)
class OffsetPage:
    """items is lazy and in page order; total is None where it was not asked for."""

    items: DataFrame
    limit: int
    page: int
    total: int | None
    has_more: bool | None
    has_prev: bool
    match_info: None = None


@dataclass(frozen=True)
class CursorPage:
    items: list[Any]
    limit: int
    next_cursor: str | None
    prev_cursor: str | None
    has_more: bool
    has_prev: bool
    match_info: None = None


#: Gives the ordered key fields of tables that it knows, for entities that name no key themselves.
KeySource = Callable[[Sequence[str]], Mapping[str, Sequence[str]]]


class Registry:
    """Entities by table name. key_source fills in the keys of entities that leave the default."""

    def __init__(self, *entities: Entity, key_source: KeySource | None = None):
        self._key_source = key_source
        self._by_table: dict[str, Entity] = {}
        self.add(*entities)

    def add(self, *entities: Entity) -> None:
        keys = self._key_source([e.table for e in entities]) if self._key_source else {}
        for e in entities:
            known = tuple(keys.get(e.table, ()))
            self._by_table[e.table] = replace(e, key=known) if known and e.key == DEFAULT_KEY else e

    def __getitem__(self, table: str) -> Entity:
        try:
            return self._by_table[table]
        except KeyError:
            raise UnknownEntity(f"No entity is registered for table {table!r}; register it or check its name. Known: {sorted(self._by_table)}") from None

    def __iter__(self):
        return iter(self._by_table.values())


#: Finds a table by name: a catalog, a folder of Parquet files, or frames given by hand.
Tables = Callable[[str], DataFrame]
