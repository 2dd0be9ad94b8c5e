"""Index datasets: immutable segments of Parquet, and numbered manifests that name the current ones.

<root>/<table>/<kind>/<group>/manifests/<n>.json names the segments that make up an index; the highest number counts.
A manifest is written beside and renamed to a number that must not exist yet, so readers see one state or the other,
and of two writers one goes again on top of the other's state. A build writes a base segment; a refresh appends a
delta: the keys that were looked at and their fresh rows, the newest of which count. MOST_DELTAS deltas are merged
into one, or with the base once they outweigh it, so the work of a refresh goes with what changed. Segments that no
manifest names any more stay for a grace time, under readers that are still scanning them.

Text and trigram indexes are postings: a row per lexeme (or trigram) and place, in LEXES folders by a hash of the
lexeme and sorted by it within, so a term reads its own folder and there its own row groups. Paths go through
Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.errors import IndexNotReady
from pagewright.functions import fulltext, trigram
from pagewright.functions.vector import nearest_center
from pagewright.model import Backend, Entity, Hop, SearchPath, Tables, TextGroup, VectorGroup, weight_label
from pagewright.operators.joins import along
from pagewright.sources.embeddings import EmbeddingProvider, embedded


#: Partition column of a coarse vector index.
CELL = "cell"


#: Partition column of postings, and how many values it has.
LEX, LEXES = "lex", 64
#: Deltas of an index before they are merged, and keys of deltas up to which they are broadcast to the rows.
MOST_DELTAS, MOST_BROADCAST = 8, 100_000
#: Seconds for which a segment outlives the last manifest that named it.
GRACE = 3600.0
_TRIES = 50


@dataclass(frozen=True)
class Segment:
    """A folder under the group's: rows, and for a delta the keys that its rows replace."""

    path: str
    rows: int
    schema: str
    keys: int = 0


@dataclass(frozen=True)
class Manifest:
    entity: str
    group: str
    kind: str
    version: int
    segments: list[Segment] = field(default_factory=list)
    config: str | None = None
    model: str | None = None
    dims: int | None = None
    definition: str = ""
    status: str = "active"
    key: list[str] = field(default_factory=list)
    centers: list[list[float]] | None = None
    recall: list[float] | None = None


class Files:
    """Small text files on any file system that Spark knows."""

    def __init__(self, spark: SparkSession):
        self._sc, self._jvm, self._conf = spark.sparkContext, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write beside and rename, so that a reader never sees half a file; false if there is one of that name already."""
        p, fs = self._at(path)
        beside, _ = self._at(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._sc._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self._conf).rename(fs.makeQualified(beside), fs.makeQualified(p), options)
        except Exception as error:
            fs.delete(beside, False)
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        p, fs = self._at(path)
        target, _ = self._at(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"cannot rename {path} to {to}")

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def ages(self, path: str) -> dict[str, float]:
        """Seconds since each entry of a folder was changed."""
        p, fs = self._at(path)
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}


class Numbered:
    """A value in numbered JSON files of a folder, changed by compare and set: the highest number is the value."""

    def __init__(self, files: Files, folder: str, keep: int = 20):
        self.files, self.folder, self.keep = files, folder, keep

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, object | None]:
        for _ in range(_TRIES):
            have = self.numbers()
            if not have:
                return 0, None
            text = self.files.read(f"{self.folder}/{have[-1]}.json")
            if text is not None:
                return have[-1], json.loads(text)
        raise OSError(f"{self.folder} changes too fast to be read")

    def update(self, change: Callable[[object | None, int], object]) -> object:
        """Write what change makes of the value (and its number), again on top of the other's if another writer came first."""
        for k in range(_TRIES):
            number, value = self.read()
            new = change(value, number + 1)
            if self.files.create(f"{self.folder}/{number + 1}.json", json.dumps(new)):
                for old in self.numbers()[: -self.keep]:
                    self.files.remove(f"{self.folder}/{old}.json")
                return new
            time.sleep(0.01 * (k + 1))
        raise OSError(f"{self.folder} is written by too many at once")


# --- text groups -----------------------------------------------------------------------------------------------


def _branch(tables: Tables, base: DataFrame, key: Sequence[str], hops: tuple[Hop, ...], column: str, with_where: bool) -> DataFrame:
    """(key..., value): the text at the end of hops for each owner. Many rows are joined in the order of their text,
    each branch by itself, so branches do not multiply each other."""
    rows = along(tables, base, key, hops, column, "inner", with_where).filter("value is not null")
    many = any(h.many for h in hops)
    value = F.concat_ws(" ", F.sort_array(F.collect_list(F.col("value").cast("string")))) if many else F.min(F.col("value").cast("string"))
    return rows.groupBy(*key).agg(value.alias("value"))


def composed_tokens(tables: Tables, base: DataFrame, key: Sequence[str], group: TextGroup, with_where: bool = False) -> DataFrame:
    """(key..., <group>): the weighted tokens of a group, its own fields first come first served, joined ones aggregated before a left join."""
    df = base.select(*key, *dict.fromkeys(p.column for p in group.paths if not p.hops))
    columns: list[Column] = []
    for k, p in enumerate(group.paths):
        name = p.column
        if p.hops:
            name = f"_b{k}"
            branch = _branch(tables, base, key, p.hops, p.column, with_where).withColumnRenamed("value", name)
            df = df.join(branch, list(key), "left")
        columns.append(fulltext.tokens(F.col(name), p.searchable.config or group.config, weight_label(p.searchable.weight)))
    # tokens are columns before they are joined, as stemming may not stand inside a lambda
    parts = df.select(*key, *[c.alias(f"_t{k}") for k, c in enumerate(columns)])
    return parts.select(*key, fulltext.joined([F.col(f"_t{k}") for k in range(len(columns))]).alias(group.name))


def text_definition(group: TextGroup) -> str:
    parts = [(p.column, p.table, p.searchable.config or group.config, weight_label(p.searchable.weight), [asdict(h) for h in p.hops]) for p in group.paths]
    return json.dumps(parts, sort_keys=True)


# --- vector groups ---------------------------------------------------------------------------------------------


def embedded_vectors(base: DataFrame, entity: Entity, group: VectorGroup, provider: EmbeddingProvider) -> DataFrame:
    """(key..., <group>): one vector per owner, of the embedding source if the field names one."""
    s = group.source.searchable
    source = entity.column(s.embedding_source) if s.embedding_source else group.source.column
    return base.select(*entity.key_columns, embedded(F.col(source).cast("string"), provider).alias(group.name))


def with_cells(rows: DataFrame, group: str, centers: np.ndarray) -> DataFrame:
    """Vectors with the cell of their nearest centroid, by which a coarse index is partitioned; -1 for none."""
    return rows.withColumn(CELL, F.coalesce(nearest_center(F.col(group), centers), F.lit(-1)))


def probed(index: DataFrame, manifest: Manifest, query: Sequence[float], probes: int) -> DataFrame:
    """The cells nearest to a query: other partitions are not read. Without a coarse index, or without probes, everything."""
    if not manifest.centers or not probes:
        return index
    near = np.argsort(-(np.array(manifest.centers) @ np.asarray(query, np.float64)), kind="stable")[:probes]
    return index.filter(F.col(CELL).isin([int(k) for k in near]))


def probes_for(manifest: Manifest, least: float | None) -> int:
    """The fewest cells that reached a recall when the index was measured; 0, which is all, without one."""
    if least is None or not manifest.recall:
        return 0
    return next((k + 1 for k, r in enumerate(manifest.recall) if r >= least), 0)


def vector_definition(path: SearchPath) -> str:
    return json.dumps([path.column, path.searchable.embedding_source, path.searchable.dims])


def check_vector(manifest: Manifest | None, group: VectorGroup, provider: EmbeddingProvider) -> Manifest:
    """Raise unless the active version was made by this model with these dimensions."""
    if provider.dims != group.dims:
        raise IndexNotReady(f"provider {provider.model_id} has {provider.dims} dimensions, group {group.name!r} has {group.dims}")
    if manifest is None or manifest.status != "active":
        raise IndexNotReady(f"no active embedding version for group {group.name!r}; reindex it")
    if manifest.dims != group.dims or manifest.model != provider.model_id:
        raise IndexNotReady(f"group {group.name!r} was embedded by {manifest.model} with {manifest.dims} dimensions; reindex it for {provider.model_id} with {group.dims}")
    return manifest


# --- postings --------------------------------------------------------------------------------------------------


def lex_of(word: str) -> int:
    """The folder of a lexeme."""
    return zlib.crc32(word.encode()) % LEXES


def _with_lex(rows: DataFrame, word: str) -> DataFrame:
    return rows.withColumn(LEX, (F.crc32(F.col(word)) % LEXES).cast("int"))


def text_postings(tokens: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """(key..., lexeme, pos, label, lex) of (key..., <group>)."""
    each = tokens.select(*key, F.explode(group).alias("_t")).select(*key, F.col("_t.lexeme").alias("lexeme"), F.col("_t.pos").alias("pos"), F.col("_t.label").alias("label"))
    return _with_lex(each, "lexeme")


def trigram_postings(base: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key..., field, tri, lex): the distinct trigrams of each text column, numbered by their place in columns."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), trigram.trigram_column(F.col(c).cast("string")).alias("tris")) for k, c in enumerate(columns)]))
    rows = base.select(*key, each.alias("_f")).select(*key, F.col("_f.field").alias("field"), F.explode("_f.tris").alias("tri"))
    return _with_lex(rows, "tri")


def of_terms(postings: DataFrame, terms: Sequence[fulltext.Term]) -> DataFrame:
    """The postings of some terms: whole words read their own folders only, prefixes are found by the sort order."""
    match = None
    for t in terms:
        one = F.startswith(F.col("lexeme"), F.lit(t.lexeme)) if t.prefix else F.col("lexeme") == t.lexeme
        match = one if match is None else match | one
    if match is None:
        return postings.limit(0)
    if not any(t.prefix for t in terms):
        postings = postings.filter(F.col(LEX).isin(*sorted({lex_of(t.lexeme) for t in terms})))
    return postings.filter(match)


def as_tokens(postings: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """(key..., <group>) with the tokens of each key in order of their places."""
    placed = F.array_sort(F.collect_list(F.struct("pos", "lexeme", "label")))
    return postings.groupBy(*key).agg(F.transform(placed, lambda t: F.struct(t["lexeme"].alias("lexeme"), t["pos"].alias("pos"), t["label"].alias("label"))).alias(group))


def trigram_definition(paths: Sequence[SearchPath]) -> str:
    return json.dumps([p.column for p in paths if not p.hops])


# --- the store -------------------------------------------------------------------------------------------------

#: Names of the stored vector column, whatever the group is called.
_VECTOR = "vector"


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, grace: float = GRACE):
        self.spark, self.root, self.files, self.grace = spark, root.rstrip("/"), Files(spark), grace

    def _folder(self, entity: Entity, kind: str, group: str) -> str:
        return f"{self.root}/{entity.table}/{kind}/{group}"

    def _state(self, entity: Entity, kind: str, group: str) -> Numbered:
        return Numbered(self.files, f"{self._folder(entity, kind, group)}/manifests")

    def manifest(self, entity: Entity, kind: str, group: str) -> Manifest | None:
        """Read anew each time: another process may have written one."""
        return _manifest(self._state(entity, kind, group).read()[1])

    def groups(self, entity: Entity, kind: str) -> list[str]:
        return [g for g in self.files.names(f"{self.root}/{entity.table}/{kind}") if self.manifest(entity, kind, g)]

    # --- reading

    def rows(self, entity: Entity, kind: str, group: str, narrow: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The current rows as they are stored: of each key those of the last segment that looked at it."""
        found = self.manifest(entity, kind, group)
        if found is None:
            raise IndexNotReady(f"{kind} group {group!r} of {entity.table} has no index; reindex it")
        return self._live(self._folder(entity, kind, group), found.segments, list(entity.key_columns), narrow)

    def _live(self, folder: str, segments: Sequence[Segment], key: list[str], narrow: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        out = None
        for k, s in enumerate(segments):
            rows = narrow(self.spark.read.schema(StructType.fromJson(json.loads(s.schema))).parquet(f"{folder}/{s.path}/rows")).withColumn("_seq", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        deltas = [(k, s) for k, s in enumerate(segments) if s.keys]
        if not deltas:
            return out.drop("_seq")
        newest = self._keys(folder, deltas).groupBy(*key).agg(F.max("_seq").alias("_newest"))
        newest = F.broadcast(newest) if sum(s.keys for _, s in deltas) <= MOST_BROADCAST else newest
        return out.join(newest, key, "left").filter("_newest is null or _newest <= _seq").drop("_seq", "_newest")

    def _keys(self, folder: str, deltas: Sequence[tuple[int, Segment]]) -> DataFrame:
        out = None
        for k, s in deltas:
            keys = self.spark.read.parquet(f"{folder}/{s.path}/keys").withColumn("_seq", F.lit(k))
            out = keys if out is None else out.unionByName(keys)
        return out

    def read(self, entity: Entity, kind: str, group: str) -> DataFrame:
        """(key..., <group>) of a text or vector group, the latter with its cells; trigram postings as they are."""
        if kind == "fulltext":
            return as_tokens(self.rows(entity, kind, group), entity.key_columns, group)
        rows = self.rows(entity, kind, group)
        return rows.withColumnRenamed(_VECTOR, group) if kind == "vector" else rows

    def tokens(self, entity: Entity, group: str, terms: Sequence[fulltext.Term]) -> DataFrame:
        """(key..., <group>) of the keys that hold any of the terms, with the tokens of these terms only."""
        return as_tokens(self.rows(entity, "fulltext", group, lambda df: of_terms(df, terms)), entity.key_columns, group)

    def holding(self, entity: Entity, group: str, tris: Sequence[str], least: int) -> DataFrame:
        """Keys with a text that holds at least so many of the trigrams."""
        narrow = lambda df: df.filter(F.col(LEX).isin(*sorted({lex_of(t) for t in tris})) & F.col("tri").isin(*tris))
        counts = self.rows(entity, "trigram", group, narrow).groupBy(*entity.key_columns, "field").agg(F.count("*").alias("_n"))
        return counts.filter(F.col("_n") >= least).select(*entity.key_columns).distinct()

    # --- writing

    def _stored(self, entity: Entity, kind: str, group: str, rows: DataFrame) -> DataFrame:
        key = list(entity.key_columns)
        if kind == "fulltext" and "lexeme" not in rows.columns:
            return text_postings(rows, key, group)
        return rows.withColumnRenamed(group, _VECTOR) if kind == "vector" else rows

    def _write(self, entity: Entity, kind: str, group: str, rows: DataFrame, keys: DataFrame | None) -> Segment:
        """One new segment; postings are range-partitioned by lexeme and key, so a frequent lexeme is dealt to many tasks."""
        name = f"{'base' if keys is None else 'delta'}-{uuid.uuid4().hex}"
        path, order = f"{self._folder(entity, kind, group)}/{name}", list(entity.key_columns)
        if LEX in rows.columns:
            by = [LEX, "lexeme" if kind == "fulltext" else "tri", *order]
            rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(LEX).parquet(f"{path}/rows")
        elif CELL in rows.columns:
            rows.write.partitionBy(CELL).parquet(f"{path}/rows")
        else:
            rows.write.parquet(f"{path}/rows")
        n_keys = 0
        if keys is not None:
            keys.select(*order).distinct().write.parquet(f"{path}/keys")
            n_keys = self.spark.read.parquet(f"{path}/keys").count()
        count = self.spark.read.schema(rows.schema).parquet(f"{path}/rows").count()
        return Segment(name, count, rows.schema.json(), n_keys)

    def publish(self, entity: Entity, kind: str, group: str, rows: DataFrame, **facts: object) -> Manifest:
        """Build an index anew. Deltas that others append meanwhile stay on top; what was there before goes after the grace time."""
        state, before = self._state(entity, kind, group), self.manifest(entity, kind, group)
        old = {s.path for s in before.segments} if before else set()
        base = self._write(entity, kind, group, self._stored(entity, kind, group, rows), None)

        def change(value: object | None, number: int) -> object:
            later = [s for s in (_manifest(value).segments if value else []) if s.path not in old and s.keys]
            return asdict(Manifest(entity.table, group, kind, number, [base, *later], key=list(entity.key_columns), **facts))

        new = _manifest(state.update(change))
        self.sweep(entity, kind, group)
        return new

    def refresh(self, entity: Entity, kind: str, group: str, owners: DataFrame, fresh: DataFrame) -> Manifest:
        """Append a delta: the rows of owners are replaced by fresh, and owners without fresh rows leave the index."""
        old = self.manifest(entity, kind, group)
        if old is None:
            raise IndexNotReady(f"{kind} group {group!r} of {entity.table} has no index; reindex it")
        if kind == "vector" and old.centers:
            fresh = with_cells(fresh, group, np.array(old.centers))
        delta = self._write(entity, kind, group, self._stored(entity, kind, group, fresh), owners)
        if not delta.keys:
            return old

        def change(value: object | None, number: int) -> object:
            now = _manifest(value)
            return asdict(replace(now, version=number, segments=[*now.segments, delta]))

        new = _manifest(self._state(entity, kind, group).update(change))
        return self.compact(entity, kind, group) if sum(1 for s in new.segments if s.keys) >= MOST_DELTAS else new

    def compact(self, entity: Entity, kind: str, group: str) -> Manifest:
        """Merge the deltas, with the base too once they hold half as many rows as it does."""
        folder, key, now = self._folder(entity, kind, group), list(entity.key_columns), self.manifest(entity, kind, group)
        base, deltas = [s for s in now.segments if not s.keys], [s for s in now.segments if s.keys]
        if not deltas:
            return now
        whole = 2 * sum(s.rows for s in deltas) >= sum(s.rows for s in base)
        merged = now.segments if whole else deltas
        keys = None if whole else self._keys(folder, list(enumerate(deltas))).select(*key)
        one = self._write(entity, kind, group, self._live(folder, merged, key), keys)
        gone = {s.path for s in merged}

        def change(value: object | None, number: int) -> object:
            late = _manifest(value)
            if not gone <= {s.path for s in late.segments}:
                return asdict(replace(late, version=number))  # built anew meanwhile
            kept = [s for s in late.segments if s.path not in gone]
            at = 0 if whole else sum(1 for s in kept if not s.keys)
            return asdict(replace(late, version=number, segments=[*kept[:at], one, *kept[at:]]))

        new = _manifest(self._state(entity, kind, group).update(change))
        self.sweep(entity, kind, group)
        return new

    def sweep(self, entity: Entity, kind: str, group: str) -> int:
        """Remove segments that the current manifest does not name and that are older than the grace time."""
        folder, now = self._folder(entity, kind, group), self.manifest(entity, kind, group)
        used = {s.path for s in now.segments} if now else set()
        gone = [n for n, age in self.files.ages(folder).items() if n != "manifests" and n not in used and age > self.grace]
        for n in gone:
            self.files.remove(f"{folder}/{n}")
        return len(gone)

    def drop(self, entity: Entity, kind: str, group: str) -> None:
        self.files.remove(self._folder(entity, kind, group))

    def rename(self, entity: Entity, kind: str, group: str, to: str, **facts: object) -> Manifest:
        """The index of a group under another name, without reading its rows."""
        self.files.move(self._folder(entity, kind, group), self._folder(entity, kind, to))
        return _manifest(self._state(entity, kind, to).update(lambda value, number: asdict(replace(_manifest(value), version=number, group=to, **facts))))


def _manifest(value: object | None) -> Manifest | None:
    if value is None:
        return None
    return Manifest(**{**value, "segments": [Segment(**s) for s in value["segments"]]})


# --- planning --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """What has to happen for an index to fit its entity."""

    action: str  # create, rebuild, rename, drop
    kind: str
    group: str
    previous: str | None = None


def wanted_indexes(entity: Entity) -> dict[str, dict[str, tuple[str, str | None]]]:
    """For each kind the groups with their definition and previous name."""
    own = [p for p in entity.paths_of(Backend.TRIGRAM) if not p.hops]
    return {
        "fulltext": {g.name: (text_definition(g), getattr(g, "previous", None)) for g in entity.text_groups},
        "vector": {g.name: (vector_definition(g.source), getattr(g, "previous", None)) for g in entity.vector_groups},
        "trigram": {"default": (trigram_definition(own), None)} if own else {},
    }


def plan_changes(store: IndexStore, entity: Entity) -> list[Change]:
    """Differences between the entity's groups and the manifests: what to create, rebuild, rename and drop."""
    out: list[Change] = []
    for kind, wanted in wanted_indexes(entity).items():
        have = set(store.groups(entity, kind))
        renamed = set()
        for name, (definition, previous) in wanted.items():
            if name in have:
                if store.manifest(entity, kind, name).definition != definition:
                    out.append(Change("rebuild", kind, name))
            elif previous in have:
                renamed.add(previous)
                out.append(Change("rename", kind, name, previous))
                if store.manifest(entity, kind, previous).definition != definition:
                    out.append(Change("rebuild", kind, name))
            else:
                out.append(Change("create", kind, name))
        out += [Change("drop", kind, name) for name in sorted(have - set(wanted) - renamed)]
    return out
