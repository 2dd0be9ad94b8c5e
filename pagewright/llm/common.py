"""Helpers shared by the corpus operators: shared storage, byte-level text kernels, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java and RE2 spelling of the word class of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass takes at once; a longer document is a pass of its own.
PASS_BYTES = 1 << 19

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of one of the corpus tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at spark.checkpoint.dir; a folder of our own only where none is set and all runs in this process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagewright-"))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared checkpoint folder, which survives lost executors."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield begin, min(end, rows)
        begin = min(end, rows)


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the word polynomial's base ("step") or of its inverse ("back")."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PASS_BYTES * 2), _STEP if kind == "step" else _BACK, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row where its words begin in those arrays (one more at the end)."""
    solid = ~white[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    if len(solid):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(solid)]] = False
        after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, blind to the case of A-Z: one prefix sum of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * powers("step", len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers("back", len(data))[starts] + (ends - starts).astype(np.uint64))


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share a key, from batches sorted by it; keys are int64 without nulls."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        table = pa.Table.from_batches([batch])
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[begin] != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(begin, end - begin))
            last = keys[begin]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges, for every id in an edge.

    Alternates large-star and small-star contractions until the edges no longer change; a hub's edges stay
    spread, since minima are pre-aggregated and the joins carry narrow rows that AQE can split. Self loops,
    repeated edges and nulls are ignored. No edge ever reaches the driver.
    """
    now = settle(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = settle(small.filter("a != b").distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def repeated(df: DataFrame, copies: str, most: int = 1024) -> DataFrame:
    """Each row of a written df as often as its column copies says, without that column; long runs are dealt to all tasks."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(most).cast("long")))
    parts = df.filter(F.col(copies) > most).withColumn("_part", part).repartition("_part", *[c for c in df.columns if c != copies][:1])
    many = parts.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most), F.col(copies) - F.col("_part"))))).drop("_part")
    few = df.filter(F.col(copies).between(1, most)).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return few.unionByName(many).drop("_each", copies)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df plus more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def hash_share(name: str, seed: int, rows: int, bound: int) -> Column:
    """Keeps about bound of so many rows, by a hash of a column; all of them if there are fewer."""
    fine = 1 << 20
    return F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(fine)) < min(fine, int(fine * bound / max(rows, 1)))


def is_held_out(name: str) -> Column:
    """Whether crc32 of an id as text is divisible by 5; false for null, which no label can name."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, columns: list[str], bound: int, seed: int) -> DataFrame:
    """documents (doc_id, text, ...) joined with a sample of about bound labelled rows that learning may use.

    Rows whose crc32(doc_id as text) is divisible by 5 are held out and never sampled. A doc_id labelled twice
    takes the larger label. The sample is bounded, so it is broadcast and the texts stay where they are.
    """
    free = labels.filter(F.col("doc_id").isNotNull() & F.col(columns[0]).isNotNull()).filter(~is_held_out("doc_id"))
    free = free.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).alias(c) for c in columns])
    sample = free.filter(hash_share("doc_id", seed, free.count(), bound))
    return documents.drop(*columns).join(F.broadcast(sample), "doc_id")
