"""Near-duplicate detection: SetSketch registers, banding, joint likelihood, exact verification.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Equal sets are one class from the
start. Each class gets a sketch: per register the minimum of an exponential hash over the set, rounded down to
a power of BASE and truncated to a byte. Such minima merge, and two sets agree in a register with a probability
that rises with their likeness, so registers can be banded.

Links are found in two rounds, and no group is ever expanded into all its pairs:

1. in each bucket of each band every class meets one hub of the bucket (another in each band);
2. in each bucket whose other members still lie in different components, sketches are compared in blocks; the
   classes with a partner that the likelihood leaves open bring their full sets to the block, which settles them.
   In a crowded bucket, as boilerplate makes it, a class meets only those larger ones that share one of its rarest
   shingles (a prefix filter, which loses no pair at the threshold), or all of them in blocks where that is cheaper.

Pairs that share a band are kept if the joint likelihood of both sketches, at the known set sizes, does not rule the
threshold out, and are then confirmed on the full sets. So whether a pair is linked depends on its two sets alone, not
on how many others share its buckets. Connected components of the confirmed links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import connected_components, grouped, mix, passes, read_table, settle, span_hashes, texts_of, word_bounds

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Registers: BANDS bands of ROWS. At a likeness of exactly 0.75 a register agrees with p = 0.76, so a pair
#: misses every band with probability (1 - 0.76**5)**48 = 8e-7.
BANDS, ROWS = 48, 5
BASE = 1.1
#: The likelihood test runs so far under the threshold that it drops a pair at exactly 0.75 with p <= 8e-9 (counts of
#: registers are multinomial; summed exactly), far less than the bands miss. Exact verification does the rest.
LEAST_LIKELY = 0.58
#: A bucket of up to so many members is one block. In a larger one a class goes by its rarest shingles, or by blocks of
#: chunks of BLOCK rows if pairs by shingles, at PAIR_COST comparisons of sketches each, would take longer. Both are exact.
CROWDED, BLOCK, PAIR_COST = 2048, 1024, 16
#: Shingles are ordered by how many sets have one of the same SLOTS; any order is right, this one makes few pairs.
SLOTS = 1 << 18
#: Nothing is split by levels any more; a test of before still sets this.
LEVELS = 0

_SPICE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_FACTOR = ((_SEEDS[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
_FLIP = (_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)[:, None]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words is one shingle, one of none is empty."""
    spice = np.resize(_SPICE, words) + np.arange(words, dtype=np.uint64) // np.uint64(len(_SPICE)) * np.uint64(2)
    for begin, end in passes(offsets):
        part, at = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        starts, ends, first = word_bounds(part, at)
        hashes = span_hashes(part, starts, ends)
        runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            runs += hashes[k : k + len(runs)] * spice[k]
        runs = mix(runs)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield mix(np.array([(hashes[a:b] * spice[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """One byte a register: the truncated exponent, to the base BASE, of the set's least exponential hash."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, ((x[None, at : at + 1024] ^ _FLIP) * _FACTOR).min(axis=1), out=least)
    exponent = 1 - np.log(-np.log1p(-(least + 0.5) / 2.0**32)) / math.log(BASE)
    return np.clip(np.floor(exponent) + 40, 0, 255).astype(np.uint8).tobytes()


def _sketched(batches):
    for batch in batches:
        ids, n, keys, sketches = batch.column(0), [], [], []
        for s in shingle_sets(*texts_of(batch.column(1))):
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])


def _sets(batches):
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(*texts_of(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def likely(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, least: float = LEAST_LIKELY) -> np.ndarray:
    """Whether the maximum of the joint likelihood of two sketches lies at a likeness of least or more.

    Registers are rows of bytes, n_* the set sizes, which are known. The likelihood is that of the counts of
    registers where one sketch exceeds the other; it is concave, so the sign of its slope at least decides.
    """
    up = (one > other).sum(axis=-1)
    down = (one < other).sum(axis=-1)
    same = one.shape[-1] - up - down
    u = n_one / (n_one + n_other)
    v = 1 - u
    fits = np.minimum(u, v) * 100 >= PERCENT * np.maximum(u, v) * (1 - 1e-12)
    shrink, log_base = (BASE - 1) / BASE, math.log(BASE)
    x, y = np.where(fits, u - v * least, 0.1), np.where(fits, v - u * least, 0.1)
    p, q = -np.log1p(-x * shrink) / log_base, -np.log1p(-y * shrink) / log_base
    dp, dq = shrink / log_base / (1 - x * shrink), shrink / log_base / (1 - y * shrink)
    slope = -up * v * dp / p - down * u * dq / q + same * (v * dp + u * dq) / (1 - p - q)
    return fits & (slope >= 0)


def _plausible(batches):
    """Of pairs with both sketches, those that share a band and that the likelihood leaves open."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("sketch_a", "sketch_b"))
        keep = likely(one, other, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        keep &= (one == other).reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _blockwise(batches):
    """For each class of a block with an open partner in another component: a row with its partners.

    A pair counts only in the first band that it shares, so it is looked at once. Where a block has two sides, classes of
    side 0 meet the larger ones of side 1 (by set size, then by rep). Partners are lists, at most about CROWDED long;
    classes that are only a partner get a row with an empty list.
    """
    for block in grouped(batches, "block_key"):
        rep, comp, n, band, side = (block.column(k).to_numpy() for k in ("rep", "component", "n_shingles", "band", "side"))
        regs = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(len(rep), BANDS, ROWS)
        two = bool((side != side[0]).any())
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if two else left
        partners: dict[int, list[int]] = {}
        of = dict(zip(rep.tolist(), comp.tolist(), strict=True))
        for i in left:
            js = right[(comp[right] != comp[i]) & ((n[right] > n[i]) | ((n[right] == n[i]) & (rep[right] > rep[i])))]
            js = js[100 * n[i] >= PERCENT * n[js]]
            if not len(js):
                continue
            agree = (regs[js] == regs[i]).all(axis=2)
            js = js[agree[:, band[i]] & (agree.argmax(axis=1) == band[i])]
            if not len(js):
                continue
            flat = regs[js].reshape(len(js), -1)
            js = js[likely(flat, np.broadcast_to(regs[i].reshape(-1), flat.shape), n[js], np.full(len(js), n[i]))]
            if len(js):
                partners.setdefault(int(rep[i]), []).extend(rep[js].tolist())
                for r in rep[js].tolist():
                    partners.setdefault(r, [])
        if partners:
            rows = sorted(partners)
            keys = np.full(len(rows), block.column("block_key")[0].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows, pa.int64()), pa.array([of[r] for r in rows], pa.int64()), pa.array([partners[r] for r in rows], pa.list_(pa.int64()))], ["block_key", "rep", "component", "partners"])


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches):
    """How many sets have a shingle of each slot; one of several in the same slot counts as several."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for s in shingle_sets(*texts_of(batch.column(1))):
            np.add.at(counts, _slot(s), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "sets"])


def rarest(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set that meet those of a set as large or smaller, and how many of them meet a larger one.

    Two sets at the threshold share at least PERCENT in 100 of the larger one, and at least 2 * PERCENT in 100 + PERCENT of
    the smaller one. The first shingle that they share, in any order of all shingles, has the others after it in both. So
    it is among the first n - least + 1 of each, least being what the set must share at least.
    """
    n = len(shingles)
    order = np.argsort(counts[_slot(shingles)], kind="stable")[: n + 1 + -PERCENT * n // 100]
    return shingles[order], n + 1 + -2 * PERCENT * n // (100 + PERCENT)


def _prefixes(batches, counts: np.ndarray):
    for batch in batches:
        n, own, tokens = [], [], []
        for s in shingle_sets(*texts_of(batch.column(1))):
            first, k = rarest(s, counts) if len(s) else (s, 0)
            n.append(len(s))
            own.append(k)
            tokens.append(first.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["rep", "n", "own", "tokens"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = _common(x, y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _block_links(batches):
    """Confirmed links of the open pairs of each block: one for each class and component that it links to."""
    for block in grouped(batches, "block_key"):
        reps, comps = block.column("rep").to_pylist(), dict(zip(block.column("rep").to_pylist(), block.column("component").to_pylist(), strict=True))
        sets: dict[int, list[np.ndarray]] = {}
        for r, x in zip(reps, block.column("shingles"), strict=True):
            sets.setdefault(r, []).append(np.frombuffer(x.as_buffer(), np.uint64))  # several, if a doc_id has several texts
        a, b = [], []
        for r, partners in dict(zip(reps, block.column("partners").to_pylist(), strict=True)).items():  # equal in all rows of a rep
            reached = set()
            for q in partners:
                if q in sets and comps[q] not in reached and any(_linked(x, y) for x in sets[r] for y in sets[q]):
                    reached.add(comps[q])
                    a.append(r)
                    b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            keep.append(_linked(x, y))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in wanted (doc_id); only these are shingled again and moved."""
    return settle(documents.join(wanted.distinct(), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"))


def _open(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sketches leave open."""
    sized = {k: classes.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in ("a", "b")}
    return settle(pairs.join(sized["a"], "a").join(sized["b"], "b").mapInArrow(_plausible, "a long, b long").distinct())


def _confirm(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold."""
    sets = _sets_of(documents, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    one, other = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long")


def _bands(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each class and band; bucket is a hash of the band and its registers."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.substring("sketch", k * ROWS + 1, F.lit(ROWS))).alias("bucket"))))
    return classes.select("rep", *more, each.alias("x")).select("rep", *more, "x.band", "x.bucket")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents (doc_id, text).

    Null and empty texts have no shingles and no links; a text of any length is shingled whole, and its set is what a
    task holds of it. Rows that repeat a doc_id are one document with several
    texts: each gets a row, and their links are joined. A row without doc_id takes part in nothing; its
    component_id is null and kept is true. Other columns are ignored.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = settle(source.mapInArrow(_sketched, "doc_id long, n_shingles long, set_key binary, sketch binary"))
    classes = settle(rows.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")))
    texts = source.filter("doc_id is not null")

    banded = _bands(classes)
    order = F.struct(F.xxhash64("rep", "band").alias("by"), F.col("rep").alias("hub"))
    hubs = banded.groupBy("bucket").agg(F.min(order).alias("first"), F.count("*").alias("members")).filter("members > 1").select("bucket", "members", F.col("first.hub").alias("hub"))
    shared = settle(banded.join(hubs, "bucket").filter("rep != hub"))
    pairs = shared.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    pairs = _open(pairs, classes)
    links = settle(_confirm(texts, pairs).unionByName(_same_document(rows, classes)))

    joined = connected_components(links, "a", "b")
    placed = settle(classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "n_shingles", "sketch", F.coalesce("component", "rep").alias("component")))
    more = settle(_links_between(shared, placed, texts))
    if not more.isEmpty():
        joined = connected_components(links.unionByName(more), "a", "b")

    within = classes.select("set_key", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("of_class"))
    return _labelled(rows, within, joined)


def _same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that has several different texts."""
    known = rows.filter("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo != hi").select("doc_id")
    return known.join(several, "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _labelled(rows: DataFrame, within: DataFrame, joined: DataFrame) -> DataFrame:
    """Components of the rows through their classes: classes of copies are joined to rows by a sort-merge join that AQE can split."""
    out = rows.select("doc_id", "n_shingles", "set_key").join(within, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(held: DataFrame) -> DataFrame:
    """The rows (rep, component, band, bucket) of buckets whose members lie in several components, with members."""
    mixed = held.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket", "members")
    return held.join(mixed, "bucket")


def _held(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """(rep, component, n_shingles, sketch, band, bucket, members) of the buckets whose members lie in several components.

    shared has the members (rep, band, bucket, members, hub) without the hubs themselves.
    """
    # a class is in at most BANDS buckets, so its component is joined once to the list of them
    lists = shared.filter("members > 2").groupBy("rep").agg(F.collect_list(F.struct("band", "bucket")).alias("at"))
    held = lists.join(placed.select("rep", "component"), "rep").select("rep", "component", F.explode("at").alias("x")).select("rep", "component", "x.*")
    # what is left is little, and takes its sketches along from here
    return settle(_mixed(held).join(placed.select("rep", "n_shingles", "sketch"), "rep"))


def _by_shingles(crowd: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that share one of their rarest shingles, and the classes (rep) that were left out.

    A class looks for those larger than itself (by set size, then by rep), and is left out if that makes more pairs than its
    crowded buckets are worth. Every class is found by the smaller ones that are not left out.
    """
    weighed = settle(crowd.groupBy("rep").agg(F.min("component").alias("component"), F.sum("members").alias("met")))
    sets = texts.mapInArrow(_slot_counts, "slot long, sets long").groupBy("slot").agg(F.sum("sets").alias("sets")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[sets.column("slot").to_numpy()] = sets.column("sets").to_numpy()
    lists = texts.join(weighed.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    lists = settle(lists.mapInArrow(lambda batches: _prefixes(batches, counts), "rep long, n long, own long, tokens array<long>"))
    each = lists.join(weighed.select("rep", "component"), "rep").select("rep", "component", "n", "own", F.posexplode("tokens").alias("at", "token"))
    each = each.select("rep", "component", "n", "token", (F.col("at") < F.col("own")).alias("own"))
    mixed = each.groupBy("token").agg(F.count("*").alias("pairs"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("any")).filter("lo != hi and any")
    each = settle(each.join(mixed.select("token", "pairs"), "token"))
    cost = each.filter("own").groupBy("rep").agg(F.sum("pairs").alias("pairs"))
    dear = settle(cost.join(weighed, "rep").filter(F.col("pairs") * PAIR_COST > F.col("met")).select("rep"))
    one = each.filter("own").join(dear, "rep", "left_anti").select("token", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("component").alias("of_x"))
    larger = F.expr(f"of_x != component and (n_x < n or n_x = n and x < rep) and 100 * n_x >= {PERCENT} * n")
    other = each.select(F.col("token").alias("same"), "rep", "n", "component")
    pairs = one.join(other, (F.col("token") == F.col("same")) & larger).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
    return pairs.distinct(), dear


def _block_members(held: DataFrame, dear: DataFrame | None) -> tuple[DataFrame, bool]:
    """(rep, component, n_shingles, sketch, band, block_key, side) of the blocks in which sketches are compared, and
    whether no bucket was crowded.

    A row is in the block of each of its buckets that is not crowded. In a crowded one, the k of m members that are in dear
    (rep) are cut into k / BLOCK chunks, all members into m / BLOCK; each chunk of the ones meets each of the others.
    """
    columns = ["rep", "component", "n_shingles", "sketch", "band"]
    small = held.filter(F.col("members") <= CROWDED).select(*columns, F.col("bucket").alias("block_key"), F.lit(0).alias("side"))
    if dear is None:
        return small, True
    crowd = held.filter(F.col("members") > CROWDED).join(dear.select("rep", F.lit(True).alias("dear")), "rep", "left")
    crowd = crowd.join(crowd.groupBy("bucket").agg(F.count("dear").alias("k")).filter("k > 0"), "bucket")
    chunks = lambda k: F.ceil(F.col(k) / BLOCK).cast("int")
    drawn = lambda k, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), chunks(k)).cast("int")
    looks = F.transform(F.sequence(F.lit(0), chunks("members") - 1), lambda j: F.struct(drawn("k", 7).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    found = F.transform(F.sequence(F.lit(0), chunks("k") - 1), lambda i: F.struct(i.alias("i"), drawn("members", 8).alias("j"), F.lit(1).alias("side")))
    cells = F.explode(F.when(F.col("dear"), F.concat(looks, found)).otherwise(found)).alias("cell")
    large = crowd.select(*columns, "bucket", cells).select(*columns, F.xxhash64("bucket", "cell.i", "cell.j").alias("block_key"), F.col("cell.side").alias("side"))
    return small.unionByName(large), False


def _links_between(shared: DataFrame, placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components among the members of a bucket besides its hub."""
    held = _held(shared, placed)
    crowd = held.filter(F.col("members") > CROWDED)
    pairs, dear = (None, None) if crowd.isEmpty() else _by_shingles(crowd, texts)
    blocks = _block_members(held, dear)[0].repartition("block_key").sortWithinPartitions("block_key")
    found = settle(blocks.select("block_key", "rep", "component", "n_shingles", "band", "side", "sketch").mapInArrow(_blockwise, "block_key long, rep long, component long, partners array<long>"))
    sets = _sets_of(texts, found.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    ready = found.join(sets, "rep").repartition("block_key").sortWithinPartitions("block_key")
    links = ready.select("block_key", "rep", "component", "partners", "shingles").mapInArrow(_block_links, "a long, b long").distinct()
    return links if pairs is None else links.unionByName(_confirm(texts, _open(pairs, placed)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(id, node) as (select doc_id, doc_id from documents union select id, b from reach join both_ways on node = a),
least as (select id, min(node) as component_id from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least on id = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""
