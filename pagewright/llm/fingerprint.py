"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes cuts a text into pieces wherever its lowest bits are all set, so cuts
follow content and an edit moves few of them. Each piece gives one letter; the letters at block size b and 2 b
are the fingerprint "b:letters:letters". Two fingerprints are compared at a block size that both have, by the
share of letters that an edit script of insertions and deletions keeps.

Everything runs on whole byte arrays: window sums and piece hashes are differences of prefix sums, and the
longest common subsequence of up to 64 letters is a bit-parallel recurrence for all rows at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import mix, passes, powers, read_table, repeated, settle, texts_of, with_fields

#: Bytes that the rolling hash sees.
WINDOW = 7
#: Most letters of a signature; what lies beyond goes into the last one. At least half as many are sought.
LETTERS = 64
#: Most slices that documents are dealt to, so that their bounds fit the driver.
MOST_SLICES = 20_000
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.int64)
_CODE[ALPHABET] = np.arange(64)
_ROLL = mix(np.arange(1, 257, dtype=np.uint64))


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each byte, within its row: rotated and xored, as in a buzhash."""
    value = _ROLL[data]
    out = value.copy()
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(data)) - start
    for k in range(1, min(WINDOW, len(data))):
        turned = (value[:-k] << np.uint64(7 * k)) | (value[:-k] >> np.uint64(64 - 7 * k))
        out[k:] ^= np.where(place[k:] >= k, turned, np.uint64(0))
    return mix(out)


def _letters(sums: np.ndarray, cuts: np.ndarray, begin: int, end: int) -> bytes:
    """The letters of the pieces of one row that end at cuts."""
    if begin == end:
        return b""
    ends = cuts if len(cuts) and cuts[-1] == end else np.append(cuts, end)
    if len(ends) > LETTERS:
        ends = np.append(ends[: LETTERS - 1], end)
    starts = np.append(begin, ends[:-1])
    back = powers("back", end)
    return ALPHABET[(mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each row of UTF-8 bytes; an empty row has "1::"."""
    out: list[str] = []
    for begin, end in passes(offsets):
        part, at = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        roll = rolling(part, at)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers("step", len(part)), out=sums[1:])
        low = np.bitwise_count((roll ^ (roll + np.uint64(1))) >> np.uint64(1)).astype(np.int64)  # trailing ones
        for a, b in zip(at[:-1], at[1:], strict=True):
            ones, level = low[a:b], 0
            while (LETTERS << level) < b - a:
                level += 1
            # halve the block size while it cuts too seldom
            cuts = np.flatnonzero(ones >= level) + 1 + a
            while level and len(cuts) < LETTERS // 2 - 1:
                level -= 1
                cuts = np.flatnonzero(ones >= level) + 1 + a
            wide = cuts[ones[cuts - 1 - a] > level]
            out.append(f"{1 << level}:{_letters(sums, cuts, a, b).decode()}:{_letters(sums, wide, a, b).decode()}")
    return out


def _padded(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in signatures], np.int64)
    flat = np.frombuffer(b"".join(s.ljust(LETTERS, b"A") for s in signatures), np.uint8).reshape(-1, LETTERS)
    return _CODE[flat], size


def _kept_share(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """2 * LCS / (letters of both) for each pair of signatures; 1 for two empty ones."""
    a, n = _padded(one)
    b, m = _padded(other)
    rows = np.arange(len(one))
    masks = np.zeros((len(one), 64), np.uint64)
    for k in range(LETTERS):
        on = k < n
        masks[rows[on], a[on, k]] |= np.uint64(1) << np.uint64(k)
    state = np.full(len(one), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(LETTERS):
        hit = state & masks[rows, b[:, k]]
        state = np.where(k < m, (state + hit) | (state - hit), state)
    width = np.where(n > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.maximum(n, 1).astype(np.uint64)), np.uint64(0))
    common = np.bitwise_count(~state & width).astype(np.int64)
    return np.where(n + m > 0, 2 * common / np.maximum(n + m, 1), 1.0)


def likeness(one: list[str], other: list[str]) -> np.ndarray:
    """Likeness of fingerprints, 0 to 1: the best over block sizes that both have, 0 if there is none, 1 if equal."""
    left, right = [x.split(":") for x in one], [x.split(":") for x in other]
    best = np.array([float(x == y) for x, y in zip(one, other, strict=True)])
    # letters i of a fingerprint stand at its block size times 2 ** (i - 1)
    for i, j in ((1, 1), (2, 2), (1, 2), (2, 1)):
        rows = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if best[k] < 1 and int(x[0]) << (i - 1) == int(y[0]) << (j - 1) and (x[i] or y[j])]
        if rows:
            best[rows] = np.maximum(best[rows], _kept_share([left[k][i].encode() for k in rows], [right[k][j].encode() for k in rows]))
    return best


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """documents plus fingerprint, from whole texts in one pass without a shuffle; null counts as empty."""
    df = documents.drop("fingerprint")
    names = df.columns

    def run(batches):
        for batch in batches:
            marks = fingerprints(*texts_of(batch.column(names.index("text")).cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], [*names, "fingerprint"])

    return df.mapInArrow(run, with_fields(df, "fingerprint string"))


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of the first of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(pairs: Iterator[tuple[int | None, int, str, str]]):
    """Rows of the result for (doc_id, copies, text, next text), a few hundred at a time."""
    held: list[tuple[int | None, int, str, str]] = []
    size = 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[2])
        if size > 2_000_000 or len(held) >= 2000:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _marks(texts: list[str]) -> list[str]:
    return fingerprints(*texts_of(pa.array(texts, pa.large_string())))


def _rows(held: list[tuple[int | None, int, str, str]]) -> pa.RecordBatch:
    ids, copies, texts, following = zip(*held, strict=True)
    changed = [edited(x, y) for x, y in zip(texts, following, strict=True)]
    own = _marks([*texts, following[-1]])
    # the next document of a row is the row after it, but for the seams of the partitions
    after = [own[k + 1] if following[k] == (texts[k + 1] if k + 1 < len(texts) else following[-1]) else _marks([following[k]])[0] for k in range(len(texts))]
    own = own[:-1]
    marks = _marks(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array(own),
            pa.array(marks),
            pa.array(likeness(own, marks)),
            pa.array(likeness(own, after)),
            pa.array(copies, pa.int64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"],
    )


#: Slices of one hot place are numbered within this.
_SUB = 1 << 20


class _Slices:
    """Where documents are dealt to: ranges of places, and for a place of many rows ranges of marks within it.

    All of it is bounded by MOST_SLICES. first holds the first (place, mark) of each slice, mark being -1 where the
    slice is no part of a hot place; before the slice before it.
    """

    def __init__(self, texts: DataFrame, rows_per_slice: int):
        places = texts.select("place")
        n = places.count()
        slices = max(1, min(MOST_SLICES, -(-n // rows_per_slice)))
        crowded = places.groupBy("place").count().filter(F.col("count") > max(4 * rows_per_slice, 4 * n // MOST_SLICES)).collect() if n > 4 * rows_per_slice else []
        self.hot = {r["place"]: min(_SUB, -(-r["count"] * slices // n)) for r in crowded}
        bounds = places.stat.approxQuantile("place", [k / slices for k in range(1, slices)], 0.25 / slices) if slices > 1 else []
        own = [p + k for p in self.hot for k in (0, 1) if p + k < 2**63 - 1 or k == 0]
        self.cuts = np.unique(np.array([*(min(int(b), 2**63 - 1) for b in bounds), *own], np.int64))
        found = self._least(places.filter(~F.col("place").isin(*self.hot)) if self.hot else places, False)
        if self.hot:
            found += self._least(texts.filter(F.col("place").isin(*self.hot)).select("place", "text"), True)
        order = sorted(found)
        self.first = {s: (p, m) for s, p, m in order}
        names = [s for s, _, _ in order]
        self.before = dict(zip(names, [*names[-1:], *names[:-1]], strict=True))

    def of(self, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.cuts, places, "right").astype(np.int64) * _SUB
        for p, parts in self.hot.items():
            at = places == p
            out[at] += (marks[at] >> 32) * parts >> 31
        return out

    def _least(self, rows: DataFrame, marked: bool) -> list[tuple[int, int, int]]:
        """(slice, place, mark) of the first row of each slice."""
        of = self.of

        def least(batches):
            seen: dict[int, tuple[int, int]] = {}
            for batch in batches:
                at = batch.column(0).to_numpy()
                marks = np.array([xxhash.xxh3_64_intdigest((t or "").encode()) >> 1 for t in batch.column(1).to_pylist()], np.int64) if marked else np.full(len(at), -1)
                order = np.lexsort((marks, at))
                at, marks = at[order], marks[order]
                for s, k in zip(*np.unique(of(at, np.maximum(marks, 0)), return_index=True), strict=True):
                    here = int(at[k]), int(marks[k])
                    seen[int(s)] = min(seen.get(int(s), here), here)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["slice", "place", "mark"])

        found = rows.mapInArrow(least, "slice long, place long, mark long").groupBy("slice").agg(F.min(F.struct("place", "mark")).alias("at"))
        return [(r["slice"], r["at"]["place"], r["at"]["mark"]) for r in found.collect()]


def compare_with_next(documents: DataFrame, rows_per_slice: int = 512) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, in ascending doc_id.

    Documents are dealt once, by slices of doc_id, so that neighbours meet in one task; only the first document of
    a slice travels twice, to the slice before. Null doc_ids come last; documents with equal doc_id follow each
    other in the order of a hash of their texts, and where they are many (a third of all rows may lack a doc_id) they
    are dealt by ranges of that hash. Equal texts of such a doc_id travel once from each task, with a count. After the
    last comes the first, and a single document is its own next. Null texts are empty. Other columns are ignored.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place.alias("place"))
    slices = _Slices(texts, rows_per_slice)
    names = ["slice", "guest", "place", "mark", "extra", "doc_id", "copies", "packed"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: dict[tuple[int | None, int], list] = {}
        for batch in batches:
            at = batch.column("place").to_numpy()
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            marks = np.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in raw], np.int64)
            rows = []
            for s, p, m, doc_id, text in zip(slices.of(at, marks).tolist(), at.tolist(), marks.tolist(), batch.column("doc_id").to_pylist(), raw, strict=True):
                if p in slices.hot:
                    again = seen.setdefault((doc_id, m), [s, 0, p, m, 1, doc_id, -1, None])
                    again[6] += 1
                    if again[6]:
                        continue
                packed = pack(text)
                rows.append((s, 0, p, m, 0, doc_id, 1, packed))
                if p == slices.first[s][0] and slices.first[s][1] in (-1, m):
                    rows.append((slices.before[s], 1, p, m, 0, doc_id, 1, packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)
        more = [r for r in seen.values() if r[6]]
        if more:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*more, strict=True), kinds, strict=True)], names)

    def meet(batches):
        unpack = zstandard.ZstdDecompressor().decompress

        def pairs():
            last, of = None, None  # [doc_id, place, mark, copies, text]
            for batch in batches:
                for s, guest, p, m, _, doc_id, copies, packed in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                    if last is None and s == of:
                        continue  # another guest
                    if s == of and not guest and [doc_id, p, m] == last[:3]:
                        last[3] += copies
                        continue
                    text = unpack(packed).decode()
                    if s == of:
                        if last[3] > 1:
                            yield last[0], last[3] - 1, last[4], last[4]
                        yield last[0], 1, last[4], text
                    last, of = (None if guest else [doc_id, p, m, copies, text]), s

        yield from _compared(pairs())

    dealt = texts.mapInArrow(deal, "slice long, guest int, place long, mark long, extra int, doc_id long, copies long, packed binary")
    near = dealt.repartition("slice").sortWithinPartitions("slice", "guest", "place", "mark", "doc_id", "extra")
    out = near.mapInArrow(meet, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long")
    if slices.hot:
        return repeated(settle(out), "copies")
    return out.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_each", "copies")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4_fingerprint SQL can say: lengths and edited texts, by way of the same pass."""
    return op4_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_ORACLE = """
with texts as (select doc_id, coalesce(text, '') as t from documents),
pairs as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as after from texts)
select doc_id, length(t)::bigint as n_chars, sha256(left(t, length(t) - length(t) // 4) || left(after, length(t) // 4)) as edited_sha256 from pairs
"""
