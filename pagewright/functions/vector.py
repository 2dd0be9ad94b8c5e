"""Vectors: cosine distance over Arrow batches, and a coarse index for large tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_vector(text: str) -> list[float]:
    """The literal [a,b,...]."""
    body = text.strip()
    if not body.startswith("[") or not body.endswith("]"):
        raise ValueError(f"not a vector literal: {text!r}")
    return [float(x) for x in body[1:-1].split(",")]


def vector_text(values: Sequence[float]) -> str:
    return "[" + ",".join(repr(float(v)) for v in values) + "]"


def cosine_distance(column: Column, query: Sequence[float]) -> Column:
    """1 - cosine in double precision; null for null, for another length, and where a norm is zero.

    Declared non-deterministic, which it is not, so that a filter on the result does not run it a second time.
    """
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def score(lists: pa.Array) -> pa.Array:
        out = np.full(len(lists), np.nan)
        sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(sizes == len(q))
        if len(fits) and norm:
            x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), len(q))
            lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fits] = np.where(lengths > 0, 1.0 - (x @ q) / (lengths * norm), np.nan)
        return pa.array(out, mask=np.isnan(out))

    return score.asNondeterministic()(column)


#: Bound on the vectors from which centroids and recall are learned.
SAMPLE = 20_000


def sampled(df: DataFrame, column: str, sample: int = SAMPLE) -> np.ndarray:
    """About sample unit vectors of a column, by a hash, in a fixed order; null and zero vectors are left out."""
    total = df.filter(F.col(column).isNotNull()).count()
    share = min(1.0, sample / max(total, 1))
    picked = df.filter(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select(column)
    rows = sorted(r[0] for r in picked.collect())
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    norms = np.linalg.norm(x, axis=1)
    return x[norms > 0] / norms[norms > 0, None]


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Spherical k-means of unit vectors, for a coarse index; deterministic for the same rows."""
    if not len(x):
        return np.zeros((0, 0))
    centers = x[np.random.default_rng(seed).permutation(len(x))[: min(k, len(x))]]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centers)
    return centers


def probe_recall(x: np.ndarray, centers: np.ndarray, k: int = 10, queries: int = 200) -> list[float]:
    """For 1, 2, ... cells probed: the share of the k nearest neighbours, by brute force over x, that these cells hold."""
    if not len(x):
        return []
    asked = x[:: max(1, len(x) // queries)]
    own = (x @ centers.T).argmax(axis=1)
    order = np.argsort(-(asked @ centers.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell among those nearest to a query
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    needed = np.take_along_axis(place, own[near], axis=1)
    return [float((needed < p + 1).mean()) for p in range(len(centers))]


def nearest_center(column: Column, centers: np.ndarray) -> Column:
    """The index of the centroid with the largest cosine, to partition an index by."""

    @F.arrow_udf("int")
    def pick(lists: pa.Array) -> pa.Array:
        fits = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == centers.shape[1])
        out = np.full(len(lists), -1, np.int32)
        if len(fits):
            x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
            out[fits] = (x @ centers.T).argmax(axis=1)
        return pa.array(out, mask=out < 0)

    return pick(column)
