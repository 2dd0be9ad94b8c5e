"""Embedding providers: texts to vectors of a fixed size."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.errors import IndexNotReady


class EmbeddingProvider(Protocol):
    """Travels to executors, so it must pickle."""

    dims: int
    model_id: str

    def embed(self, text: str) -> Sequence[float]: ...


class HashEmbedding:
    """A unit vector from a digest of the text: deterministic, offline, for tests. The digest repeats every 16 places."""

    model_id = "fake"

    def __init__(self, dims: int):
        self.dims = dims

    def embed(self, text: str) -> list[float]:
        halves = struct.unpack(">16h", hashlib.sha256((text or "").encode()).digest())
        raw = np.array([halves[k % 16] for k in range(self.dims)], np.float32) / np.float32(32768)
        norm = np.float32(np.sqrt((raw.astype(np.float64) ** 2).sum()))
        return (raw / norm if norm > 0 else raw).tolist()


class HttpEmbedding:
    """POST <base>/v1/embeddings with a model and inputs, many at once; calls that fail in passing are made again."""

    def __init__(self, base_url: str, model: str, dims: int, api_key: str | None = None, timeout: float = 30.0, tries: int = 4, pause: float = 0.5):
        self.base_url, self.model_id, self.dims, self.api_key, self.timeout, self.tries, self.pause = base_url.rstrip("/"), model, dims, api_key, timeout, tries, pause

    def embed(self, text: str) -> list[float]:
        return self._ask(text)[0]

    def embed_many(self, texts: Sequence[str]) -> list[list[float]]:
        return self._ask(list(texts))

    def _ask(self, given: str | list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url}/v1/embeddings", json.dumps({"model": self.model_id, "input": given}).encode(), headers)
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    data = json.load(answer)["data"]
                break
            except urllib.error.HTTPError as error:
                if k + 1 == self.tries or (error.code < 500 and error.code != 429):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if k + 1 == self.tries:
                    raise
            time.sleep(self.pause * 2**k)
        found = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        if len(found) != (1 if isinstance(given, str) else len(given)):
            raise IndexNotReady(f"model {self.model_id} returned {len(found)} vectors for {len(given)} texts")
        return [checked(v, self.dims, self.model_id) for v in found]


class FunctionEmbedding:
    """Any function from text to vector."""

    def __init__(self, function: Callable[[str], Sequence[float]], dims: int, model_id: str):
        self.function, self.dims, self.model_id = function, dims, model_id

    def embed(self, text: str) -> list[float]:
        return checked(self.function(text), self.dims, self.model_id)


def checked(vector: Sequence[float], dims: int, model_id: str) -> list[float]:
    if len(vector) != dims:
        raise IndexNotReady(f"model {model_id} returned {len(vector)} dimensions, {dims} are configured")
    return [float(v) for v in vector]


#: Texts of one call to a provider.
AT_ONCE = 128


def embed_all(provider: EmbeddingProvider, texts: Sequence[str]) -> list[Sequence[float]]:
    """Vectors of texts, AT_ONCE in a call where the provider takes many."""
    many = getattr(provider, "embed_many", None)
    if many is None:
        return [provider.embed(t) for t in texts]
    return [v for k in range(0, len(texts), AT_ONCE) for v in many(texts[k : k + AT_ONCE])]


def embedded(text: Column, provider: EmbeddingProvider) -> Column:
    """The vector of each text, batch by batch on the executors, equal texts of a batch once; null for null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        distinct = list(dict.fromkeys(t for t in texts if t is not None))
        known = {t: list(v) for t, v in zip(distinct, embed_all(provider, distinct), strict=True)}
        return texts.map(lambda t: None if t is None else known[t])

    return run(text)
