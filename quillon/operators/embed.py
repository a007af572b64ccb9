"""Pluggable embedders and their cache. The default hashes words to a unit vector, so that it works offline and repeats exactly."""
from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

BATCH = 64


class HashingEmbedder:
    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in T.terms_of(text or ""):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class EmbeddingCache:
    """Vectors by text, least recently used out first, bounded by bytes (four a number); counts hits and misses."""

    def __init__(self, max_bytes: int = 100 << 20, dim: int = 64):
        self.capacity, self.hits, self.misses = max(1, max_bytes // (4 * dim)), 0, 0
        self._held: OrderedDict[bytes, list[float]] = OrderedDict()

    @staticmethod
    def _key(text: str) -> bytes:
        return hashlib.blake2b(text.encode(), digest_size=16).digest()

    def get(self, text: str) -> list[float] | None:
        k = self._key(text)
        if k in self._held:
            self.hits += 1
            self._held.move_to_end(k)
            return self._held[k]
        self.misses += 1
        return None

    def insert(self, text: str, vector: list[float]) -> None:
        self._held[self._key(text)] = vector
        while len(self._held) > self.capacity:
            self._held.popitem(last=False)

    def get_or_insert(self, text: str, make: Callable[[str], list[float]]) -> list[float]:
        v = self.get(text)
        if v is None:
            v = make(text)
            self.insert(text, v)
        return v

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    def __len__(self) -> int:
        return len(self._held)


def embeddable(content):
    return F.octet_length(content).between(50, 50000)


def embed_docs(docs: DataFrame, embedder=None) -> DataFrame:
    """(doc_id, embedding) of distinct contents of 50 to 50,000 bytes, cut at 4,096 bytes, in batches of BATCH; a batch that
    the embedder refuses gets no vectors."""
    e = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list = []
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH].tolist()
                try:
                    out += e.embed_batch(part)
                except Exception:  # noqa: BLE001  whatever a model raises
                    out += [None] * len(part)
            yield pd.Series(out, index=b.index)

    d = docs.filter(embeddable(F.col("content"))).dropDuplicates(["doc_id"])
    return d.select("doc_id", run(T.byte_cut(F.col("content"), 4096)).alias("embedding")).filter("embedding IS NOT NULL")
