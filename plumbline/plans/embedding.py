"""Embedding of texts: a protocol, and a deterministic embedder that needs no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from plumbline.config import MODELS

#: Texts that a model gets at once.
BATCH = 32


class Embedder(Protocol):
    """Anything that turns texts into vectors of a model's native dimension; it must pickle."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Vectors of hashed words: the same everywhere, alike for texts that share words."""

    def __init__(self, dim: int = 768):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        return out


class Shared:
    """An embedder that each worker makes once, by a function of a module, and keeps: what it holds is never sent to a task."""

    def __init__(self, make: Callable[[], Embedder]):
        self.make = make

    def encode(self, texts: list[str]) -> np.ndarray:
        return _made(self.make).encode(texts)


@lru_cache(4)
def _made(make: Callable[[], Embedder]) -> Embedder:
    return make()


def truncate_and_normalise(x: np.ndarray, dim: int) -> np.ndarray:
    """The leading components at unit length; rows of almost no length stay."""
    x = x[:, :dim]
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norms > 1e-10, x / np.where(norms > 1e-10, norms, 1), x).astype(np.float32)


def embed(texts: list[str], embedder: Embedder, model_id: str, dim: int, query: bool = False) -> np.ndarray:
    prefix = MODELS[model_id][2 if query else 1] if model_id in MODELS else ""
    parts = [embedder.encode([prefix + t for t in texts[i : i + BATCH]]) for i in range(0, len(texts), BATCH)]
    return truncate_and_normalise(np.concatenate(parts), dim) if parts else np.zeros((0, dim), np.float32)


def with_embeddings(rows: DataFrame, column: str, embedder: Embedder, model_id: str, dim: int, query: bool = False) -> DataFrame:
    """Adds ``embedding``, computed in batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(embedding=list(embed(frame[column].tolist(), embedder, model_id, dim, query)))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", embedding array<float>"
    return rows.mapInPandas(run, schema)
