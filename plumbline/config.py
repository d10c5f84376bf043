"""Settings of an index and of a search, with the checks on them."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace

from plumbline.errors import ConfigError

# Embedding models with their native dimension, document prefix and query prefix.
MODELS = {
    "nomic-embed-text-v1.5": (768, "search_document: ", "search_query: "),
    "mxbai-embed-large-v1": (1024, "", "Represent this sentence for searching relevant passages: "),
    "all-minilm-l6-v2": (384, "", ""),
}


def native_dim(model_id: str) -> int:
    if model_id not in MODELS:
        raise ConfigError(f"unknown embedding model '{model_id}'; known: {', '.join(MODELS)}")
    return MODELS[model_id][0]


@dataclass(frozen=True)
class EngineConfig:
    db_path: str = "index"
    embedding_dim: int = 512
    max_chunk_tokens: int = 450
    chunk_overlap_chars: int = 200
    model_id: str = "nomic-embed-text-v1.5"
    mmr_lambda: float = 0.7
    mmr_candidate_multiplier: int = 3
    heading_boost: float = 0.05
    rrf_k: int = 60
    max_top_k: int = 50
    max_file_size: int = 10 * 1024 * 1024
    extra_db_paths: tuple[str, ...] = field(default=())

    @property
    def max_chunk_bytes(self) -> int:
        return self.max_chunk_tokens * 4

    def validated(self) -> EngineConfig:
        """Itself, if all settings are in range; loading alone checks nothing."""
        top = native_dim(self.model_id)
        if not 64 <= self.embedding_dim <= top:
            raise ConfigError(f"embedding_dim must be within [64, {top}] for {self.model_id}")
        if self.max_chunk_tokens <= 0:
            raise ConfigError("max_chunk_tokens must be positive")
        if self.chunk_overlap_chars >= self.max_chunk_bytes:
            raise ConfigError("chunk_overlap_chars must be below 4 * max_chunk_tokens")
        return self

    def with_overrides(self, dim: int | None = None, model: str | None = None, dbs: list[str] | None = None) -> EngineConfig:
        """Command-line overrides: a model without a dimension lowers the dimension to what the model has; the first index is primary."""
        out = self
        if model:
            out = replace(out, model_id=model)
            if dim is None:
                out = replace(out, embedding_dim=min(out.embedding_dim, native_dim(model)))
        if dim is not None:
            out = replace(out, embedding_dim=dim)
        if dbs:
            out = replace(out, db_path=dbs[0], extra_db_paths=tuple(dbs[1:]))
        return out


def from_toml(text: str) -> EngineConfig:
    known = {f.name for f in fields(EngineConfig)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in tomllib.loads(text).items() if k in known}
    return EngineConfig(**values)


def load(path: str | None = None, candidates: tuple[str, ...] = ("plumbline.toml", "~/.config/plumbline/plumbline.toml")) -> EngineConfig:
    """The settings of the named file, else of the first candidate that exists, else the defaults."""
    for at in [path] if path else [os.path.expanduser(c) for c in candidates]:
        if path or os.path.exists(at):
            with open(at, encoding="utf-8") as f:
                return from_toml(f.read())
    return EngineConfig()
