"""Hybrid document retrieval on Spark, and operators that prepare training data."""

from importlib import import_module

_EXPORTS = {
    "Bank": "plans.bank", "BankSet": "plans.bank", "Report": "plans.bank", "EngineConfig": "config", "EngineError": "errors",
    "Embedder": "plans.embedding", "HashEmbedder": "plans.embedding", "Tools": "service", "chunk_markdown": "functions.markdown",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    """Loads what is asked for alone: workers that need one operator don't load the engine."""
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(f"plumbline.{_EXPORTS[name]}"), name)
