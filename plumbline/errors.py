"""What the engine raises."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class ConfigError(EngineError):
    """A setting is out of range or unknown."""


class DimensionMismatch(EngineError):
    """The index was made with vectors of another length."""


class ModelMismatch(EngineError):
    """The index was made with another embedding model."""


class NotFound(EngineError):
    """No such chunk, document or index."""


class EmbeddingError(EngineError):
    """The embedder failed or gave vectors of a wrong shape."""


class StorageError(EngineError):
    """The tables of an index cannot be read by this version."""


class Conflict(StorageError):
    """Another writer changed the index meanwhile; the change may be tried again."""


class PayloadError(EngineError):
    """What a tool or an editor sent is not what it should be."""


class DuplicatePath(EngineError):
    """A document of that path exists already."""
