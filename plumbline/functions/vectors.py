"""Vector arithmetic as Spark columns, in double precision."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length; 0 for an empty vector."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def truncated(a: Column, dim: int) -> Column:
    """The first ``dim`` components at unit length; a vector of almost no length stays as it is."""
    head = F.slice(a, 1, dim)
    length = norm(head)
    return F.when(length > 1e-10, F.transform(head, lambda x: (x / length).cast("float"))).otherwise(head)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(raw: pd.Series) -> pd.Series:
    """Stored vectors of little-endian 32-bit floats; null stays null."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
