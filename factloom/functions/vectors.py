"""Vectors as arrays: cosine, normalisation and the byte encoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.workspace import ship_package


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity in DOUBLE; 0 for empty vectors, unequal lengths, nulls and zero norms."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def l2_normalize(v) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in values])


def to_blob(spark, v) -> Column:
    """Little-endian 32-bit floats, back to back."""
    ship_package(spark)

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return encode(v)


def from_blob(spark, b) -> Column:
    """The inverse of ``to_blob``; a length that isn't a multiple of 4 is an error."""
    ship_package(spark)

    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if len(x) % 4:
                raise ValueError(f"a vector of {len(x)} bytes")
            return np.frombuffer(x, "<f4").tolist()

        return s.map(one)

    return decode(b)
