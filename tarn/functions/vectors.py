"""Vector functions as column expressions; float and int8 codecs for interchange."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length, or as it is if it has almost none."""
    norm = F.sqrt(dot(v, v))
    # the norm goes in as an array, so that it is computed once and not for each component
    return F.zip_with(v, F.array_repeat(F.when(norm > 1e-10, norm).otherwise(F.lit(1.0)), F.size(v)), lambda x, n: x.cast("double") / n)


def mock_embedding(text: Column, dimension: int = 8) -> Column:
    """The first bytes of the text's SHA-256 over 255, normalized."""
    pairs = F.slice(F.regexp_extract_all(F.sha2(text, 256), F.lit(".."), 0), 1, dimension)
    raw = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("double") / 255)
    return l2_normalize(raw)


def hashed_chars(text: Column, dimension: int = 8) -> Column:
    """Placeholder embedding: character codes plus place, modulo 256, over 255."""
    at = F.sequence(F.lit(0), F.lit(dimension - 1))
    code = lambda i: F.when(i < F.length(text), F.ascii(F.substr(text, i + 1, F.lit(1)))).otherwise(0)
    return l2_normalize(F.transform(at, lambda i: ((code(i) + i) % 256).cast("double") / 255))


def quantize(v: Column) -> Column:
    """INT8: 127 times each component, rounded half away from zero, held to ±127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") * 127))).cast("tinyint"))


def dequantize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def to_blob(vector: list[float] | np.ndarray, kind: str = "fp32") -> bytes:
    """Little-endian bytes of a vector."""
    return np.asarray(vector, dtype={"fp32": "<f4", "int8": "i1"}[kind]).tobytes()


def from_blob(blob: bytes, dimension: int, kind: str = "fp32") -> np.ndarray | None:
    """The vector, or None if the length does not fit."""
    dtype = np.dtype({"fp32": "<f4", "int8": "i1"}[kind])
    return np.frombuffer(blob, dtype) if len(blob) == dimension * dtype.itemsize else None
