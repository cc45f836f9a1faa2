"""Vector measures as column expressions, in double precision and in one order of summation."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of unequal length are an error."""
    a, b = doubles(a), doubles(b)
    product = norm(a) * norm(b)
    value = F.when(product == 0, 0.0).otherwise(dot(a, b) / product)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two index lists; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def hashed_token_vectors(tokens: list[str], size: int = 8) -> np.ndarray:
    """The default token encoder of late interaction: the digest's first hexadecimal digits around their middle, of unit length."""
    digits = np.array([[int(x, 16) for x in hashlib.md5(t.encode()).hexdigest()[:size]] for t in tokens], np.float64).reshape(-1, size) - 7.5
    return digits / np.sqrt((digits * digits).sum(1, keepdims=True))
