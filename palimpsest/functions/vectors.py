"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import content_words, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors with a guarded denominator."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: dot(x["a"], x["b"]) / (norm(x["a"]) * norm(x["b"]) + 1e-8))


def normalize(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 1e-8, F.transform(v, lambda x: x / n)).otherwise(v)))


def mean(vectors: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors."""
    total = lambda vs: F.aggregate(vs, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return let(vectors, lambda vs: F.transform(total(vs), lambda x: x / F.size(vs)))


def hashed_counts(text: Column, dim: int) -> Column:
    """Content words hashed to `dim` counts. The word's MD5 gives its place, so other engines can follow."""
    places = F.transform(content_words(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    return F.aggregate(places, F.array_repeat(F.lit(0.0), dim), lambda s, d: F.concat(F.slice(s, F.lit(1), d), F.array(F.get(s, d) + 1.0), F.slice(s, d + 2, F.lit(dim))))


def hashed_embedding(text: Column, dim: int) -> Column:
    """Unit-length hashed word counts; all zero where the text has no content word."""
    return normalize(hashed_counts(text, dim))
