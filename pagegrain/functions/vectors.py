"""Vectors as arrays: products, norms, cosine, sign codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where lengths differ or a part is null."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine similarity; ``eps`` is added to both norms, and without it a zero vector gives null."""
    if eps:
        return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalise(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def rounded(v: Column, digits: int) -> Column:
    """Parts to so many digits; a negative part that rounds to zero keeps its sign, as IEEE numbers do."""
    return F.transform(_double(v), lambda x: F.when((x < 0) & (F.round(x, digits) == 0), F.lit(-0.0)).otherwise(F.round(x, digits)))


def sign_code(v: Column, dim: int) -> Column:
    """Sign bits of the first ``dim`` parts, 64 in a long; bit i of a word is part i > 0."""
    words = []
    for start in range(0, dim, 64):
        width = min(64, dim - start)
        part = F.slice(_double(v), start + 1, width)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return F.array(*words)


def level_code(v: Column, dim: int) -> Column:
    """Parts as whole numbers of -7 to 7, in sevenths of three standard parts of a unit vector: 4 bits a part."""
    n = norm(v)
    step = n * (3 / 7 / dim**0.5)
    return F.transform(_double(v), lambda x: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.round(x / F.nullif(step, F.lit(0.0))))).cast("tinyint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two sign codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def valid(v: Column, dim: int | None = None) -> Column:
    """A vector without nulls, not empty, of the dimension if one is given."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    return ok if dim is None else ok & (F.size(v) == dim)
