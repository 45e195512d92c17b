"""Functions of numeric arrays, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    scaled = F.transform(logits, lambda z: z / temperature)
    shifted = F.transform(scaled, lambda z: F.exp(z - F.array_max(scaled)))
    return F.transform(shifted, lambda e: e / total(shifted))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def entropy(p: Column) -> Column:
    """In nats; 0 log 0 is 0."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(F.lit(0.0))))


def kl_divergence(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(F.lit(0.0))))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of n tokens, joined: n shifted copies of the array side by side. tokens should be a column of its own
    (an expression would be evaluated n times)."""
    m = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    shifted = F.arrays_zip(*(F.slice(tokens, F.lit(j + 1), m).alias(f"t{j}") for j in range(n)))
    return F.transform(shifted, lambda z: F.concat_ws(sep, *(z[f"t{j}"] for j in range(n))))
