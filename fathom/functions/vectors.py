"""Vector functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def same_dimension(a: Column, size: int) -> Column:
    """The vector, or an error where its dimension is another."""
    return F.when(F.assert_true(F.size(a) == size).isNull(), a)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(c, F.lit(-50.0)), F.lit(50.0))))


def yes_share(yes: Column, no: Column) -> Column:
    """Softmax of two answers' logits: the share of yes."""
    return sigmoid(yes - no)


def unit(a: Column) -> Column:
    """A vector at length 1; one of no length stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a.cast("array<double>"), lambda x: x / size)).otherwise(a.cast("array<double>"))


def pooled(states: Column, mask: Column, last: bool = False) -> Column:
    """One vector of a text's token vectors (array of arrays) where the mask is 1: their mean, or the last of them; of no
    token a vector of zeros."""
    kept = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    zeros = F.transform(F.get(states, F.lit(0)).cast("array<double>"), lambda x: F.lit(0.0))
    if last:
        return F.coalesce(F.get(kept, F.size(kept) - 1)["v"].cast("array<double>"), zeros)
    total = F.aggregate(kept, zeros, lambda acc, t: F.zip_with(acc, t["v"].cast("array<double>"), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.lit(1), F.size(kept)))
