"""Column expressions over class scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def predicted_class(logits: Column) -> Column:
    """Index of the largest score; the lower class wins a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def margin(logits: Column) -> Column:
    """Binary decision score: class 1 minus class 0."""
    return F.get(logits, F.lit(1)) - F.get(logits, F.lit(0))


def cross_entropy(logits: Column, label: Column) -> Column:
    """``ln(sum(exp(x))) - x[label]``, shifted by the maximum so that nothing overflows."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.ln(total) - F.get(logits, label)


def pooled(largest: Column, mean: Column, n: Column, scale: float) -> Column:
    """Blend of the largest and the mean score; the mean gains weight with the count."""
    factor = n / F.lit(float(scale))
    return (largest + mean * factor) / (F.lit(1.0) + factor)
