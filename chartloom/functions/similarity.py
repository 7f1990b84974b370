"""Set similarity from sizes, and the exact bounds that make prefix filtering safe."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

MEASURES = ("jaccard", "dice", "cosine", "overlap")
_SLACK = 1e-9  # bounds may only err on the permissive side


def check_measure(kind: str, threshold: float) -> None:
    if kind not in MEASURES:
        raise ValueError(f"similarity must be one of {MEASURES}, got {kind!r}")
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")


def similarity(kind: str, shared: Column, a: Column, b: Column) -> Column:
    """Similarity of two sets of sizes ``a`` and ``b`` with ``shared`` common elements."""
    if kind == "jaccard":
        return F.try_divide(shared.cast("double"), a + b - shared)
    if kind == "dice":
        return F.try_divide(shared * 2.0, a + b)
    if kind == "cosine":
        return F.try_divide(shared.cast("double"), F.sqrt((a * b).cast("double")))
    if kind == "overlap":
        return F.try_divide(shared.cast("double"), F.least(a, b))
    raise ValueError(f"similarity must be one of {MEASURES}, got {kind!r}")


def required_share(kind: str, threshold: float) -> float:
    """Fraction of a set that any partner at or above the threshold must contain."""
    shares: dict[str, Callable[[float], float]] = {
        "jaccard": lambda t: t,
        "dice": lambda t: t / (2 - t),
        "cosine": lambda t: t * t,
        "overlap": lambda t: 0.0,
    }
    return shares[kind](threshold)


def required_overlap(kind: str, threshold: float, size: Column) -> Column:
    """Least number of common elements a set of this size has with any partner (at least 1)."""
    share = required_share(kind, threshold)
    return F.greatest(F.lit(1), F.ceil(size * share - _SLACK).cast("int"))


def prefix_length(kind: str, threshold: float, size: Column) -> Column:
    return size - required_overlap(kind, threshold, size) + 1


def least_shared(kind: str, threshold: float, a: int, b: np.ndarray) -> np.ndarray:
    """Least number of common elements, at least 1, that brings sets of sizes ``a`` and ``b`` to the threshold."""
    shared = {
        "jaccard": threshold * (a + b) / (1 + threshold),
        "dice": threshold * (a + b) / 2,
        "cosine": threshold * np.sqrt(a * b),
        "overlap": threshold * np.minimum(a, b),
    }[kind]
    return np.maximum(1, np.ceil(shared - _SLACK)).astype(np.int64)


def _class_ratio(kind: str, threshold: float) -> float:
    """Sizes of one class differ by at most this factor: 1 / share, at least 1.25, and 2 where the measure sets no limit."""
    share = required_share(kind, threshold)
    return max(1.25, min(2.0, 1 / share)) if share else 2.0


def size_class(kind: str, threshold: float, size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(_class_ratio(kind, threshold))) + F.lit(_SLACK)).cast("int")


def class_range(kind: str, threshold: float, size: Column) -> tuple[Column, Column]:
    """The lowest and highest class that holds sizes which a set of ``size`` can match."""
    share = required_share(kind, threshold)
    if not share:
        return F.lit(0), F.lit(64)
    return size_class(kind, threshold, F.greatest(F.lit(1.0), size * share - _SLACK)), size_class(kind, threshold, size / share + _SLACK)
