"""Log-likelihood terms and the softmax used by the cause scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_term(z: Column) -> Column:
    return z * z * -0.5


def bernoulli_term(flag: Column, p_true: float) -> Column:
    """Log-probability of a yes/no observation that is true with ``p_true``."""
    return F.when(flag, F.lit(math.log(p_true))).otherwise(F.lit(math.log(1 - p_true + 1e-9)))


def log_prior(p: float) -> Column:
    return F.lit(math.log(p + 1e-12))


def softmax(logs: dict[str, Column]) -> dict[str, Column]:
    """Probabilities from log scores, shifted by the maximum so that ``exp`` cannot overflow."""
    top = F.greatest(*logs.values())
    weights = {name: F.exp(value - top) for name, value in logs.items()}
    total = sum(weights.values(), F.lit(0.0))
    return {name: weight / total for name, weight in weights.items()}


def first_largest(values: dict[str, Column]) -> Column:
    """Name of the largest value; the earliest one wins a tie."""
    top = F.greatest(*values.values())
    names = iter(values.items())
    name, value = next(names)
    choice = F.when(value == top, name)
    for name, value in names:
        choice = choice.when(value == top, name)
    return choice
